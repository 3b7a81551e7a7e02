"""Sets of 64-bit hashes as bits of bounded size, for Arrow tasks: set by tasks, merged by Spark, sent to tasks again.

They may hold a hash that was not added, never the other way round.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BITS_PER_VALUE = 12
LEAST_BITS = 1 << 16
MOST_BITS = 1 << 27
# Bytes of a set that are merged in one piece.
_PIECE = 1 << 16


def probes_of(hashes: np.ndarray, bits: int, probes: int) -> Iterator[np.ndarray]:
    """Bits of a hash."""
    shift = np.uint64(64 - (bits.bit_length() - 1))
    for k in range(probes):
        yield (hashes * np.uint64(0xD6E8FEB86659FD93 + 2 * k) >> shift).astype(np.int64)


@dataclass
class BitSet:
    data: np.ndarray  # uint8
    probes: int

    def has(self, hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), bool)
        for at in probes_of(hashes, 8 * len(self.data), self.probes):
            found &= (self.data[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return found


def build(
    rows: DataFrame, hashed: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[int, np.ndarray]]], count: int, kinds: list[int], probes: int
) -> dict[int, BitSet]:
    """A set for each of a few ``kinds``, of the (kind, hashes) that ``hashed`` takes from the rows; sized by ``count``."""
    bits = LEAST_BITS
    while bits < min(MOST_BITS, BITS_PER_VALUE * count):
        bits *= 2
    piece = min(_PIECE, bits // 8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = {kind: np.zeros(bits // 8, np.uint8) for kind in kinds}
        for kind, hashes in hashed(batches):
            for at in probes_of(hashes, bits, probes):
                np.bitwise_or.at(sets[kind], at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
        for kind, data in sets.items():
            for k in range(0, len(data), piece):
                if data[k : k + piece].any():
                    yield pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([k], pa.int64()), pa.array([data[k : k + piece].tobytes()])], names=["kind", "at", "data"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for kind, at, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                part = np.frombuffer(data, np.uint8)
                held[kind, at] = held[kind, at] | part if (kind, at) in held else part
        for (kind, at), part in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([at], pa.int64()), pa.array([part.tobytes()])], names=["kind", "at", "data"])

    schema = "kind int, at bigint, data binary"
    merged = rows.mapInArrow(run, schema).repartition("kind", "at").mapInArrow(merge, schema)
    sets = {kind: np.zeros(bits // 8, np.uint8) for kind in kinds}
    # At most MOST_BITS for each kind.
    for row in merged.collect():
        sets[row["kind"]][row["at"] : row["at"] + piece] = np.frombuffer(row["data"], np.uint8)
    return {kind: BitSet(data, probes) for kind, data in sets.items()}
