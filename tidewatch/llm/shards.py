"""Sorted tables as files that tasks map into memory: one file for each shard, named by a small manifest."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewatch.llm.common import column, settle
from tidewatch.llm.elias_fano import map_arrays, write_arrays


def by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """Rows that come in order of their ``shard``, one table for each; only one shard is held."""
    held: list[pa.RecordBatch] = []
    of = None
    for batch in batches:
        shards = column(batch, "shard").to_numpy()
        heads = np.flatnonzero(np.append(True, shards[1:] != shards[:-1])) if len(shards) else np.zeros(0, np.int64)
        for a, b in zip(heads.tolist(), np.append(heads[1:], len(shards)).tolist(), strict=True):
            if held and shards[a] != of:
                yield of, pa.Table.from_batches(held)
                held = []
            of = int(shards[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield of, pa.Table.from_batches(held)


def write_shards(rows: DataFrame, folder: str, label: str, make: Callable[[pa.Table], dict[str, np.ndarray]]) -> dict[int, tuple[str, int]]:
    """One file for each value of the column ``shard``, of the arrays that ``make`` builds from its rows.

    Returns path and number of rows of each shard. The caller bounds how many rows a shard can have.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, table in by_shard(batches):
            path = write_arrays(folder, make(table))
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([path]), pa.array([table.num_rows], pa.int64())], names=["shard", "path", "n"]
            )

    kept = rows.repartition("shard").sortWithinPartitions("shard")
    return {r["shard"]: (r["path"], r["n"]) for r in settle(kept.mapInArrow(run, "shard int, path string, n bigint"), label).collect()}


_mapped: dict[str, dict[str, np.ndarray]] = {}
_MAPPED = 20_000


def mapped(path: str) -> dict[str, np.ndarray]:
    """A file's arrays, mapped once in each Python worker."""
    if path not in _mapped:
        if len(_mapped) >= _MAPPED:
            _mapped.clear()
        _mapped[path] = map_arrays(path)
    return _mapped[path]


def each_shard(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The shards that occur in ``shard``, and the places of each."""
    if not len(shard):
        return
    order = np.argsort(shard.astype(np.uint16) if shard.max() < 1 << 16 else shard, kind="stable")
    own = shard[order]
    heads = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
    for a, b in zip(heads.tolist(), np.append(heads[1:], len(own)).tolist(), strict=True):
        yield int(own[a]), order[a:b]


def packed(texts: list[bytes], name: str) -> dict[str, np.ndarray]:
    return {
        f"{name}.bytes": np.frombuffer(b"".join(texts), np.uint8),
        f"{name}.ends": np.cumsum([0] + [len(t) for t in texts]),
    }


def unpacked(arrays: dict[str, np.ndarray], name: str, at: np.ndarray) -> list[bytes]:
    ends = arrays[f"{name}.ends"]
    data = arrays[f"{name}.bytes"]
    return [data[a:b].tobytes() for a, b in zip(ends[at].tolist(), ends[at + 1].tolist(), strict=True)]
