"""Counts of 63-bit keys inside a task, as rows of bounded number held at once; Spark sums them over tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

HELD = 1_000_000
ROWS = 100_000


class Tally:
    """Keys are summed where they are met; when many different ones are held, they leave as rows."""

    SCHEMA = "key bigint, times bigint"

    def __init__(self, held: int = HELD):
        self.keys: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        self.held, self.most = 0, held

    def add(self, keys: np.ndarray, times: np.ndarray | None = None) -> None:
        if not len(keys):
            return
        if times is None:
            keys, times = np.unique(keys, return_counts=True)
        self.keys.append(keys.astype(np.int64))
        self.times.append(times.astype(np.int64))
        self.held += len(keys)
        if self.held > self.most:
            self._merge()

    def _merge(self) -> None:
        if len(self.keys) < 2:
            return
        keys, times = np.concatenate(self.keys), np.concatenate(self.times)
        self.keys, self.times = [], []
        order = np.argsort(keys)
        keys, times = keys[order], times[order]
        heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        keys, times = keys[heads], np.add.reduceat(times, heads)
        self.keys, self.times, self.held = [keys], [times], len(keys)

    def full(self) -> Iterator[pa.RecordBatch]:
        """Rows, if more different keys are held than should be even after merging."""
        if self.held > self.most // 2 and len(self.keys) == 1:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        self._merge()
        for keys, times in zip(self.keys, self.times, strict=True):
            for at in range(0, len(keys), ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + ROWS]), pa.array(times[at : at + ROWS])], names=["key", "times"])
        self.keys, self.times, self.held = [], [], 0
