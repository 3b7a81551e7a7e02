"""Elias-Fano sequences, and a container file for arrays that readers map into memory.

A sorted sequence of n values below u takes about ``2 + log2(u / n)`` bits a value: the low
bits of each value stand packed, the high bits are a bit vector with a one for each value
and a zero for each step of the high part. A directory of 32-bit counts, one for each
64-bit word, is all that ``access`` (the i-th value) and ``find`` (where a value stands) need.
All queries take arrays of positions or values.
"""

from __future__ import annotations

import json
import tempfile
import uuid

import numpy as np
from pyarrow import fs

_MASKS = {w: np.uint64((1 << w) - 1) for w in (32, 16, 8, 4, 2, 1)}


def _select_in_word(word: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Position of the k-th one (from 0) of each word, which must have it."""
    word, k = word.copy(), k.astype(np.int64).copy()
    at = np.zeros(len(word), np.int64)
    for width, mask in _MASKS.items():
        ones = np.bitwise_count(word & mask).astype(np.int64)
        up = k >= ones
        k -= np.where(up, ones, 0)
        at += np.where(up, width, 0)
        word = np.where(up, word >> np.uint64(width), word)
    return at


class EliasFano:
    """A monotone sequence. ``parts()`` are its arrays, from which it can be opened again."""

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.width, self.low, self.high, self.ones = n, width, low, high, ones

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        """From values that never fall; they must be below 2**63."""
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        width = max(0, ((top + 1) // max(n, 1)).bit_length() - 1)
        low = np.zeros((n * width + 63) // 64 + 1, np.uint64)
        if width:
            at = np.arange(n, dtype=np.uint64) * np.uint64(width)
            word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            bits = values & np.uint64((1 << width) - 1)
            np.bitwise_or.at(low, word, bits << shift)
            over = np.flatnonzero(shift + np.uint64(width) > np.uint64(64))
            np.bitwise_or.at(low, word[over] + 1, bits[over] >> (np.uint64(64) - shift[over]))
        place = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
        words = ((int(place[-1]) if n else 0) + 2 + 63) // 64
        flags = np.zeros(words * 64, np.uint8)
        flags[place] = 1
        high = np.packbits(flags, bitorder="little").view(np.uint64)
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high), dtype=np.int64)]).astype(np.uint32)
        return cls(n, width, low, high, ones)

    def parts(self, name: str) -> dict[str, np.ndarray]:
        return {
            f"{name}.size": np.array([self.n, self.width], np.int64),
            f"{name}.low": self.low,
            f"{name}.high": self.high,
            f"{name}.ones": self.ones,
        }

    @classmethod
    def open(cls, arrays: dict[str, np.ndarray], name: str) -> EliasFano:
        n, width = (int(x) for x in arrays[f"{name}.size"])
        return cls(n, width, arrays[f"{name}.low"], arrays[f"{name}.high"], arrays[f"{name}.ones"])

    def _lows(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * np.uint64(self.width)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        got = self.low[word] >> shift
        over = np.flatnonzero(shift + np.uint64(self.width) > np.uint64(64))
        got[over] |= self.low[word[over] + 1] << (np.uint64(64) - shift[over])
        return got & np.uint64((1 << self.width) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        """The values at positions ``i`` (each below n)."""
        i = np.asarray(i, np.int64)
        word = np.searchsorted(self.ones, i, side="right") - 1
        place = word * 64 + _select_in_word(self.high[word], i - self.ones[word])
        return ((place - i).astype(np.uint64) << np.uint64(self.width)) | self._lows(i)

    def _bucket(self, part: np.ndarray) -> np.ndarray:
        """How many values have a high part below ``part``."""
        zeros = np.arange(len(self.ones), dtype=np.int64) * 64 - self.ones
        last = zeros[-1]
        k = part - 1  # the zero that closes the bucket before
        inside = (k >= 0) & (k < last)
        kk = np.where(inside, k, 0)
        word = np.searchsorted(zeros, kk, side="right") - 1
        place = word * 64 + _select_in_word(~self.high[word], kk - zeros[word])
        return np.where(k < 0, 0, np.where(inside, place - kk, self.n))

    def find(self, values: np.ndarray) -> np.ndarray:
        """Position of the first value not below each given one (n if there is none)."""
        values = np.asarray(values, np.uint64)
        part = (values >> np.uint64(self.width)).astype(np.int64)
        low = values & np.uint64((1 << self.width) - 1)
        at = self._bucket(part)
        end = self._bucket(part + 1)
        open_ = np.flatnonzero(at < end)
        # Halve the ranges; buckets hold about one value, so this ends soon.
        left, right = at[open_], end[open_]
        while len(open_):
            mid = (left + right) // 2
            less = self._lows(mid) < low[open_]
            left = np.where(less, mid + 1, left)
            right = np.where(less, right, mid)
            done = left >= right
            at[open_[done]] = left[done]
            open_, left, right = open_[~done], left[~done], right[~done]
        return at


_MAGIC = b"TWARRAYS"


def _file_system(path: str):
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def write_arrays(folder: str, arrays: dict[str, np.ndarray]) -> str:
    """Write arrays to a new file in ``folder`` (any store that Arrow can reach); returns its path.

    The name is new each time, so a task that runs twice leaves two whole files, and the
    reader opens the one its task reported.
    """
    system, root = _file_system(folder)
    system.create_dir(root, recursive=True)
    name = f"{uuid.uuid4().hex}.arr"
    at, head = 0, {}
    for key, a in arrays.items():
        head[key] = [a.dtype.str, len(a), at]
        at += -(-a.nbytes // 8) * 8
    text = json.dumps(head).encode()
    text += b" " * (-(len(text) + 16) % 8)
    with system.open_output_stream(f"{root}/{name}") as out:
        out.write(_MAGIC + len(text).to_bytes(8, "little") + text)
        for a in arrays.values():
            out.write(np.ascontiguousarray(a).tobytes())
            out.write(b"\0" * (-a.nbytes % 8))
    return f"{folder}/{name}"


def map_arrays(path: str) -> dict[str, np.ndarray]:
    """The arrays of a file, mapped into memory; only the pages that are used get loaded.

    A file in a store that cannot be mapped is first copied to an unnamed local file,
    which goes away with the mapping.
    """
    system, place = _file_system(path)
    if isinstance(system, fs.LocalFileSystem):
        data = np.memmap(place, np.uint8, "r")
    else:
        with tempfile.TemporaryFile() as local, system.open_input_stream(place) as source:
            while block := source.read(1 << 22):
                local.write(block)
            local.flush()
            data = np.memmap(local, np.uint8, "r")
    if data[:8].tobytes() != _MAGIC:
        raise ValueError(f"not an array file: {path}")
    n = int.from_bytes(data[8:16].tobytes(), "little")
    head = json.loads(data[16 : 16 + n].tobytes())
    base = 16 + n
    return {
        key: data[base + at : base + at + np.dtype(kind).itemsize * size].view(np.dtype(kind))
        for key, (kind, size, at) in head.items()
    }
