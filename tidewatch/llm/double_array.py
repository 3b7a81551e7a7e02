"""A level of a trie as a double array: from a state and a word to the next state, for arrays of them at once.

``base`` shifts a state's words into one shared array of slots; a slot belongs to a state if
``check`` names it. Words are numbered densely within the level, so slots lie close together.
"""

from __future__ import annotations

import numpy as np

_WINDOW = 512
_PATIENCE = 8


def build(states: np.ndarray, words: np.ndarray) -> dict[str, np.ndarray]:
    """From transitions in rising order of (state, word); the i-th transition leads to state i."""
    sources, source = np.unique(states, return_inverse=True)
    alphabet, code = np.unique(words, return_inverse=True)
    starts = np.append(np.flatnonzero(np.append(True, source[1:] != source[:-1])), len(source)) if len(source) else np.zeros(1, np.int64)
    each = np.diff(starts)
    used = np.zeros(2 * len(words) + 2 * len(alphabet) + _WINDOW, bool)
    base = np.zeros(len(sources), np.int64)
    low = 0
    for s in np.argsort(-each, kind="stable").tolist():
        if each[s] < 2:
            break
        own = code[starts[s] : starts[s + 1]]
        base[s], used, low = _place(own, used, low)
        used[base[s] + own] = True
    # States with one word fill the gaps.
    single = np.flatnonzero(each == 1)
    free = np.flatnonzero(~used)
    if len(free) < len(single):
        free = np.append(free, np.arange(len(used), len(used) + len(single)))
    own = code[starts[single]]
    base[single] = free[: len(single)] - own
    slot = base[source] + code
    size = int(slot.max()) + 1 if len(slot) else 0
    check, target = np.full(size, -1, np.int32), np.zeros(size, np.int32)
    check[slot] = source
    target[slot] = np.arange(len(source))
    return {"sources": sources, "alphabet": alphabet, "base": base, "check": check, "target": target}


def _place(own: np.ndarray, used: np.ndarray, low: int) -> tuple[int, np.ndarray, int]:
    """First shift at which all of a state's slots are free; the slots grow if need be."""
    at, tried = low, 0
    many = max(1, 65536 // len(own))
    while True:
        if at + _WINDOW + own[-1] >= len(used):
            used = np.append(used, np.zeros(len(used) + int(own[-1]), bool))
        shifts = np.flatnonzero(~used[at : at + _WINDOW]) + at - own[0]
        for a in range(0, len(shifts), many):
            fits = np.flatnonzero(~used[shifts[a : a + many, None] + own].any(1))
            if len(fits):
                return int(shifts[a + fits[0]]), used, low
        at, tried = at + _WINDOW, tried + 1
        if tried >= _PATIENCE:
            low = at


def step(level: dict[str, np.ndarray], states: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The next state of each (state, word); -1 if there is none."""
    sources, alphabet = level["sources"], level["alphabet"]
    if not len(sources):
        return np.full(len(states), -1, np.int64)
    source = np.minimum(np.searchsorted(sources, states), len(sources) - 1)
    code = np.minimum(np.searchsorted(alphabet, words), len(alphabet) - 1)
    slot = level["base"][source] + code
    known = (sources[source] == states) & (alphabet[code] == words) & (slot >= 0) & (slot < len(level["check"]))
    slot = np.where(known, slot, 0)
    known &= level["check"][slot] == source
    return np.where(known, level["target"][slot], -1).astype(np.int64)
