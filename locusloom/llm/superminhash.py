"""SuperMinHash signatures: one random permutation of the slots for every element.

Element e holds rank j + r(e, j) in the slot that comes j-th in its own permutation; a slot's value is the
least rank that any element holds there. Ranks of step j lie in [j, j + 1), so the steps are taken for all
elements at once, and a set is finished as soon as each of its slots is filled: later steps can't lower
anything. Large sets stop after the first or second step. Slots of one element are filled without
repetition, which gives these signatures their lower variance.
"""

from __future__ import annotations

import numpy as np

from locusloom.llm.words import mix

#: Elements whose permutations are held at a time.
BLOCK = 1 << 15


def _draw(elements: np.ndarray, step: int) -> np.ndarray:
    return mix(elements + np.uint64((2 * step + 1) * 0x9E3779B97F4A7C15 % 2**64))


def _least(table: np.ndarray, at: np.ndarray, values: np.ndarray) -> None:
    np.minimum.at(table, at, values)


def signatures(sets: list[np.ndarray], slots: int) -> np.ndarray:
    """One row of ``slots`` values per set: (step << 32) + random rank. Empty sets keep the greatest value."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    full = np.iinfo(np.uint64).max
    table = np.full(len(sets) * slots, full, dtype=np.uint64)
    if not sizes.sum():
        return table.reshape(len(sets), slots)
    with np.errstate(over="ignore"):
        elements = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), sizes)
        draw = _draw(elements, 0)
        _least(table, owner * slots + (draw % np.uint64(slots)).astype(np.int64), draw >> np.uint64(32))
        open_sets = np.flatnonzero((table.reshape(len(sets), slots) == full).any(axis=1) & (sizes > 0))
        ends = np.cumsum(sizes)
        group: list[int] = []
        held = 0
        for s in open_sets:
            if group and held + sizes[s] > BLOCK:
                _more_steps(table, group, elements, ends, sizes, slots)
                group, held = [], 0
            group.append(s)
            held += sizes[s]
        if group:
            _more_steps(table, group, elements, ends, sizes, slots)
    return table.reshape(len(sets), slots)


def _more_steps(table, group, elements, ends, sizes, slots) -> None:
    """Steps after the first, for sets with empty slots; each element's permutation is shuffled one place a step."""
    full = np.iinfo(np.uint64).max
    rows = np.concatenate([elements[ends[s] - sizes[s]:ends[s]] for s in group])
    owner = np.repeat(np.array(group), [sizes[s] for s in group])
    order = np.tile(np.arange(slots, dtype=np.uint16), (len(rows), 1))
    for step in range(slots):
        draw = _draw(rows, step)
        pick = step + (draw % np.uint64(slots - step)).astype(np.int64)
        at = np.arange(len(rows))
        slot = order[at, pick]
        order[at, pick] = order[:, step]
        if step:  # the first step was taken for all sets together
            _least(table, owner * slots + slot, (np.uint64(step) << np.uint64(32)) + (draw >> np.uint64(32)))
            unfinished = (table.reshape(-1, slots)[group] == full).any(axis=1)
            if not unfinished.any():
                return
            if unfinished.sum() * 2 < len(group):
                keep_sets = np.array(group)[unfinished]
                keep = np.isin(owner, keep_sets)
                rows, owner, order, group = rows[keep], owner[keep], order[keep], keep_sets.tolist()


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key per band of a signature's rows; a key also tells which band it is of."""
    n, slots = signature.shape
    rows = slots // bands
    with np.errstate(over="ignore"):
        key = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64)), (n, bands)).copy()
        for r in range(rows):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + signature[:, r * bands:(r + 1) * bands])
    return key.view(np.int64)
