"""Double-array tries over dense turn ids, and what is counted at their nodes."""

from __future__ import annotations

import numpy as np

# Places that are tried for a node's children before they go behind all others.
_TRIES = 32
_ROOT = -2


def dense_ids(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of each row among the distinct rows of ``keys``, and the first row of each number."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), dtype=bool)
    new[:1] = True
    for key in keys:
        new[1:] |= key[order][1:] != key[order][:-1]
    ids = np.empty(len(order), dtype=np.int64)
    ids[order] = np.cumsum(new) - 1
    return ids, order[new]


class Paths:
    """Paths of turn ids, each from one of some roots; steps are taken by all paths that are long enough."""

    def __init__(self, roots: np.ndarray, ids: np.ndarray, firsts: np.ndarray):
        self.roots, self.ids, self.firsts = roots, ids, firsts
        lengths = np.diff(firsts)
        self.order = np.argsort(-lengths, kind="stable")
        self.longest = int(lengths.max(initial=0))
        self.going = np.searchsorted(-lengths[self.order], -np.arange(self.longest), side="left")

    def step(self, number: int) -> tuple[np.ndarray, np.ndarray]:
        """The paths that have a turn of this number, and the places of their turns."""
        paths = self.order[: self.going[number]]
        return paths, self.firsts[paths] + number


class DoubleArray:
    """``check[base[s] + c] == s`` where state ``s`` has a child by turn id ``c``; roots are states 0, 1, ..."""

    def __init__(self, paths: Paths):
        self.n_roots = int(paths.roots.max(initial=-1)) + 1
        span = int(paths.ids.max(initial=0)) + 1
        at, parents, labels, count = paths.roots.copy(), [], [], self.n_roots
        cuts = [count]
        for number in range(paths.longest):
            own, places = paths.step(number)
            found, which = np.unique(at[own] * span + paths.ids[places], return_inverse=True)
            parents.append(found // span)
            labels.append(found % span)
            at[own] = count + which
            count += len(found)
            cuts.append(count)
        self._pack(np.concatenate([*parents, np.zeros(0, dtype=np.int64)]),
                   np.concatenate([*labels, np.zeros(0, dtype=np.int64)]), count)
        self.levels = [self.slot[a:b] for a, b in zip(cuts[:-1], cuts[1:])]

    def _pack(self, parent: np.ndarray, label: np.ndarray, count: int) -> None:
        """Parents come in rising order, so a node's children stand side by side."""
        first = np.searchsorted(parent, np.arange(count + 1))
        size = np.diff(first)
        self.slot = np.full(count, -1, dtype=np.int64)
        self.slot[: self.n_roots] = np.arange(self.n_roots)
        used = np.zeros(max(2 * count, 64), dtype=bool)
        used[: self.n_roots] = True
        start, end = np.zeros(count, dtype=np.int64), self.n_roots
        child = self.n_roots + np.arange(len(parent))
        low = self.n_roots
        several = np.flatnonzero(size > 1)
        for node in several[np.argsort(-size[several], kind="stable")]:
            own = label[first[node] : first[node + 1]]
            room = np.flatnonzero(~used[low : low + 8 * _TRIES])[:_TRIES] + low
            base = end - own[0]
            if len(room) == 0:
                low += 8 * _TRIES
            else:
                spots = room[:, None] - own[0] + own[None, : 64]
                fits = ~(used[np.minimum(spots, len(used) - 1)] & (spots < len(used))).any(axis=1)
                for fit in room[fits]:
                    spots = fit - own[0] + own
                    if not (used[np.minimum(spots, len(used) - 1)] & (spots < len(used))).any():
                        base = fit - own[0]
                        break
                else:
                    low = int(room[-1]) + 1
            spots = base + own
            if spots[-1] >= len(used):
                used = np.append(used, np.zeros(max(len(used), int(spots[-1]) + 1), dtype=bool))
            used[spots] = True
            end = max(end, int(spots[-1]) + 1)
            start[node] = base
            self.slot[child[first[node] : first[node + 1]]] = spots
        single = np.flatnonzero(size == 1)
        room = np.flatnonzero(~used)[: len(single)]
        room = np.append(room, len(used) + np.arange(len(single) - len(room)))
        self.slot[child[first[single]]] = room
        start[single] = room - label[first[single]]
        slots = int(self.slot.max(initial=0)) + 1
        self.base, self.check = np.zeros(slots, dtype=np.int64), np.full(slots, -1, dtype=np.int64)
        self.base[self.slot] = start
        self.check[self.slot[child]] = self.slot[parent]
        self.check[: self.n_roots] = _ROOT

    def walk(self, states: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The states that the given ones reach by the given turn ids."""
        to = self.base[states] + ids
        if not (self.check[to] == states).all():
            raise AssertionError("a path has left its trie")
        return to
