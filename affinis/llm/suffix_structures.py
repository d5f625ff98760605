"""A suffix automaton and a suffix array, for the repeated passages of one shard.

Both answer the same question about a list of integer sequences: which windows of ``length`` units
are equal. Each returns, for every sequence, one class number per window start; equal windows, and
only those, have equal numbers.
"""

from __future__ import annotations

import numpy as np


class SuffixAutomaton:
    """Generalised over several sequences; a state stands for substrings with the same end positions."""

    def __init__(self) -> None:
        self.link, self.size, self.next = [-1], [0], [{}]

    def add(self, sequence: list[int]) -> None:
        link, size, step = self.link, self.size, self.next
        last = 0
        for unit in sequence:
            known = step[last].get(unit)
            if known is not None and size[known] == size[last] + 1:
                last = known
                continue
            if known is not None:
                last = self._split(last, known, unit)
                continue
            new = len(size)
            size.append(size[last] + 1)
            step.append({})
            link.append(0)
            p = last
            while p >= 0 and unit not in step[p]:
                step[p][unit] = new
                p = link[p]
            if p >= 0:
                q = step[p][unit]
                link[new] = q if size[q] == size[p] + 1 else self._split(p, q, unit)
            last = new

    def _split(self, p: int, q: int, unit: int) -> int:
        """A state for the substrings of ``q`` that are no longer than ``p`` and the unit."""
        link, size, step = self.link, self.size, self.next
        copy = len(size)
        size.append(size[p] + 1)
        step.append(dict(step[q]))
        link.append(link[q])
        link[q] = copy
        while p >= 0 and step[p].get(unit) == q:
            step[p][unit] = copy
            p = link[p]
        return copy

    def matches(self, sequence: list[int], length: int) -> list[int]:
        """Matching statistics of a stream against the shard, cut at ``length``.

        For each end position where at least ``length`` units match: the state of the last
        ``length`` of them, which no other substring of that length shares; otherwise -1.
        """
        link, size, step = self.link, self.size, self.next
        state, matched, out = 0, 0, []
        for unit in sequence:
            while state and unit not in step[state]:
                state = link[state]
                matched = size[state]
            follow = step[state].get(unit)
            if follow is not None:
                state, matched = follow, matched + 1
            while state and size[link[state]] >= length:
                state = link[state]
                matched = size[state]
            out.append(state if matched >= length else -1)
        return out


def automaton_classes(sequences: list[np.ndarray], length: int) -> list[np.ndarray]:
    """Classes by streaming every sequence through the automaton of all of them."""
    automaton = SuffixAutomaton()
    lists = [s.tolist() for s in sequences]
    for units in lists:
        automaton.add(units)
    return [np.array(automaton.matches(units, length)[length - 1 :], np.int64) for units in lists]


def suffix_array(text: list[int]) -> list[int]:
    """The order of all suffixes of ``text``, whose last unit must be its only smallest one.

    Grouping construction. Suffixes start out grouped by their first unit. Groups are taken in
    descending order; when all of a group's turn has come, its prefix is the Lyndon prefix of its
    suffixes. Each of its suffixes points to the nearest suffix before it in a lower group; the
    suffixes pointed at extend their prefix by the group's, so they leave their group for a new
    one just above it, those pointed at more often above those pointed at less. The second phase
    emits the groups from the lowest suffix on: the suffixes that a suffix closes, found along
    the same pointers, take the next places of their groups, in the order in which they come.
    """
    n = len(text)
    order = sorted(range(n), key=text.__getitem__)
    place, group, size = [0] * n, [0] * n, [0] * n  # of a suffix: its place and its group's first place; of a group: its size
    first = 0
    for at, suffix in enumerate(order):
        if at and text[suffix] != text[order[at - 1]]:
            first = at
        place[suffix], group[suffix] = at, first
        size[first] += 1
    before = [-1] * n
    end = n - 1
    while end >= 0:
        own = group[order[end]]
        members = sorted(order[own : end + 1])
        end = own - 1
        pointed: dict[int, int] = {}
        for suffix in members:
            j = suffix - 1
            while j >= 0 and group[j] >= own:
                j = before[j]
            before[suffix] = j
            if j >= 0:
                pointed[j] = pointed.get(j, 0) + 1
        if not pointed:
            continue
        by_count: dict[int, list[int]] = {}
        for suffix, count in pointed.items():
            by_count.setdefault(count, []).append(suffix)
        for count in sorted(by_count, reverse=True):
            moved: dict[int, list[int]] = {}
            for suffix in by_count[count]:
                moved.setdefault(group[suffix], []).append(suffix)
            for start, leaving in moved.items():
                top = start + size[start]
                new = top - len(leaving)
                if new == start:
                    continue  # the whole group extends its prefix and stays where it is
                for suffix in leaving:  # to the end of the group's places
                    top -= 1
                    at, other = place[suffix], order[top]
                    order[at], place[other] = other, at
                    order[top], place[suffix] = suffix, top
                size[start] -= len(leaving)
                size[new] = len(leaving)
                for suffix in leaving:
                    group[suffix] = new
    result = [-1] * n
    taken = [False] * n
    fill = list(range(n))  # the next place of the group that starts here
    last = n - 1
    result[0], taken[last] = last, True
    fill[group[last]] += 1
    for at in range(n):
        j = result[at] - 1
        while j >= 0 and not taken[j]:
            taken[j] = True
            spot = fill[group[j]]
            fill[group[j]] += 1
            result[spot] = j
            j = before[j]
    return result


def array_classes(sequences: list[np.ndarray], length: int) -> list[np.ndarray]:
    """Classes by the suffix array of all sequences: neighbours in it that agree in ``length`` units."""
    low = 2  # 0 ends the text, 1 ends a sequence
    text: list[int] = []
    for s in sequences:
        text += (s.astype(np.int64) + low).tolist()
        text.append(1)
    text.append(0)
    sizes = np.array([len(s) for s in sequences], np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    windows = np.maximum(0, sizes - length + 1)
    whole = np.full(len(text), False)
    for start, n in zip(starts, windows):
        whole[start : start + n] = True
    order = np.array(suffix_array(text), np.int64)
    order = order[whole[order]]
    classes = np.full(len(text), -1, np.int64)
    if len(order):
        units = np.array(text, np.int64)
        differs = np.zeros(len(order), bool)
        for offset in range(length):  # a unit at a time, to hold no matrix of all windows
            differs[1:] |= units[order[1:] + offset] != units[order[:-1] + offset]
        classes[order] = np.cumsum(differs)
    return [classes[start : start + n] for start, n in zip(starts, windows)]
