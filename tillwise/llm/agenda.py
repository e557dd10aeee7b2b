"""Merging of adjacent symbols in order of priority, as byte-pair vocabularies define it."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from heapq import heapify, heappop, heappush


def merge(symbols: list[str], ranks: Mapping, joined: bool = False) -> list[str]:
    """Merge neighbours until no pair is in ``ranks``; the smallest rank goes first, ties from the left.

    Keys of ``ranks`` are pairs of symbols or, with ``joined``, what two symbols make together.

    The agenda holds every adjacent pair that has a rank.  A merge makes up to two new pairs; entries whose
    symbols have changed since are recognised by their length and passed over.
    """
    size = len(symbols)
    if size < 2:
        return symbols
    rank = ranks.get
    parts: list[str | None] = list(symbols)
    before, after = list(range(-1, size - 1)), [*range(1, size), -1]
    agenda = []
    for left in range(size - 1):
        a, b = symbols[left], symbols[left + 1]
        order = rank(a + b if joined else (a, b))
        if order is not None:
            agenda.append((order, left, left + 1, len(a) + len(b)))
    heapify(agenda)
    while agenda:
        _, left, right, length = heappop(agenda)
        a, b = parts[left], parts[right]
        if a is None or b is None or len(a) + len(b) != length or after[left] != right:
            continue
        made = a + b
        parts[left], parts[right] = made, None
        follower = after[left] = after[right]
        if follower >= 0:
            before[follower] = left
            b = parts[follower]
            order = rank(made + b if joined else (made, b))
            if order is not None:
                heappush(agenda, (order, left, follower, length + len(b)))
        leader = before[left]
        if leader >= 0:
            a = parts[leader]
            order = rank(a + made if joined else (a, made))
            if order is not None:
                heappush(agenda, (order, leader, left, length + len(a)))
    return [part for part in parts if part is not None]


class Memo:
    """A bounded dictionary of two generations: what is asked for again outlives what is not."""

    def __init__(self, limit: int):
        self.limit, self.young, self.old = limit, {}, {}

    def ensure(self, keys: set, make: Callable[[list], list]) -> dict:
        """A dictionary that has all ``keys``; missing values come from one call of ``make``."""
        if len(self.young) + len(keys) > self.limit:
            self.young, self.old = {}, self.young
        young, old, missing = self.young, self.old, []
        for key in keys:
            if key not in young:
                if key in old:
                    young[key] = old[key]
                else:
                    missing.append(key)
        if missing:
            young.update(zip(missing, make(missing), strict=True))
        return young
