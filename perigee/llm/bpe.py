"""Byte-pair merging of one word, shared by the token operators."""

from __future__ import annotations

import heapq
from collections.abc import Callable


def merge(symbols: list[str], rank: Callable[[str, str], float | None]) -> list[str]:
    """Merge adjacent symbols, lowest rank first and leftmost among equals, until no pair has a rank.

    A linked list and a heap keep words of any length at n log n.
    """
    n = len(symbols)
    if n < 2:
        return symbols
    part, after, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, part[i], part[i + 1]) for i in range(n - 1) if (r := rank(part[i], part[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if part[i] != a or j >= n or part[j] != b:
            continue  # one of the two has been merged meanwhile
        part[i], part[j] = a + b, ""
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (r := rank(part[i], part[k])) is not None:
                heapq.heappush(heap, (r, i, part[i], part[k]))
        if (h := before[i]) >= 0 and (r := rank(part[h], part[i])) is not None:
            heapq.heappush(heap, (r, h, part[h], part[i]))
    return [p for p in part if p]
