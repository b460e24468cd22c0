"""Byte pair merging of one pre-token, for use inside tasks."""

from __future__ import annotations

import heapq


def count_tokens(piece: bytes, ranks: dict[bytes, int]) -> int:
    """How many tokens a pre-token becomes.

    Always the neighbouring pair of least rank merges, the leftmost of equals. A heap
    keeps long runs from taking quadratic time.
    """
    n = len(piece)
    if piece in ranks or n < 2:
        return 1
    pairs = ((ranks.get(piece[i : i + 2]), i, i + 2) for i in range(n - 1))
    heap = [pair for pair in pairs if pair[0] is not None]
    if not heap:
        return n
    heapq.heapify(heap)
    ends = list(range(1, n + 1))  # end of the part that starts here
    before = list(range(-1, n - 1))  # start of the part before
    alive = [True] * n

    def offer(start: int) -> None:
        middle = ends[start]
        if middle < n:
            rank = ranks.get(piece[start : ends[middle]])
            if rank is not None:
                heapq.heappush(heap, (rank, start, ends[middle]))

    parts = n
    while heap:
        _, start, end = heapq.heappop(heap)
        if not alive[start]:
            continue
        middle = ends[start]
        # An offer is stale once either part has grown since.
        if middle >= n or ends[middle] != end:
            continue
        alive[middle] = False
        ends[start] = end
        if end < n:
            before[end] = start
        parts -= 1
        offer(start)
        if before[start] >= 0:
            offer(before[start])
    return parts
