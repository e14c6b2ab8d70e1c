"""Bin completion over a histogram of item lengths.

Items of one length are alike, so the search works on counts: at most
``capacity`` lengths, whatever the number of items.  A solution is a list
of (filling, times), a filling being the (length, count) pairs of one bin.

Search: the incumbent is best-fit decreasing.  Branch and bound then takes
the largest item left, enumerates the undominated fillings of the space
beside it, least waste first, and prunes a branch when its waste cannot beat
the incumbent any more.  The sums that the shorter lengths can reach are kept
as bit sets, so the enumeration never enters a branch that ends above the
allowed waste.

The search is repeated with ever wider branches until the incumbent reaches
the volume bound.  The first rounds keep a few fillings per node and use one
as many times as the counts allow, which packs millions of items in as many
nodes as there are lengths; the last round keeps all undominated fillings and
uses one at a time, so when it ends the solution is optimal.  Every round has
a number of nodes to visit and of fillings to look at (``nodes``, ``ROUNDS``,
``LOOK``), after which the best solution so far stands.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np

Filling = tuple[tuple[int, int], ...]

#: Fillings looked at per node of a round, on average at most.
LOOK = 64
#: (fillings kept per node, use a filling as often as counts allow, share of ``nodes``) of each round.
ROUNDS = ((4, True, 1.0), (16, True, 0.25), (64, True, 0.25), (None, False, 0.5))


def bin_count(solution: list[tuple[Filling, int]]) -> int:
    return sum(times for _, times in solution)


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Filling, int]]:
    """Best-fit decreasing: each length goes to the fullest bins that take it, many bins at a time."""
    open_bins: dict[int, list[tuple[Filling, int]]] = {}
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            space = min((s for s in open_bins if s >= length), default=None)
            if space is None:
                per = min(capacity // length, left)
                times, rest = divmod(left, per)
                open_bins.setdefault(capacity - per * length, []).append((((length, per),), times))
                left = rest
                continue
            filling, times = open_bins[space].pop()
            if not open_bins[space]:
                del open_bins[space]
            per = min(space // length, left)
            use = min(times, left // per)
            if times > use:
                open_bins.setdefault(space, []).append((filling, times - use))
            open_bins.setdefault(space - per * length, []).append((filling + ((length, per),), use))
            left -= per * use
    return [b for group in open_bins.values() for b in group]


def _dominated(chosen: dict[int, int], waste: int, free: list[int], left: np.ndarray) -> bool:
    """Could a chosen item, or two together, be exchanged for one larger free item that still fits?"""
    spare = [x for x in free if left[x] > chosen.get(x, 0)]
    if spare and spare[0] <= waste:
        return True   # there is room for one more

    def swap(old: int, equal: bool) -> bool:
        k = bisect_right(spare, old + waste)
        return k > 0 and (spare[k - 1] >= old if equal else spare[k - 1] > old)
    items = list(chosen)
    pairs = {a + b for i, a in enumerate(items) for b in items[i:] if a != b or chosen[a] > 1}
    return any(swap(x, False) for x in items) or any(swap(p, True) for p in pairs)


def fillings(space: int, left: np.ndarray, waste_limit: int, keep: int | None = 4,
             look: list[int] | None = None) -> list[tuple[int, dict[int, int]]]:
    """Undominated fillings of ``space`` from ``left[length]`` items as (waste, counts), least waste first.

    ``keep`` bounds how many; it also bounds how many are looked at per waste, and takes a filling without
    waste as better than all with some.  None: all of them, as long as ``look`` (a counter that falls with
    every filling looked at) is above 0.
    """
    free = [int(x) for x in np.flatnonzero(left[:space + 1])]
    mask = (1 << (space + 1)) - 1
    reach = [1]   # reach[k]: bit set of the sums of the k shortest lengths
    for x in free:
        sums, n, step = reach[-1], min(int(left[x]), space // x), 1
        while n > 0:   # multiples of x by doubling
            use = step if step < n else n
            sums |= sums << use * x
            n -= use
            step *= 2
        reach.append(sums & mask)

    def exact(room: int, k: int, chosen: tuple) -> Iterator[tuple]:
        """Fillings of exactly ``room`` by the k shortest lengths, longest items first."""
        if room == 0:
            yield chosen
            return
        for j in range(bisect_right(free, room, 0, k) - 1, -1, -1):
            if not reach[j + 1] >> room & 1:
                return   # shorter lengths reach less
            x = free[j]
            for c in range(min(int(left[x]), room // x), 0, -1):
                if reach[j] >> (room - c * x) & 1:
                    yield from exact(room - c * x, j, chosen + ((x, c),))

    found: list[tuple[int, dict[int, int]]] = []
    for waste in range(min(waste_limit, space) + 1):
        if not reach[-1] >> (space - waste) & 1:
            continue
        for tried, chosen in enumerate(exact(space - waste, len(free), ())):
            if look is not None:
                look[0] -= 1
                if look[0] < 0:
                    return found
            filling = dict(chosen)
            if waste == 0 or not _dominated(filling, waste, free, left):
                found.append((waste, filling))
            if keep and (len(found) >= keep or tried >= 4 * keep):
                break
        if keep and (len(found) >= keep or (found and waste == 0)):
            break
    return found


def pack_counts(counts: dict[int, int], capacity: int, nodes: int | None = None) -> list[tuple[Filling, int]]:
    """Packing of ``counts[length]`` items of each length into as few bins as the search finds.

    ``nodes`` bounds the first round; by default it allows about two descents,
    one node using up a length or more (at most 2 * capacity + 1000).
    """
    counts = {x: n for x, n in counts.items() if n}
    nodes = 2 * len(counts) + 1000 if nodes is None else nodes
    bound = -(-sum(x * n for x, n in counts.items()) // capacity)
    best = best_fit(counts, capacity)
    for keep, bulk, share in ROUNDS:
        if bin_count(best) <= bound:
            break
        best = _descend(counts, capacity, best, bound, int(nodes * share), keep, bulk)
    return best


def _descend(counts: dict[int, int], capacity: int, best: list[tuple[Filling, int]], bound: int, nodes: int,
             keep: int | None, bulk: bool) -> list[tuple[Filling, int]]:
    """One round of the search: ``best``, or a better solution."""
    total = sum(x * n for x, n in counts.items())
    start = np.zeros(capacity + 1, np.int64)
    for x, n in counts.items():
        start[x] = n

    def unlink(chain) -> list[tuple[Filling, int]]:
        out = []
        while chain:
            out.append(chain[0])
            chain = chain[1]
        return out

    # depth first; a state is what is left, the bins so far (as a chain), their waste and the branches not yet tried
    stack = [[start, None, 0, None]]
    bins = bin_count(best)
    look = [LOOK * nodes]
    while stack and nodes > 0 and look[0] > 0 and bins > bound:
        state = stack[-1]
        left, chain, waste, branches = state
        allowed = (bins - 1) * capacity - total - waste   # waste that still beats the incumbent
        lengths = np.flatnonzero(left)
        if allowed < 0 or not len(lengths):
            stack.pop()
            if allowed >= 0:
                best = unlink(chain)
                bins = bin_count(best)
            continue
        top = int(lengths[-1])
        if branches is None:
            nodes -= 1
            left[top] -= 1
            branches = state[3] = fillings(capacity - top, left, allowed, keep, look)[::-1]
            left[top] += 1
        if not branches:
            stack.pop()
            continue
        room, chosen = branches.pop()
        whole = dict(chosen)
        whole[top] = whole.get(top, 0) + 1
        times = min(int(left[x]) // n for x, n in whole.items()) if bulk else 1
        if room:
            times = min(times, allowed // room)
        if times < 1:
            continue
        after = left.copy()
        for x, n in whole.items():
            after[x] -= n * times
        link = ((tuple(sorted(whole.items(), reverse=True)), times), chain)
        stack.append([after, link, waste + times * room, None])
    return best
