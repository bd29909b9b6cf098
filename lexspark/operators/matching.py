"""One-to-one matching by length as a flow of least cost between kinds of rows, not between rows."""

from __future__ import annotations

import heapq
from bisect import bisect_left, bisect_right

SLACK, OTHER_GROUP, UNMATCHED = 0.05, 10**4, 10**9

Kind = tuple[str | None, int, int]  # group, length, rows


def _dealt(left: list[list[int]], right: list[list[int]]) -> list[tuple[int, int, int]]:
    """(a, b, n): the numbers of [a, n] handed to those of [b, n] in order; both have one sum."""
    out, at = [], 0
    for a, n in left:
        while n:
            part = min(n, right[at][1])
            out.append((a, right[at][0], part))
            right[at][1] -= part
            n -= part
            at += not right[at][1]
    return out


def transport(cases: list[Kind], pool: list[Kind]) -> list[tuple[int, int, int]]:
    """(case kind, pool kind, pairs), by position: as many pairs within the caliper as there can be, and of these
    a choice of least cost: the gap, and OTHER_GROUP for a pair across groups. Kinds are distinct (group,
    length); a null group is like no other.

    Rows of a kind are alike, so a flow over kinds has the least cost that an assignment of rows has. Pairs
    within a group are arcs from kind to kind; those across groups run from kind to length to length to kind,
    so arcs number the pairs of kinds in a group and the pairs of lengths. Kinds enter one by one along a
    cheapest path of exchanges (Dijkstra's search over reduced costs), or stay unmatched at UNMATCHED.
    Numbers are whole, so costs are exact. Nodes in order: pool kinds, their lengths, cases' lengths, cases."""
    order = sorted(range(len(pool)), key=lambda j: (pool[j][0] is None, pool[j][0] or "", pool[j][1]))
    free, at = [pool[j][2] for j in order], [pool[j][1] for j in order]
    span: dict[str, tuple[int, int]] = {}
    for k, j in enumerate(order):
        if (g := pool[j][0]) is not None:
            span[g] = (span.get(g, (k, k))[0], k + 1)
    supply = [c[2] for c in cases]
    targets, sources = sorted(set(at)), sorted({n for _, n, _ in cases})
    lengths = len(pool)  # the first node of each sort
    tops = lengths + len(targets)
    first = tops + len(sources)
    length = [*at, *targets, *sources, *(n for _, n, _ in cases)]
    top_of = {n: tops + k for k, n in enumerate(sources)}

    def within(n: int, of: list[int], lo: int, hi: int) -> tuple[int, int]:
        most = max(1.0, SLACK * n)
        return bisect_left(of, n - most, lo, hi), bisect_right(of, n + most, lo, hi)

    ahead: list = [()] * len(pool) + [[] for _ in targets]
    for k, m in enumerate(at):
        ahead[lengths + bisect_left(targets, m)].append(k)
    for n in sources:
        lo, hi = within(n, targets, 0, len(targets))
        ahead.append(range(lengths + lo, lengths + hi))
    ahead += [range(*within(n, at, *span.get(g, (0, 0)))) for g, n, _ in cases]
    flow: list[dict[int, int]] = [{} for _ in range(first)]  # into a node, by the node before it
    price = [0] * len(length)
    for i, (g, n, _) in enumerate(cases):  # pairs of no cost
        k = bisect_left(at, n, *span.get(g, (0, 0)))
        if k < span.get(g, (0, 0))[1] and at[k] == n and (f := min(free[k], supply[i])):
            free[k] -= f
            supply[i] -= f
            flow[k][first + i] = f

    def enter(i: int) -> None:
        start = first + i
        best, end = UNMATCHED + price[start], start
        dist, came, settled, heap = {start: 0}, {}, [], [(0, start)]
        while heap:
            d, u = heapq.heappop(heap)
            if d >= best:
                break
            if dist[u] < d:
                continue
            settled.append((u, d))
            here, n = d + price[u], length[u]
            steps = [(v, abs(n - length[v])) for v in ahead[u]]
            if u >= first:
                steps.append((top_of[n], OTHER_GROUP))
            elif u >= tops:
                steps += [(v, -OTHER_GROUP) for v in flow[u]]
            else:
                steps += [(v, -abs(n - length[v])) for v in flow[u]]
            for v, c in steps:
                now = here + c - price[v]
                if now < best and (v not in dist or now < dist[v]):
                    dist[v], came[v] = now, u
                    heapq.heappush(heap, (now, v))
                    ends = now + price[v] + (UNMATCHED if v >= first else 0)
                    if (v >= first or v < lengths and free[v]) and ends < best:
                        best, end = ends, v
        for u, d in settled:
            price[u] += d - best
        path, v = [], end
        while v != start:
            path.append((came[v], v))
            v = came[v]
        # arcs run to lower nodes; a step to a higher one takes a flow back
        amount = min([supply[i], *([free[end]] if end < lengths else []), *(flow[u][v] for u, v in path if v > u)])
        for u, v in path:
            if v < u:
                flow[v][u] = flow[v].get(u, 0) + amount
            elif flow[u][v] == amount:
                del flow[u][v]
            else:
                flow[u][v] -= amount
        if end < lengths:
            free[end] -= amount
        supply[i] -= amount

    for i in sorted(range(len(cases)), key=lambda i: cases[i][1]):
        while supply[i]:
            enter(i)
    out = [(u - first, order[k], f) for k in range(lengths) for u, f in flow[k].items() if u >= first]
    # flows across groups: from cases through their length to pool lengths, from there to the kinds
    met: dict[int, list[list[int]]] = {}
    for top in range(tops, first):
        taken = [[v, flow[v][top]] for v in ahead[top] if top in flow[v]]
        for u, v, f in _dealt([list(x) for x in flow[top].items()], taken):
            met.setdefault(v, []).append([u - first, f])
    for v, left in met.items():
        out += [(i, order[k], f) for i, k, f in _dealt(left, [[k, flow[k][v]] for k in ahead[v] if v in flow[k]])]
    return sorted(out)
