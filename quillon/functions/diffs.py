"""Shortest edit scripts between two lists of lines, in space linear in the lines: a helper for one pair of texts."""

from __future__ import annotations


def _middle(a: list[int], b: list[int]) -> tuple[int, int, int, int]:
    """A run (x, y) to (u, v), maybe empty, in the middle of a shortest script: searches from both ends meet there."""
    n, m = len(a), len(b)
    delta, odd = n - m, (n - m) % 2
    ahead, back = {1: 0}, {1: 0}
    for d in range((n + m + 1) // 2 + 1):
        for k in range(2 * max(0, d - m) - d, d - 2 * max(0, d - n) + 1, 2):
            x = ahead[k + 1] if k == -d or (k != d and ahead[k - 1] < ahead[k + 1]) else ahead[k - 1] + 1
            y = x - k
            u, v = x, y
            while u < n and v < m and a[u] == b[v]:
                u, v = u + 1, v + 1
            ahead[k] = u
            if odd and -(d - 1) <= delta - k <= d - 1 and u + back[delta - k] >= n:
                return x, y, u, v
        for k in range(2 * max(0, d - m) - d, d - 2 * max(0, d - n) + 1, 2):
            x = back[k + 1] if k == -d or (k != d and back[k - 1] < back[k + 1]) else back[k - 1] + 1
            y = x - k
            u, v = x, y
            while u < n and v < m and a[n - u - 1] == b[m - v - 1]:
                u, v = u + 1, v + 1
            back[k] = u
            if not odd and -d <= delta - k <= d and u + ahead[delta - k] >= n:
                return n - u, m - v, n - x, m - y
    raise AssertionError("unreachable")


def kept(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Positions (in a, in b), rising, of a longest common subsequence."""
    common = set(a) & set(b)
    number = {line: i for i, line in enumerate(sorted(common))}
    at, bt = [i for i, x in enumerate(a) if x in common], [i for i, x in enumerate(b) if x in common]
    x, y = [number[a[i]] for i in at], [number[b[i]] for i in bt]
    out, todo = [], [(0, len(x), 0, len(y))]
    while todo:
        i, j, p, q = todo.pop()
        while i < j and p < q and x[i] == y[p]:
            out.append((at[i], bt[p]))
            i, p = i + 1, p + 1
        while i < j and p < q and x[j - 1] == y[q - 1]:
            j, q = j - 1, q - 1
            out.append((at[j], bt[q]))
        if i < j and p < q:
            s, t, u, v = _middle(x[i:j], y[p:q])
            out += [(at[i + s + k], bt[p + t + k]) for k in range(u - s)]
            todo += [(i, i + s, p, p + t), (i + u, j, p + v, q)]
    return sorted(out)


def hunks(a: list[str], b: list[str]) -> list[tuple[int, int, int, int]]:
    """(a_from, a_to, b_from, b_to): what leaves and what comes, between the lines that stay."""
    out, i, p = [], 0, 0
    for j, q in [*kept(a, b), (len(a), len(b))]:
        if i < j or p < q:
            out.append((i, j, p, q))
        i, p = j + 1, q + 1
    return out
