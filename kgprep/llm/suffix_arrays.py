"""Suffix arrays by induced sorting, and permuted common prefixes, on numpy arrays in a task.

Suffixes are classified as smaller (S) or larger (L) than the next one; the
leftmost S positions of runs (LMS) cut the string into substrings, whose
ranks form a string of at most half the length that is sorted
recursively.  The order of all suffixes is then induced: read up to the
next LMS position, symbols with their types are a prefix-free code, so the code
and then the rank of that LMS suffix order the suffixes.  Both orders are
vector sorts of packed keys in place of the bucket scans of the sequential
algorithm.
"""

from __future__ import annotations

import numpy as np


def _classes(code, first, last):
    """Rank of the strings ``code[first:last + 1]``, which are a prefix-free set: the number of smaller ones.

    Each round appends as many symbols as fit in one integer to the strings
    that are neither finished nor alone in their class.
    """
    bits = max(1, int(code.max(initial=0) + 1).bit_length())
    take = max(1, (62 - max(1, len(first).bit_length())) // bits)
    ranks, at, active = np.zeros(len(first), first.dtype), first.copy(), np.arange(len(first), dtype=first.dtype)
    while len(active):
        key, place, stop = ranks[active].astype(np.int64), at[active], last[active]
        for _ in range(take):
            inside = place <= stop
            symbol = code[np.where(inside, place, 0)] + 1
            symbol[~inside] = 0
            key <<= bits
            key |= symbol
            place += 1
        at[active] = place
        del place, stop, inside, symbol
        order = np.argsort(key)
        key, sorted_active = key[order], active[order]
        del order
        other = np.append(True, key[1:] != key[:-1])
        del key
        old = ranks[sorted_active]
        index = np.arange(len(active), dtype=first.dtype)
        new = np.maximum.accumulate(np.where(other, index, 0))
        begin = np.maximum.accumulate(np.where(np.append(True, old[1:] != old[:-1]), index, 0))
        # members of a class are all active, so those before a string in its class are all smaller
        ranks[sorted_active] = old + new - begin
        del old, other, index, begin
        shared = np.append(new[1:] == new[:-1], False) | np.append(False, new[1:] == new[:-1])
        active = sorted_active[shared & (at[sorted_active] <= last[sorted_active])]
    return ranks


def narrow(x):
    """``x`` as 32-bit integers, if twice its numbers and its places fit: the arrays that are made of it take half the memory."""
    return x.astype(np.int32 if max(len(x), int(x.max(initial=0))) < 1 << 29 else np.int64, copy=False)


def suffix_array(x):
    """Start positions in the order of the suffixes of ``x``: non-negative
    integers of which the last is smaller than all others."""
    x = narrow(np.asarray(x))
    n = len(x)
    if n < 3:
        return np.argsort(x, kind="stable")
    # a suffix is smaller than the next one if the next different symbol is larger
    step = np.sign(np.diff(x))
    where = np.where(step != 0, np.arange(n - 1, dtype=x.dtype), x.dtype.type(n))
    following = np.minimum.accumulate(where[::-1])[::-1]
    smaller = np.append(step[np.minimum(following, n - 2)] > 0, True)
    del step, where, following
    begins = np.append(False, smaller[1:] & ~smaller[:-1])
    lms = np.nonzero(begins)[0].astype(x.dtype)
    code = 2 * x + smaller
    if len(lms) < 2:
        lms_rank = np.zeros(len(lms), np.int64)
    else:
        names = _classes(code, lms[:-1], lms[1:])
        used = np.zeros(len(names), bool)
        used[names] = True
        # the end marker is a substring of its own, the smallest
        names = np.append(np.cumsum(used)[names], 0)
        if used.all():
            lms_rank = names
        else:
            lms_rank = np.empty(len(lms), np.int64)
            lms_rank[suffix_array(names)] = np.arange(len(lms))
    ahead = np.cumsum(begins[:-1], dtype=x.dtype)
    key = _classes(code, np.arange(n - 1, dtype=x.dtype), lms[ahead]).astype(np.int64)
    del code
    key <<= max(1, int(len(lms)).bit_length())
    key |= lms_rank[ahead]
    del ahead
    order = np.argsort(key, kind="stable")
    return np.concatenate([np.array([n - 1], x.dtype), order.astype(x.dtype)])


def permuted_common_prefixes(x, order, block: int = 16):
    """(phi, plcp): for each position the suffix before it in the order, and the length of their common prefix.

    Where the symbols before a position and before its predecessor agree, the
    length is one less than at the position before; only the others
    (irreducible) are compared, ``block`` symbols at a time.
    """
    x, n = narrow(np.asarray(x)), len(x)
    phi = np.empty(n, x.dtype)
    phi[order[1:]] = order[:-1]
    phi[order[0]] = -1
    positions = np.arange(n, dtype=x.dtype)
    reducible = (positions > 0) & (phi > 0)
    reducible[1:] &= np.where(phi[1:] > 0, x[:-1] == x[phi[1:] - 1], False)
    # the predecessor of the position before must be the position before the predecessor
    reducible[1:] &= phi[:-1] == phi[1:] - 1
    todo = np.nonzero(~reducible & (phi >= 0))[0]
    plcp = np.zeros(n, x.dtype)
    padded = np.concatenate([x, np.full(block, -1, x.dtype)])
    steps = np.arange(block)
    while len(todo):
        alive = []
        for c in range(0, len(todo), 1 << 16):
            i = todo[c:c + (1 << 16)]
            a, b = np.minimum(i + plcp[i], n), np.minimum(phi[i] + plcp[i], n)
            same = padded[a[:, None] + steps] == padded[b[:, None] + steps]
            # the end marker differs from everything, so no comparison runs past it
            run = np.where(same.all(1), block, same.argmin(1))
            plcp[i] += run
            alive.append(i[run == block])
        todo = np.concatenate(alive)
    anchor = np.maximum.accumulate(np.where(reducible, 0, positions))
    return phi, np.maximum(0, plcp[anchor] - (positions - anchor))
