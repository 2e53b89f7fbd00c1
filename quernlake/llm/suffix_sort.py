"""Order of byte windows by deep-shallow sorting, vectorised.

Multikey quicksort orders the windows to a shallow depth, eight bytes (one super-character) at a time and only among
windows that are still equal. Groups that share this long prefix are then ordered by blind tries: every window of a
group descends along its first member (the trie's path), the first byte in which they differ is its branch, and
windows on one branch form the next, smaller trie. All groups advance together, so a round is a few array operations.
"""

from __future__ import annotations

import numpy as np

#: Bytes that multikey quicksort orders before blind tries take over.
SHALLOW = 16
_EQUAL = 1 << 15


def _words(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as one big-endian number."""
    return np.ndarray((len(buf) - 7,), ">u8", buf, 0, (1,))[at].astype(np.uint64)


def _common(buf: np.ndarray, a: np.ndarray, b: np.ndarray, start: int, depth: int) -> np.ndarray:
    """Length of the common prefix of the windows at a and b, which agree up to ``start``; at most ``depth``."""
    out = np.full(len(a), depth, np.int16)
    todo = np.arange(len(a), dtype=np.int32)
    for at in range(start, depth, 8):
        at = min(at, depth - 8)  # the last word overlaps the one before it
        x = _words(buf, a[todo] + at) ^ _words(buf, b[todo] + at)
        differ = x != 0
        y = x[differ]
        same = np.zeros(len(y), np.int16)
        for k in range(1, 8):
            same += (y >> np.uint64(64 - 8 * k)) == 0
        out[todo[differ]] = at + same
        todo = todo[~differ]
    return out


def _changes(*arrays: np.ndarray) -> np.ndarray:
    new = np.ones(len(arrays[0]), bool)
    new[1:] = np.logical_or.reduce([a[1:] != a[:-1] for a in arrays])
    return new


def suffix_order(buf: np.ndarray, at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, new): ``at[order]`` sorts the windows of ``depth`` >= 8 bytes; ``new`` marks the first of each run of equal windows.

    Equal windows keep the order in which ``at`` lists them.
    """
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, bool)
    at = at.astype(np.int32)  # a buffer of windows is far below 2 GB
    w = _words(buf, at)
    order = np.argsort(w, kind="stable").astype(np.int32)
    new = _changes(w[order])
    del w
    shallow = max(8, min(SHALLOW, depth - depth % 8))
    for d in range(8, shallow, 8):
        single = new & np.append(new[1:], True)
        sub = np.flatnonzero(~single)
        if not len(sub):
            return order, new
        group = np.cumsum(new, dtype=np.int32)[sub]
        w = _words(buf, at[order[sub]] + d)
        perm = np.lexsort((w, group)).astype(np.int32)
        order[sub] = order[sub][perm]
        new[sub] = _changes(group, w[perm])
        del w, perm, group
    sub = np.flatnonzero(~(new & np.append(new[1:], True)))
    while len(sub) and shallow < depth:
        group = np.cumsum(new[sub], dtype=np.int32) - 1
        first = np.flatnonzero(new[sub])
        lead, own = at[order[sub[first]]][group], at[order[sub]]
        lcp = _common(buf, lead, own, shallow, depth)
        same = lcp >= depth
        clip = np.minimum(lcp, depth - 1)
        branch, stem = buf[own + clip], buf[lead + clip]
        del lead, own, clip
        # below the path the shallow branches come first, above it the deep ones
        lcp = lcp.astype(np.int32)
        key = np.where(same, np.int32(_EQUAL), np.where(branch < stem, lcp << 8, _EQUAL + ((depth + 1 - lcp) << 8)) + branch)
        del branch, stem, lcp
        perm = np.argsort((group.astype(np.int64) << 16) + key, kind="stable").astype(np.int32)
        order[sub] = order[sub][perm]
        group, key = group[perm], key[perm]
        new[sub] = _changes(group, key)
        left = (key != _EQUAL) & ~(new[sub] & np.append(new[sub][1:], True))
        sub = sub[left]
    return order, new


def window_classes(buf: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """For each place a number that windows of equal bytes share; numbers follow the order of the bytes."""
    order, new = suffix_order(buf, at, depth)
    out = np.zeros(len(at), np.int32)
    out[order] = np.cumsum(new, dtype=np.int32) - 1
    return out
