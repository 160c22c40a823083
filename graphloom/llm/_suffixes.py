"""Suffix sorting inside one group: bucket-pointer refinement over bytes, and suffix trees over words."""

from __future__ import annotations

import numpy as np

from graphloom.llm._hashing import run_starts

#: Bytes of the initial buckets: seven symbols of nine bits (0 is the end of a string) fill one 64-bit key.
Q = 7
_DONE = np.int32(1 << 30)


def string_classes(body: np.ndarray, size: np.ndarray, starts: np.ndarray, width: int, wave: int = 1 << 16) -> np.ndarray:
    """Class numbers of the ``width``-byte strings at ``starts``; equal numbers stand for equal strings, exactly.

    ``body`` is bytes of several strings laid end to end, ``size`` their lengths; every start has ``width`` bytes
    left in its own string.

    Bucket-pointer refinement: suffixes go to buckets by their first ``Q`` bytes.  A suffix's pointer is the first
    place of its bucket in the suffix array.  Buckets with several suffixes are taken in order, some at a time
    (``wave`` suffixes); their suffixes are sorted by the pointers of what stands as many bytes later as the bucket
    is deep, the bucket falls apart, its suffixes get new pointers at once, and what is still together is refined
    again before the next buckets have their turn.  So later buckets, and later steps of the same one, read
    pointers that are already refined: a step adds the depth of the pointers it reads, and a suffix whose later
    part has been settled is settled in one step.  A bucket of depth ``width`` is not sorted further.

    In the end equal strings are neighbours in the array, in one bucket or, where one string ends sooner, in
    several that share their first ``width`` bytes; neighbouring buckets are compared byte by byte.
    """
    pad = Q
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    count = len(size)
    # strings with ``pad`` end symbols after each
    symbols = np.zeros(total + pad * count + pad, np.uint64)
    shift = np.repeat(np.arange(count, dtype=np.int64) * pad, size)
    at = np.arange(total, dtype=np.int64) + shift
    symbols[at] = body.astype(np.uint64) + np.uint64(1)
    n = total + pad * count
    key = symbols[:n].copy()
    for k in range(1, Q):
        key <<= np.uint64(9)
        key |= symbols[k : n + k]
    # only the positions of bytes are suffixes; end symbols keep pointer 0, which is less than that of any suffix
    key = key[at]
    order = np.argsort(key)
    sorted_key = key[order]
    first = run_starts(sorted_key)
    sizes = np.diff(np.append(first, total))
    suffix = at[order]
    pointer = np.zeros(n + width + pad, np.int32)
    pointer[suffix] = np.repeat(first + 1, sizes).astype(np.int32)
    depth = np.full(n + width + pad, _DONE, np.int32)
    # a key with an end symbol in it tells the whole suffix
    depth[suffix] = np.where((sorted_key & np.uint64(0x1FF)) == 0, _DONE, np.int32(Q))
    del key, sorted_key, at, shift, symbols
    open_first = first[(sizes > 1) & (depth[suffix[first]] < width)]
    open_size = sizes[(sizes > 1) & (depth[suffix[first]] < width)]
    turn = 0
    while turn < len(open_first):
        upto = max(turn + 1, int(np.searchsorted(np.cumsum(open_size[turn : turn + wave]), wave, side="right")) + turn)
        # slots of the suffix array that this wave's buckets hold
        slots = np.repeat(open_first[turn:upto] - (np.cumsum(open_size[turn:upto]) - open_size[turn:upto]), open_size[turn:upto])
        slots = slots + np.arange(len(slots))
        turn = upto
        while len(slots):
            own = suffix[slots]
            deep = depth[own]
            later = own + deep
            rank = pointer[own].astype(np.uint64) << np.uint64(32) | pointer[later].astype(np.uint64)
            sort = np.argsort(rank)
            own, rank = own[sort], rank[sort]
            suffix[slots] = own
            begin = run_starts(rank)
            held = np.diff(np.append(begin, len(rank)))
            pointer[own] = np.repeat(slots[begin] + 1, held).astype(np.int32)
            deeper = np.minimum(deep[sort[begin]] + depth[later[sort[begin]]], _DONE)
            depth[own] = np.repeat(deeper, held)
            slots = slots[np.repeat((held > 1) & (deeper < width), held)]
    return _classes(body, ends, size, suffix, pointer, depth, starts, width, pad)


def _classes(body: np.ndarray, ends: np.ndarray, size: np.ndarray, suffix: np.ndarray, pointer: np.ndarray, depth: np.ndarray, starts: np.ndarray, width: int, pad: int) -> np.ndarray:
    """Classes of ``starts`` from the finished array: neighbours that share ``width`` bytes are in one class."""
    number = np.searchsorted(ends, starts, side="right")
    slot = pointer[starts + number * pad]
    order = np.argsort(slot, kind="stable")
    slot = slot[order]
    fresh = np.append(True, slot[1:] != slot[:-1])
    # strings of one bucket are equal as far as the bucket is deep, which for a start is ``width`` at least if there are several
    left, right = starts[order[np.flatnonzero(fresh)[:-1]]], starts[order[np.flatnonzero(fresh)[1:]]]
    same = np.arange(len(left))
    for k in range(0, width, 8):
        k = min(k, width - 8) if width >= 8 else k
        here = _word(body, left[same] + k, min(8, width)) == _word(body, right[same] + k, min(8, width))
        same = same[here]
        if not len(same):
            break
    where = np.flatnonzero(fresh)[1:]
    fresh[where[same]] = False
    out = np.empty(len(starts), np.int64)
    out[order] = np.cumsum(fresh)
    return out


def _word(body: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(len(at), np.uint64)
    for k in range(n):
        out |= body[at + k].astype(np.uint64) << np.uint64(8 * k)
    return out


class SuffixTree:
    """The suffix tree, down to ``width`` words, of the suffixes at ``starts`` of a sequence of word numbers.

    It is held as sorted suffixes and the common prefix lengths of neighbours; an internal node is an interval of
    neighbours that share at least its depth.
    """

    def __init__(self, words: np.ndarray, starts: np.ndarray, width: int):
        self.width = width
        # two word numbers to a sort key: the last words first, so that earlier ones decide
        order = np.arange(len(starts))
        for k in range((width - 1) // 2 * 2, -1, -2):
            pair = words[starts + k].astype(np.uint64) << np.uint64(32)
            if k + 1 < width:
                pair |= words[starts + k + 1].astype(np.uint64)
            order = order[np.argsort(pair[order], kind="stable")]
        self.order = order
        sorted_ = starts[order]
        self.common = np.zeros(max(0, len(starts) - 1), np.int32)
        same = np.arange(len(self.common))
        for k in range(width):
            same = same[words[sorted_[same] + k] == words[sorted_[same + 1] + k]]
            if not len(same):
                break
            self.common[same] = k + 1

    def nodes(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """(first, last + 1) in ``order`` of the internal nodes that are the topmost ones at ``depth`` or deeper."""
        deep = np.concatenate([[False], self.common >= depth, [False]])
        edge = np.flatnonzero(deep[1:] != deep[:-1])
        return edge[::2], edge[1::2] + 1
