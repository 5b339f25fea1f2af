"""Candle sequences: a pattern's blocks as the concrete partitions that a window may be cut into."""

from __future__ import annotations

from dataclasses import dataclass

from .ast import Block, Pattern

#: The greatest window where neither it nor the blocks have a bound, and the most partitions that are listed beforehand.
WINDOW = 500
PARTITIONS = 2_000
LETTERS = {"Up": "U", "Down": "D", "Neutral": "N", "Doji": "N", "Any": "."}


@dataclass(frozen=True)
class Partition:
    """length bars; letters: the candle of each, oldest first; blocks: (name, first, last) by place in the window."""

    length: int
    letters: str
    blocks: tuple[tuple[str, int, int], ...]


class TooMany(ValueError):
    """A pattern of more than PARTITIONS ways: they are found in each window's candles instead."""


def _sizes(block: Block, longest: int) -> list[int]:
    """The numbers of bars that a block may have. One that may be absent has none or its least; a block of other kinds than Any has 1 or more."""
    least = block.least if block.least or block.pattern == "Any" else 1
    own = range(least, (longest if block.most is None else min(longest, block.most)) + 1)
    return [0, *(n for n in own if n)] if block.optional else list(own)


def bounds(pattern: Pattern, windowsize: tuple[int, int | None] | None) -> tuple[int, int]:
    """The least and greatest number of bars of a window: without an end of its own it ends with its blocks, and if one of them has none, at WINDOW."""
    lo, hi = windowsize or (1, None)
    most = None if any(b.most is None for b in pattern.pattern) else sum(b.most for b in pattern.pattern)
    lo = max(1, lo)
    if hi is None:
        hi = max(lo, WINDOW if most is None else min(WINDOW, most))
    return lo, hi if most is None else min(hi, most)


def partitions(pattern: Pattern, windowsize: tuple[int, int | None] | None) -> list[Partition]:
    """All ways to cut a window into the pattern's blocks, shortest window first.

    A block that overlaps the next shares its last bar with it, which both must accept. An optional block
    may be absent. A pattern that can't fit a window has none; more than PARTITIONS ways are TooMany.
    """
    lo, hi = bounds(pattern, windowsize)
    found: dict[tuple[int, str, tuple], Partition] = {}

    def walk(k: int, letters: str, blocks: tuple, shares: bool) -> None:
        if k == len(pattern.pattern):
            if lo <= len(letters) <= hi:
                found.setdefault((len(letters), letters, blocks), Partition(len(letters), letters, blocks))
                if len(found) > PARTITIONS:
                    raise TooMany(f"pattern {pattern.name!r} has more than {PARTITIONS} partitions")
            return
        block = pattern.pattern[k]
        letter = LETTERS[block.pattern]
        rest = sum(max(0, (0 if b.optional else b.least) - (1 if b.allow_overlap_next else 0)) for b in pattern.pattern[k + 1 :])
        for n in _sizes(block, hi + 1 - rest):
            if not n:
                walk(k + 1, letters, blocks, False)
                continue
            joined, own = letters, n
            if shares and letters:
                both = letter if letters[-1] == "." else letters[-1] if letter in (".", letters[-1]) else None
                if both is None:
                    continue
                joined, own = letters[:-1] + both, n - 1
            first = len(letters) - 1 if shares and letters else len(letters)
            if len(joined) + own <= hi:
                walk(k + 1, joined + letter * own, (*blocks, (block.block_name, first, first + n - 1)), block.allow_overlap_next)

    if least_total(pattern) > hi:
        return []
    walk(0, "", (), False)
    return sorted(found.values(), key=lambda p: (p.length, [b[1:] for b in p.blocks]))


def least_total(pattern: Pattern) -> int:
    return sum(0 if b.optional else b.least for b in pattern.pattern) - sum(b.allow_overlap_next for b in pattern.pattern[:-1])


def longest(pattern: Pattern, windowsize: tuple[int, int | None] | None) -> int:
    """The bars of the longest window that a pattern may have."""
    try:
        return max((p.length for p in partitions(pattern, windowsize)), default=0)
    except TooMany:
        return bounds(pattern, windowsize)[1]


class Matcher:
    """The windows of a pattern that end with a string of candles, found in the string itself.

    Blocks are laid from the last candle back. Whether what is left of the blocks fits what is left of the candles
    is settled once for each block, place and bar shared, so no way is followed that can't be finished: the
    time is that of the table and of the windows found.
    """

    def __init__(self, pattern: Pattern, windowsize: tuple[int, int | None] | None):
        self.blocks, (self.lo, self.hi) = pattern.pattern, bounds(pattern, windowsize)

    def windows(self, codes: str) -> list[tuple[int, tuple[tuple[str, int, int], ...]]]:
        """(length, blocks) of each window, shortest first; blocks as in Partition."""
        n, blocks = len(codes), self.blocks
        letters = {b.pattern: LETTERS[b.pattern] for b in blocks}
        run: dict[str, list[int]] = {}  # for each end, how many candles up to it a kind accepts
        for kind, letter in letters.items():
            own = [0] * (n + 1)
            for k, c in enumerate(codes):
                own[k + 1] = own[k] + 1 if letter in (".", c) else 0
            run[kind] = own
        known: dict[tuple[int, int, bool], list[tuple[int, tuple]]] = {}

        def ways(k: int, end: int, lent: bool) -> list[tuple[int, tuple]]:
            """(start, blocks in reverse) for the blocks up to the k-th, of which the last ends before `end`; lent: the block after it is there."""
            if k < 0:
                return [(end, ())]
            key = k, end, lent
            if key in known:
                return known[key]
            block, out = blocks[k], []
            stop = end + 1 if lent and block.allow_overlap_next else end
            most = run[block.pattern][stop] if stop <= n else 0
            for size in _sizes(block, most):
                if not size:
                    # An absent block lends nothing: what stands before it ends where the next begins.
                    out += [(s, rest) for s, rest in ways(k - 1, end, False)]
                    continue
                first = stop - size
                out += [(s, ((block.block_name, first, stop - 1), *rest)) for s, rest in ways(k - 1, first, True)]
            known[key] = out
            return out

        found = set()
        for start, reverse in ways(len(blocks) - 1, n, False):
            length = n - start if not reverse else n - min(f for _, f, _ in reverse)
            if reverse and self.lo <= length <= self.hi:
                base = n - length
                found.add((length, tuple((name, f - base, z - base) for name, f, z in reversed(reverse))))
        return sorted(found, key=lambda w: (w[0], [b[1:] for b in w[1]]))
