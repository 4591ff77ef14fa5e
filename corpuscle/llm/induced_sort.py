"""External induced sorting of suffixes, with common prefixes.

The order of all suffixes follows from the order of few: those that are smaller than their successor and follow a larger one (the leftmost
of a smaller run). These are named by the strings between them and sorted recursively. Then, going through symbols upwards, each suffix
taken from the queues puts its left neighbour, if that is larger than itself, behind the queue of the neighbour's first symbol; downwards
the same finds the rest. Queues have (symbol, order of insertion) as priority, hold tuples (place, common prefix with the tuple before) and
go to disk beyond a budget of tuples; what is taken comes in blocks, and numpy induces a block at a time.

The common prefix of two induced neighbours is one more than that of what induced them, which is the least of all common prefixes between
the two in the order they were taken: each block answers that with range minima, and a pending minimum for each symbol joins blocks.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

from corpuscle.llm.anchors import power_tables

BUDGET = 1 << 22
_FAR = np.int32(1 << 30)
#: Alphabets up to this size recurse by induction; larger ones are ranked by doubling.
FEW_SYMBOLS = 2048


class BucketQueues:
    """Priority queues of (symbol, insertion) that keep ``budget`` tuples in memory and the rest in an unnamed file."""

    def __init__(self, budget: int = BUDGET):
        self.budget, self.held, self.parts, self.file = budget, 0, {}, None

    def push(self, symbol: int, place: np.ndarray, common: np.ndarray) -> None:
        self.parts.setdefault(symbol, []).append((place, common))
        self.held += len(place)
        if self.held > self.budget:
            self._spill()

    def _spill(self) -> None:
        self.file = self.file or tempfile.TemporaryFile()
        self.file.seek(0, 2)
        for parts in self.parts.values():
            for i, (place, common) in enumerate(parts):
                if common is not None and len(place):
                    at, n = self.file.tell(), len(place)
                    self.file.write(place.astype(np.int64).tobytes())
                    self.file.write(common.astype(np.int32).tobytes())
                    parts[i] = ((at, n), None)
        self.held = 0

    def take(self, symbol: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks of a symbol's queue, first in first out, those pushed meanwhile included."""
        queue = self.parts.get(symbol, [])
        while queue:
            place, common = queue.pop(0)
            if common is None:
                at, n = place
                self.file.seek(at)
                place, common = np.frombuffer(self.file.read(8 * n), np.int64), np.frombuffer(self.file.read(4 * n), np.int32)
            else:
                self.held -= len(place)
            yield place, common

    def close(self) -> None:
        if self.file:
            self.file.close()


def range_minima(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """min(values[low : high + 1]) of each pair, by tables of doubling width built one at a time."""
    out = np.full(len(low), _FAR, np.int32)
    level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
    table, width = values, 1
    for k in range(int(level.max(initial=-1)) + 1):
        at = np.flatnonzero(level == k)
        if len(at):
            out[at] = np.minimum(table[low[at]], table[high[at] - width + 1])
        table = np.minimum(table[:-width], table[width:]) if len(table) > width else table
        width *= 2
    return out


class _Inducer:
    """One pass: puts left neighbours of one type behind the queues of their first symbols."""

    def __init__(self, text: np.ndarray, wanted: np.ndarray, symbols: int, queues: BucketQueues):
        self.text, self.wanted, self.queues = text, wanted, queues
        self.pending = np.full(symbols, _FAR, np.int32)
        self.seen = np.zeros(symbols, bool)

    def block(self, place: np.ndarray, common: np.ndarray) -> None:
        """Induce from suffixes in the order taken; ``common`` of each with the suffix taken before."""
        left = place - 1
        source = np.flatnonzero((place > 0) & self.wanted[left])
        rest = np.minimum.accumulate(common[::-1])[::-1]  # least from here to the end
        if len(source):
            target = self.text[left[source]].astype(np.int64)
            order = np.argsort(target, kind="stable")
            source, target = source[order], target[order]
            first = np.concatenate(([True], target[1:] != target[:-1]))
            before = np.where(first, -1, np.concatenate(([0], source[:-1])))
            least = range_minima(common, before + 1, source)
            starts = np.flatnonzero(first)
            ends = np.append(starts[1:], len(target))
            heads = target[starts]
            least[starts] = np.where(self.seen[heads], np.minimum(least[starts], self.pending[heads]), -1)
            self.pending = np.minimum(self.pending, rest[0])
            after = source[ends - 1] + 1
            self.pending[heads] = np.where(after < len(rest), rest[np.minimum(after, len(rest) - 1)], _FAR)
            self.seen[heads] = True
            places, common = left[source], np.minimum(least + 1, _FAR)
            for a, b, symbol in zip(starts.tolist(), ends.tolist(), heads.tolist(), strict=True):
                self.queues.push(symbol, places[a:b], common[a:b])
        else:
            self.pending = np.minimum(self.pending, rest[0])


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than its successor; the last one counts as such."""
    n = len(text)
    change = np.append(text[1:] != text[:-1], True)
    ahead = np.minimum.accumulate(np.where(change, np.arange(n), n)[::-1])[::-1]  # where each run of a symbol ends
    return np.where(ahead == n - 1, True, text[ahead] < text[np.minimum(ahead + 1, n - 1)])


class _Prefixes:
    """Common prefixes of suffixes of one text, by hashes of any width from running sums: two words a symbol, whatever the width."""

    def __init__(self, text: np.ndarray, cap: int):
        self.widths = [1 << k for k in range(cap.bit_length() - 1, -1, -1)]
        up, self.down = power_tables(len(text) + 1)
        mixed = (text.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(29)
        mixed *= up[: len(text)]
        self.sums = np.zeros(len(text) + 1, np.uint64)
        np.cumsum(mixed, out=self.sums[1:])

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Symbols that the suffixes at ``a`` and ``b`` share, counted to about twice the cap."""
        out = np.zeros(len(a), np.int64)
        last = len(self.sums) - 1
        for width in self.widths:
            i, j = a + out, b + out
            inside = np.flatnonzero(np.maximum(i, j) + width <= last)
            i, j = i[inside], j[inside]
            same = (self.sums[i + width] - self.sums[i]) * self.down[i] == (self.sums[j + width] - self.sums[j]) * self.down[j]
            out[inside[same]] += width
        return out


def _doubled(names: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes of ``names`` by their first ``depth`` symbols at least."""
    rank, step = names.astype(np.int64), 1
    order = np.argsort(rank, kind="stable")
    while step < depth:
        ahead = np.zeros_like(rank)
        ahead[:-step] = rank[step:] + 1
        key = rank * (int(rank.max()) + 2) + ahead
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        new = np.empty_like(rank)
        new[order] = np.concatenate(([0], np.cumsum(ranked[1:] != ranked[:-1])))
        rank = new
        step *= 2
        if int(rank.max()) == len(rank) - 1:
            break
    return order


def suffixes(text: np.ndarray, depth: int, budget: int = BUDGET) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of all suffixes of ``text`` in order, in blocks, each with its common prefix with the one before.

    ``text``: symbols from 0 on, of which 0 stands at its end only. The order is that of the first ``depth`` symbols at least, and common
    prefixes are exact below ``depth``.
    """
    n, symbols = len(text), int(text.max(initial=0)) + 1
    small = smaller_than_next(text)
    least = np.flatnonzero(small & np.concatenate(([False], ~small[:-1])))
    prefixes = _Prefixes(text, depth)

    # Names of the strings between the leftmost smaller suffixes; types break ties between a symbol's two kinds.
    if len(least) > 1:
        coded = (text.astype(">u4") * 2 + small).astype(">u4").tobytes()
        ends = np.append(least[1:], n - 1)
        strings = [coded[4 * a : 4 * b + 4] for a, b in zip(least.tolist(), ends.tolist(), strict=True)]
        number = {s: i for i, s in enumerate(sorted(set(strings)))}
        names = np.fromiter((number[s] for s in strings), np.int64, len(strings))
        del strings, coded
        if len(number) == len(names):
            order = np.argsort(names)
        elif len(number) <= FEW_SYMBOLS:
            inner = np.append(names + 1, 0)
            order = np.concatenate([p for p, _ in suffixes(inner, depth // 2 + 1, budget)])
            order = order[order < len(names)]
        else:
            order = _doubled(names, depth // 2 + 1)
        least = least[order]
    elif not len(least):
        least = np.array([n - 1])
    common = np.append(0, prefixes.common(least[:-1], least[1:])).astype(np.int32)
    first = text[least].astype(np.int64)
    bounds = np.searchsorted(first, np.arange(symbols + 1))
    present = np.flatnonzero(np.bincount(text, minlength=symbols)).tolist()
    direct = lambda a, b: np.int32(prefixes.common(np.array([a]), np.array([b]))[0])

    # Upwards: suffixes larger than their successor.
    up, larger = BucketQueues(budget), BucketQueues(budget)
    pass_up = _Inducer(text, ~small, symbols, up)
    for c in present:
        last = None
        for place, common_ in up.take(c):
            larger.push(c, place, common_)
            pass_up.block(place, common_)
            last = int(place[-1])
        a, b = bounds[c], bounds[c + 1]
        if b > a:
            part = common[a:b].copy()
            part[0] = 0 if last is None else direct(last, int(least[a]))
            pass_up.block(least[a:b], part)
    up.close()

    # Downwards: the others. A symbol's smaller-than-next suffixes come after its larger ones, so they are taken first.
    down, out = BucketQueues(budget), BucketQueues(budget)
    pass_down = _Inducer(text, small, symbols, down)
    for c in reversed(present):
        last = None
        for place, common_ in down.take(c):
            out.push(2 * c + 1, place, common_)
            pass_down.block(place, common_)
            last = int(place[-1])
        blocks = list(larger.take(c))
        if blocks:
            place, upward = np.concatenate([p for p, _ in blocks]), np.concatenate([x for _, x in blocks])
            out.push(2 * c, place, upward)
            back = np.empty(len(place), np.int32)
            back[1:] = upward[:0:-1]
            back[0] = 0 if last is None else direct(last, int(place[-1]))
            pass_down.block(place[::-1], back)
    down.close()
    larger.close()

    for c in present:
        last = None
        for place, upward in out.take(2 * c):
            last = int(place[-1])
            yield place, upward
        blocks = list(out.take(2 * c + 1))
        if c == 0:
            yield np.array([n - 1]), np.zeros(1, np.int32)
        elif blocks:
            place, downward = np.concatenate([p for p, _ in blocks])[::-1], np.concatenate([x for _, x in blocks])[::-1]
            upward = np.append(0, downward[:-1]).astype(np.int32)
            upward[0] = 0 if last is None else direct(last, int(place[0]))
            yield place, upward
    out.close()
