"""External induced sorting of suffixes, with common-prefix values.

The text is an array of small integers. The suffixes that start where a rise follows a fall (LMS
suffixes) are sorted first, by recursion; all others are induced from them in two sweeps over the
characters, up for suffixes larger than their successor and down for the smaller ones. What waits to
be induced stands in a priority queue: tuples (position, common prefix) ordered by first character
and then by arrival, which is the order of the suffixes. Queues keep a bounded amount in memory and
the rest in files. A tuple's common prefix with its neighbour in the queue is one more than the least
common prefix between the two tuples that induced them, which running minima and range minima give.

Recursion: the substrings between LMS positions are sorted by the same two sweeps, equal ones get
equal names, and the string of names is sorted in turn. A string of names that fits in memory is
sorted by doubling; a longer one is induced again, through a priority queue of single tuples.

Work is done block by block in arrays; nothing of the text's length is held in memory beyond
``memory`` tuples, arrays over that size being files too. Files live in a scratch folder of the task,
which is removed when the task ends; they are never shared, and a lost task starts afresh.
"""

from __future__ import annotations

import heapq
import shutil
import tempfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np

BLOCK = 1 << 16
INF = 65535
PAIR = np.dtype([("pos", np.int64), ("lcp", np.uint16)])


class Scratch:
    """Arrays and queues that turn into files beyond ``memory`` elements."""

    def __init__(self, memory: int = 1 << 24):
        self.memory, self._dir, self._n = memory, None, 0

    def path(self) -> str:
        if self._dir is None:
            self._dir = tempfile.mkdtemp(prefix="suffixes-")
        self._n += 1
        return str(Path(self._dir) / f"{self._n}")

    def array(self, n: int, dtype) -> np.ndarray:
        return np.zeros(n, dtype) if n <= self.memory else np.memmap(self.path(), dtype, "w+", shape=(n,))

    def close(self) -> None:
        if self._dir is not None:
            shutil.rmtree(self._dir, ignore_errors=True)
            self._dir = None


def paired(pos: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    out = np.empty(len(pos), PAIR)
    out["pos"], out["lcp"] = pos, lcp
    return out


def one(blocks: list[np.ndarray]) -> np.ndarray:
    """Blocks of tuples as one; as bytes, since joining arrays of tuples compares their types again and again."""
    return blocks[0] if len(blocks) == 1 else np.concatenate([b.view(np.uint8) for b in blocks]).view(PAIR)


class Queue:
    """A priority queue of (position, common prefix) by character and arrival, in memory and on disk.

    ``pop`` gives the next tuples of a character in order of arrival; those pushed meanwhile follow.
    ``backwards`` gives a character's tuples from the last to the first.
    """

    def __init__(self, scratch: Scratch, characters: int = 256):
        self.scratch = scratch
        self.blocks: list[list[np.ndarray]] = [[] for _ in range(characters)]
        self.files: list[list[tuple[str, int]]] = [[] for _ in range(characters)]
        self.held = 0

    def push(self, c: int, pos: np.ndarray, lcp: np.ndarray) -> None:
        self.add(c, paired(pos, lcp))

    def put(self, c: np.ndarray, head: np.ndarray, end: np.ndarray, pos: np.ndarray, lcp: np.ndarray) -> None:
        """Tuples ``head`` to ``end`` of those given, for each character of ``c``."""
        pairs = paired(pos, lcp)
        for own, a, b in zip(c.tolist(), head.tolist(), end.tolist(), strict=True):
            self.add(own, pairs[a:b].copy())

    def add(self, c: int, block: np.ndarray) -> None:
        self.blocks[c].append(block)
        self.held += len(block)
        if self.held > self.scratch.memory:
            self._spill()

    def _spill(self) -> None:
        """The characters with the most tuples in memory go to disk until half is left."""
        sizes = sorted(((sum(map(len, b)), c) for c, b in enumerate(self.blocks)), reverse=True)
        for size, c in sizes:
            if not size or self.held <= self.scratch.memory // 2:
                break
            name = self.scratch.path()
            one(self.blocks[c]).tofile(name)
            self.files[c].append((name, size))
            self.blocks[c] = []
            self.held -= size

    @staticmethod
    def _read(name: str, at: int, n: int) -> np.ndarray:
        return np.fromfile(name, PAIR, n, offset=at * PAIR.itemsize)

    def pop(self, c: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        while self.files[c] or self.blocks[c]:
            if self.files[c]:
                name, size = self.files[c].pop(0)
                for at in range(0, size, BLOCK):
                    block = self._read(name, at, min(BLOCK, size - at))
                    yield block["pos"], block["lcp"]
                Path(name).unlink()
                continue
            # join small blocks; what is pushed while they are worked on comes after them
            taken, self.blocks[c] = self.blocks[c], []
            block = one(taken)
            self.held -= len(block)
            for at in range(0, len(block), BLOCK):
                yield block["pos"][at : at + BLOCK], block["lcp"][at : at + BLOCK]

    def backwards(self, c: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for block in reversed(self.blocks[c]):
            for at in range(len(block), 0, -BLOCK):
                part = block[max(0, at - BLOCK) : at][::-1]
                yield part["pos"], part["lcp"]
        self.held -= sum(map(len, self.blocks[c]))
        self.blocks[c] = []
        for name, size in reversed(self.files[c]):
            for at in range(size, 0, -BLOCK):
                part = self._read(name, max(0, at - BLOCK), min(BLOCK, at))[::-1]
                yield part["pos"], part["lcp"]
            Path(name).unlink()
        self.files[c] = []


class Buckets:
    """The queue of a text whose tuples fit in memory: an array with as many places for a character as the text has of it.

    Tuples stay when they are popped, so that ``backwards`` gives them all.
    """

    def __init__(self, counts: np.ndarray):
        end = np.cumsum(counts)
        self.first = end - counts
        self.head, self.tail = self.first.copy(), self.first.copy()
        self.pos, self.lcp = np.empty(int(end[-1]), np.int32 if end[-1] < 1 << 31 else np.int64), np.empty(int(end[-1]), np.uint16)

    def put(self, c: np.ndarray, head: np.ndarray, end: np.ndarray, pos: np.ndarray, lcp: np.ndarray) -> None:
        to = np.arange(len(pos)) + np.repeat(self.tail[c] - head, end - head)
        self.pos[to], self.lcp[to] = pos, lcp
        self.tail[c] += end - head

    def pop(self, c: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        while self.head[c] < self.tail[c]:
            a = self.head[c]
            self.head[c] = b = min(self.tail[c], a + BLOCK)
            yield self.pos[a:b], self.lcp[a:b]

    def backwards(self, c: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for b in range(int(self.tail[c]), int(self.first[c]), -BLOCK):
            a = max(int(self.first[c]), b - BLOCK)
            yield self.pos[a:b][::-1], self.lcp[a:b][::-1]


class Inducer:
    """Takes suffixes in order and pushes their predecessors, with the common prefixes between them."""

    def __init__(self, text: np.ndarray, queue: Queue | Buckets, cap: int, characters: int = 256):
        self.text, self.queue, self.cap = text, queue, cap
        self.least = np.full(characters, INF, np.uint16)  # of the common prefixes since the last push
        self.begun = np.zeros(characters, bool)

    def feed(self, pos: np.ndarray, lcp: np.ndarray, chosen: np.ndarray, into: np.ndarray) -> None:
        """``lcp`` is that of each suffix with the one before it; ``chosen`` are those whose predecessor, of character ``into``, follows."""
        n = len(pos)
        table = np.empty((n.bit_length(), n), np.uint16)  # least of 1, 2, 4, ... in a row from each on
        table[0] = lcp
        for k in range(1, len(table)):
            half, width = 1 << (k - 1), n - (1 << k) + 1
            np.minimum(table[k - 1, :width], table[k - 1, half : half + width], out=table[k, :width])
        order = np.argsort(into, kind="stable")
        at, into = chosen[order], into[order]
        whole = np.uint16(lcp.min())
        if not len(at):
            np.minimum(self.least, whole, out=self.least)
            return
        head = np.append(True, into[1:] != into[:-1])
        start = np.flatnonzero(head)
        left = np.where(head, 0, np.append(0, at[:-1] + 1))
        low = self._range(table, left, at)
        first = into[head]
        low[head] = np.minimum(low[head], self.least[first])
        new = np.minimum(low.astype(np.int32) + 1, self.cap).astype(np.uint16)
        new[low == INF] = INF
        new[start[~self.begun[first]]] = 0
        np.minimum(self.least, whole, out=self.least)
        ends = np.append(start[1:], len(at))
        last = at[ends - 1]
        rest = np.full(len(last), INF, np.uint16)
        more = last + 1 < n
        rest[more] = self._range(table, last[more] + 1, np.full(int(more.sum()), n - 1))
        self.least[first], self.begun[first] = rest, True
        self.queue.put(first, start, ends, pos[at] - 1, new)

    @staticmethod
    def _range(table: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Least of lcp[left..right]."""
        level = np.frexp((right - left + 1).astype(np.float64))[1] - 1
        return np.minimum(table[level, left], table[level, right - np.left_shift(1, level) + 1])


def runs_at(text: np.ndarray, pos: int, most: int) -> int:
    """How often the character at ``pos`` repeats from there, up to ``most``."""
    part = np.asarray(text[pos : pos + most])
    other = np.flatnonzero(part != part[0])
    return int(other[0]) if len(other) else len(part)


def induced(text: np.ndarray, seeds: Queue, cap: int, scratch: Scratch) -> Iterator[tuple[np.ndarray, np.ndarray, int, bool]]:
    """All suffixes from the largest down: (positions, common prefix with the one before, character, whether smaller than the successor).

    ``seeds`` has the LMS suffixes in order, by character. The text ends before a smallest end mark.
    """
    n = len(text)
    counts = np.bincount(text, minlength=256) if n <= scratch.memory else None
    large = Queue(scratch) if counts is None else Buckets(counts)
    done = Queue(scratch) if counts is None else large
    up = Inducer(text, large, cap)
    up.feed(np.array([n]), np.zeros(1, np.uint16), np.zeros(1, np.int64), np.asarray(text[n - 1 : n]))
    for c in range(256):
        last = None
        for pos, lcp in large.pop(c):
            last = int(pos[-1])
            if done is not large:
                done.push(c, pos, lcp)
            before = text[np.maximum(pos - 1, 0)]
            chosen = np.flatnonzero((before >= c) & (pos > 0))
            up.feed(pos, lcp, chosen, before[chosen])
        for pos, lcp in seeds.pop(c):
            if last is not None:
                lcp = np.append(np.uint16(min(runs_at(text, last, cap), runs_at(text, int(pos[0]), cap))), lcp[1:])
                last = None
            before = text[np.maximum(pos - 1, 0)]
            chosen = np.flatnonzero(pos > 0)
            up.feed(pos, lcp, chosen, before[chosen])
    small = Queue(scratch) if counts is None else Buckets(counts)
    down = Inducer(text, small, cap)
    for c in range(255, -1, -1):
        last = None
        for pos, lcp in small.pop(c):
            last = int(pos[-1])
            before = text[np.maximum(pos - 1, 0)]
            chosen = np.flatnonzero((before <= c) & (pos > 0))
            down.feed(pos, lcp, chosen, before[chosen])
            yield pos, lcp, c, True
        carried = None  # an L tuple holds its common prefix with the smaller one: shift by one
        for pos, above in done.backwards(c):
            if carried is None:
                head = 0 if last is None else min(runs_at(text, last, cap), runs_at(text, int(pos[0]), cap))
            else:
                head = carried
            lcp = np.append(np.uint16(head), above[:-1])
            carried = int(above[-1])
            before = text[np.maximum(pos - 1, 0)]
            chosen = np.flatnonzero((before < c) & (pos > 0))
            down.feed(pos, lcp, chosen, before[chosen])
            yield pos, lcp, c, False


def lms_positions(text: np.ndarray, scratch: Scratch) -> np.ndarray:
    """Positions that begin a rise after a fall, ascending (the end mark not included)."""
    n = len(text)
    out = scratch.array(n // 2 + 1, np.int64)  # filled from its end; two positions are never neighbours
    first = len(out)
    after_char, after_small = -1, True  # the end mark: smallest
    step = 1 << 22
    for a in range((n - 1) // step * step, -1, -step):
        x = np.asarray(text[a : min(n, a + step)]).astype(np.int64)
        y = np.append(x[1:], after_char)
        settled = x != y
        small = x < y
        if not settled[-1]:
            small[-1], settled[-1] = after_small, True
        # equal neighbours share the type of the next settled one
        at = np.where(settled, np.arange(len(x)), len(x))
        nearest = np.minimum.accumulate(at[::-1])[::-1]
        small = small[nearest]
        follow = np.append(small[1:], after_small)
        hit = np.flatnonzero(~small & follow) + a + 1
        hit = hit[hit < n]
        out[first - len(hit) : first] = hit
        first -= len(hit)
        after_char, after_small = int(x[0]), bool(small[0])
    return out[first:]


def named(text: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """Names of the substrings between LMS positions, in their order, of a text in memory.

    A character counts with its type, the smaller suffix first; so no substring begins another. Six
    of them make a number; where numbers are equal and the substrings go on, the next six decide.
    """
    n, m, width = len(text), len(lms), 6
    y = np.append(text[1:].astype(np.int16), -1)
    settled = text != y
    small = text < y
    at = np.where(settled, np.arange(n, dtype=np.int32), n)
    small = small[np.minimum.accumulate(at[::-1])[::-1]]
    code = np.zeros(n + width, np.uint64)  # the end mark and what follows it: zero
    code[:n] = 2 * text.astype(np.uint64) + small + np.uint64(1)
    size = np.append(lms[1:] + 1, n + 1) - lms

    def number(own: np.ndarray, done: int) -> np.ndarray:
        out, start, left = np.zeros(len(own), np.uint64), lms[own] + done, size[own] - done
        for k in range(width):
            out = (out << np.uint64(10)) | np.where(left > k, code[np.minimum(start + k, n)], np.uint64(0))
        return out

    live, done = np.arange(m), 0
    rank = np.zeros(m, np.int64)  # the number of substrings that are smaller as far as they were read
    while len(live):
        value, old = number(live, done), rank[live]
        order = np.lexsort((value, old)) if done else np.argsort(value)
        value, old = value[order], old[order]
        fresh = np.append(True, old[1:] != old[:-1])
        place = np.arange(len(live))
        step = np.maximum.accumulate(np.where(np.append(True, value[1:] != value[:-1]) | fresh, place, 0))
        live = live[order]
        rank[live] = old + step - np.maximum.accumulate(np.where(fresh, place, 0))
        done += width
        alone = np.append(step[1:] != step[:-1], True) & (step == place)
        live = live[~alone & (size[live] > done)]
    return rank


def lcp_of(text: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    """Common prefix lengths of the suffixes at ``a`` and ``b``, up to ``cap``."""
    n = len(text)
    out = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    while len(live):
        x, y = a[live] + out[live], b[live] + out[live]
        inside = (x < n) & (y < n) & (out[live] < cap)
        live, x, y = live[inside], x[inside], y[inside]
        if not len(live):
            break
        same = np.zeros(len(live), np.int64)
        going = np.ones(len(live), bool)
        for k in range(8):
            going &= (x + k < n) & (y + k < n)
            going &= text[np.minimum(x + k, n - 1)] == text[np.minimum(y + k, n - 1)]
            if not going.any():
                break
            same += going
        out[live] += same
        live = live[same == 8]
    return np.minimum(out, cap)


def doubled(names: np.ndarray, depth: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Order of the suffixes of a string of names by their first ``depth`` names, and the ranks of each length 1, 2, 4, ..."""
    rank = np.unique(names, return_inverse=True)[1].astype(np.int64) + 1
    m, ranks, h = len(names), [], 1
    ranks.append(rank.astype(np.int32))
    while True:
        count = np.bincount(rank, minlength=m + 2)
        loose = np.flatnonzero(count[rank] > 1)
        if not len(loose) or h >= depth:
            break
        follow = np.zeros(len(loose), np.int64)
        inside = loose + h < m
        follow[inside] = rank[loose[inside] + h]
        key = rank[loose] * (m + 2) + follow
        order = np.argsort(key)
        key = key[order]
        own = rank[loose[order]]
        # ranks leave room: an element's rank is 1 + the number of smaller ones
        new_key = np.append(True, key[1:] != key[:-1])
        new_own = np.append(True, own[1:] != own[:-1])
        place = np.arange(len(order))
        within = np.maximum.accumulate(np.where(new_key, place, 0)) - np.maximum.accumulate(np.where(new_own, place, 0))
        if h == 1:
            base = np.append(0, np.cumsum(count))[:-1] + 1  # counts of smaller names, once
            rank = base[rank]
            own = base[own]
        rank = rank.copy()
        rank[loose[order]] = own + within
        h *= 2
        ranks.append(rank.astype(np.int32))
    return np.argsort(rank, kind="stable"), ranks


class TupleQueue:
    """A priority queue of single tuples of integers, in a heap and in sorted runs on disk."""

    def __init__(self, scratch: Scratch):
        self.scratch, self.heap, self.runs, self.width = scratch, [], [], 0

    def push(self, item: tuple[int, ...]) -> None:
        heapq.heappush(self.heap, item)
        if len(self.heap) > max(16, self.scratch.memory):
            half = len(self.heap) // 2
            self.heap.sort()
            stay, go = self.heap[:half], self.heap[half:]
            name = self.scratch.path()
            np.array(go, np.int64).tofile(name)
            run = self._run(name, len(go), len(item))
            heapq.heappush(self.runs, (next(run), len(self.runs), id(run), run))
            self.heap = stay

    def _run(self, name: str, n: int, width: int) -> Iterator[tuple[int, ...]]:
        for at in range(0, n, 4096):
            rows = np.fromfile(name, np.int64, min(4096, n - at) * width, offset=at * width * 8).reshape(-1, width)
            yield from map(tuple, rows.tolist())
        Path(name).unlink()

    def __bool__(self) -> bool:
        return bool(self.heap or self.runs)

    def peek(self) -> tuple[int, ...]:
        if self.runs and (not self.heap or self.runs[0][0] < self.heap[0]):
            return self.runs[0][0]
        return self.heap[0]

    def pop(self) -> tuple[int, ...]:
        if self.runs and (not self.heap or self.runs[0][0] < self.heap[0]):
            item, number, key, run = heapq.heappop(self.runs)
            follow = next(run, None)
            if follow is not None:
                heapq.heappush(self.runs, (follow, number, key, run))
            return item
        return heapq.heappop(self.heap)


def induced_names(names: np.ndarray, lms: np.ndarray, ordered: np.ndarray, scratch: Scratch) -> Iterator[int]:
    """The suffixes of a string of names, from the largest down, from its LMS suffixes in order."""
    m = len(names)
    large = TupleQueue(scratch)
    done = scratch.array(m, np.int64)
    count, seq, seed = 0, 0, 0
    large.push((int(names[m - 1]), seq, m - 1))
    while large or seed < len(ordered):
        if large and (seed >= len(ordered) or large.peek()[0] <= names[ordered[seed]]):
            c, _, i = large.pop()
            done[count] = i
            count += 1
            follows = i > 0 and names[i - 1] >= c
        else:
            i = int(ordered[seed])
            seed += 1
            follows = i > 0
        if follows:
            seq += 1
            large.push((int(names[i - 1]), seq, i - 1))
    small, seq, at = TupleQueue(scratch), 0, count - 1
    while small or at >= 0:
        if small and (at < 0 or -small.peek()[0] >= names[done[at]]):
            c, _, i = small.pop()
            follows = i > 0 and names[i - 1] <= -c
        else:
            i = int(done[at])
            at -= 1
            follows = i > 0 and names[i - 1] < names[i]
        if follows:
            seq += 1
            small.push((-int(names[i - 1]), seq, i - 1))
        yield i


def order_of_names(names: np.ndarray, depth: int, scratch: Scratch, base: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes of a string of names in order (and ranks by length, from a string that fits in memory)."""
    m = len(names)
    if m <= base:
        return doubled(np.asarray(names), depth)
    lms = lms_positions(names, scratch)
    ordered = lms
    if len(lms) > 1:
        # sort the substrings between LMS positions by the same sweeps, then name them
        waiting, start = TupleQueue(scratch), scratch.array(len(lms), np.int64)
        for a in range(0, len(lms), BLOCK):
            for i, own in zip(lms[a : a + BLOCK].tolist(), names[lms[a : a + BLOCK]].tolist(), strict=True):
                waiting.push((own, i))
        for k in range(len(lms)):
            start[k] = waiting.pop()[1]
        is_lms = scratch.array(m + 1, np.bool_)
        spot = scratch.array(m + 1, np.int64)
        for a in range(0, len(lms), BLOCK):
            is_lms[lms[a : a + BLOCK]] = True
            spot[lms[a : a + BLOCK]] = np.arange(a, min(len(lms), a + BLOCK))
        new = scratch.array(len(lms), np.int64)
        name, last = len(lms), None
        for i in induced_names(names, lms, start, scratch):
            if is_lms[i]:
                follow = int(spot[i]) + 1
                end = int(lms[follow]) if follow < len(lms) else m
                own = names[i : end + 1]
                if last is None or len(last) != len(own) or not np.array_equal(last, own):
                    name -= 1
                new[spot[i]] = name
                last = own
        order, ordered = order_of_names(new, depth, scratch, base)[0], scratch.array(len(lms), np.int64)
        for a in range(0, len(lms), BLOCK):
            ordered[a : a + BLOCK] = lms[order[a : a + BLOCK]]
    out = scratch.array(m, np.int64)
    at = m
    for i in induced_names(names, lms, ordered, scratch):
        at -= 1
        out[at] = i
    return out, []


def sorted_suffixes(text: np.ndarray, depth: int, scratch: Scratch, base: int = 1 << 23) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Suffixes of a byte text in descending order of their first ``depth`` bytes at least: positions, and the common prefix (to ``depth``) with the one before."""
    n = len(text)
    if n == 0:
        return
    lms = lms_positions(text, scratch)
    m = len(lms)

    def seeds(order: np.ndarray | None, lcp: np.ndarray | None) -> Queue:
        """LMS suffixes by character, in order (in that of the text and without common prefixes if not given)."""
        queue, seen = Queue(scratch), np.zeros(256, bool)
        for a in range(0, m, BLOCK):
            pos = np.asarray(lms[a : a + BLOCK] if order is None else lms[order[a : a + BLOCK]])
            value = np.full(len(pos), INF, np.uint16) if lcp is None else np.array(lcp[a : a + BLOCK])
            head = np.asarray(text[pos])
            for c in np.flatnonzero(np.bincount(head, minlength=1)).tolist():
                own = np.flatnonzero(head == c)
                if not seen[c]:
                    value[own[0]], seen[c] = 0, True
                queue.push(c, pos[own], value[own])
        return queue

    def swept_names() -> np.ndarray:
        """Names of the substrings between LMS positions: seeds of one character count as equal."""
        spot = scratch.array(n + 1, np.int32 if n < 1 << 31 else np.int64)
        for a in range(0, m, BLOCK):
            spot[lms[a : a + BLOCK]] = np.arange(a + 1, min(m, a + BLOCK) + 1)
        names = scratch.array(m, np.int64)
        name, fresh = m, True
        for pos, lcp, _, small in induced(text, seeds(None, None), INF - 1, scratch):
            if not small:
                low = int(lcp.min())
                fresh = fresh or low != INF
                continue
            at = spot[pos]
            hit = np.flatnonzero(at)
            breaks = np.append(0, np.cumsum(lcp != INF))
            if len(hit):
                steps = (breaks[hit + 1] - np.append(0, breaks[hit[:-1] + 1])) > 0
                steps[0] |= fresh
                falling = name - np.cumsum(steps)
                names[at[hit] - 1] = falling
                name = int(falling[-1])
                fresh = bool(breaks[-1] - breaks[hit[-1] + 1])
            else:
                fresh = fresh or bool(breaks[-1])
        return names

    if m > 1:
        names = named(np.asarray(text), lms) if n <= scratch.memory else swept_names()
        order, ranks = order_of_names(names, depth, scratch, base)
        lcp = neighbours(text, lms, order, ranks, depth, scratch)
    else:
        order, lcp = np.zeros(m, np.int64), np.zeros(m, np.uint16)
    for pos, common, _, _ in induced(text, seeds(order, lcp), depth, scratch):
        yield pos, common


def neighbours(text: np.ndarray, lms: np.ndarray, order: np.ndarray, ranks: list[np.ndarray], depth: int, scratch: Scratch) -> np.ndarray:
    """Common prefixes of LMS suffixes that follow each other in order."""
    m = len(order)
    out = scratch.array(m, np.uint16)
    for a in range(1, m, 1 << 20):
        x, y = order[a - 1 : a - 1 + (1 << 20)][: m - a], order[a : a + (1 << 20)]
        x = x[: len(y)]
        skip = np.zeros(len(y), np.int64)  # names in common, by ranks of halving lengths
        for k in range(len(ranks) - 1, -1, -1):
            i, j = x + skip, y + skip
            inside = np.maximum(i, j) < m
            same = np.zeros(len(y), bool)
            same[inside] = ranks[k][i[inside]] == ranks[k][j[inside]]
            skip += np.where(same, 1 << k, 0)
        skip = np.minimum(skip, m - 1 - np.maximum(x, y))
        gone = lms[x + skip] - lms[x]
        more = np.zeros(len(y), np.int64)
        short = np.flatnonzero(gone < depth)
        more[short] = lcp_of(text, lms[x[short] + skip[short]], lms[y[short] + skip[short]], depth)
        out[a : a + len(y)] = np.minimum(gone + more, depth)
    return out
