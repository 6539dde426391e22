"""Substring dedup: near-duplicate passages through compact windows of token min-hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.common import U64, Words, flat, forget, materialise, mix, numbered_rows, slices, table
from graphloom.llm.components import connected_components

SHINGLE = 5
#: shingles on either side of a window's smallest value; half of AHEAD
CONTEXT = 9
#: equal shingles in a row about the smallest value from which on words put in or left out are looked for
AHEAD = 18
#: how far the two parts of a passage may be shifted against each other by words put in or left out
SHIFT = 6
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=U64)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def shingles(hashes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every run of five words."""
    n = len(hashes) - SHINGLE + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = hashes[:n] * _FACTORS[0]
    for i in range(1, SHINGLE):
        out += hashes[i : i + n] * _FACTORS[i]
    return mix(out)


def _extremes(x: np.ndarray, size: int, low: bool) -> np.ndarray:
    """The least (or greatest) of every size values in a row, by running extremes of blocks from either end."""
    pick, n = (np.minimum, len(x)) if low else (np.maximum, len(x))
    padded = np.full(-(-n // size) * size, np.iinfo(x.dtype).max if low else 0, dtype=x.dtype)
    padded[:n] = x
    blocks = padded.reshape(-1, size)
    ahead = pick.accumulate(blocks, axis=1).ravel()
    behind = pick.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(behind[: n - size + 1], ahead[size - 1 : n])


def compact_windows(x: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(c, l, r) of every node of the Cartesian tree over x whose subtree spans at least least places.

    Any run of least places or more within [l, r] that holds c has its smallest value at c. Zeros are walls,
    which no window crosses. A node's span is that large just if it is the least of some run of least places,
    and so are all nodes above it; so running extremes find the nodes, and a stack over these few, about
    2 / least of all, finds their spans. Of equal values the leftmost is the smaller."""
    none = np.zeros(0, np.int64)
    if len(x) < least:
        return none, none, none
    runs = _extremes(x, least, True)
    wall = np.zeros(least - 1, x.dtype)
    nodes = np.flatnonzero((_extremes(np.concatenate([wall, runs, wall]), least, False) == x) & (x > 0))
    places = np.sort(np.concatenate([nodes, np.flatnonzero(x == 0)]))
    at, values = places.tolist(), x[places].tolist()
    left, right = [0] * len(at), [len(x) - 1] * len(at)
    stack: list[int] = []
    for i, v in enumerate(values):
        while stack and values[stack[-1]] > v:
            right[stack.pop()] = at[i] - 1
        left[i] = at[stack[-1]] + 1 if stack else 0
        stack.append(i)
    l, r = np.array(left), np.array(right)
    keep = (x[places] > 0) & (r - l + 1 >= least)
    return places[keep], l[keep], r[keep]


def _signatures(own: np.ndarray, f: int) -> np.ndarray:
    """Shingles under hash function f, which the lowest four bits name; never zero."""
    return (mix(own ^ mix(np.array([f + 1], U64))) & ~U64(15)) | U64(f + 1)


class _Runs:
    """Hashes of runs of a sequence, from sums of its values times powers: of any run in a few steps."""

    def __init__(self, x: np.ndarray):
        powers = np.full(len(x) + 1, _BASE, U64)
        powers[0] = 1
        self.back = np.full(len(x) + 1, _INVERSE, U64)
        self.back[0] = 1
        powers, self.back = np.multiply.accumulate(powers), np.multiply.accumulate(self.back)
        self.sums = np.zeros(len(x) + 1, U64)
        np.cumsum(x * powers[:-1], out=self.sums[1:])

    def hash(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Of x[low:high]."""
        return mix((self.sums[high] - self.sums[low]) * self.back[low] + (high - low).astype(U64))


_SIDES = ("before", "after", "far_before", "far_after")
_WINDOW = "key long, row long, at int, left byte, right byte, before short, after short, far_before short, far_after short, whole long, other long, other_at int"


def _stretches(least: int) -> list[tuple[int, int]]:
    """Stretches of places about a window's smallest value, as _SIDES names them: spans that share a passage agree in one at least.

    Of least = 46 places or more and similarity 0.8 or more. A changed word takes five equal places in a row or more, and a run of 46 to 53 places may
    lack five, of 90 ten. If the equal places about the middle go on for CONTEXT to one side, these agree. If not, the run lies to one
    side of the middle for the greatest part: at most 8 equal places, at most 6 unequal ones, then equal ones to
    its end, 37 places or more from the middle; or it is of 90 places, with equal ones from the 15th on at either side.
    With words put in or left out AHEAD equal places are asked for, of which CONTEXT are to one side."""
    return [(-CONTEXT, 0), (0, CONTEXT), (CONTEXT - least, -CONTEXT - 8), (CONTEXT + 8, least - CONTEXT)]


def _sure(least: int, similarity: float) -> bool:
    """Whether _stretches() holds; else all windows of a signature meet."""
    return least == 46 and similarity >= 0.8


def _next_rows(first: np.ndarray, row: np.ndarray) -> np.ndarray:
    """At the first of each run of equal windows, sorted by row, the next row that has one; else -1."""
    also = np.full(len(row), -1, np.int64)
    tied = np.flatnonzero(row != row[first])[::-1]
    also[first[tied]] = row[tied]  # the last one written is the smallest
    return also


def _flushed(columns: list[np.ndarray]) -> pa.RecordBatch:
    """Windows, of which those equal in key and whole to one of an earlier row name it (other, other_at); that one names the next row that has it, at place -1."""
    key, row, at, whole = columns[0], columns[1], columns[2], columns[-1]
    order = np.lexsort((at, row, whole, key))
    columns = [c[order] for c in columns]
    key, row, at, whole = columns[0], columns[1], columns[2], columns[-1]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (whole[1:] != whole[:-1])
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    tied = row != row[first]
    keep = tied | new
    also = _next_rows(first, row)
    some = (tied | (also >= 0))[keep]
    other = [pa.array(x[keep], mask=~some) for x in (np.where(tied, row[first], also), np.where(tied, at[first], np.int32(-1)).astype(np.int32))]
    return pa.RecordBatch.from_arrays([*(pa.array(c[keep]) for c in columns), *other], names=[f.split()[0] for f in _WINDOW.split(", ")])


def _windows(hashes: int, least: int, sure: bool, most: int = 400_000):
    """Batches of (row, text) to the compact windows of every hash function: signature, row, place, reach, and hashes of what lies around.

    left, right: how far runs of least places that hold the place can go; whole: of all shingles between them;
    before to far_after: of the stretches about it (0: the text ends there, or they aren't sure). Equal windows met
    in one task name the first of them, so that copies don't meet again at their key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0
        for batch in batches:
            for part, raw, offsets in slices(batch, "text"):
                words = Words(raw, offsets)
                n = max(len(words.row) - SHINGLE + 1, 0)
                inside = words.row[:n] == words.row[SHINGLE - 1 :] if n else np.zeros(0, bool)
                row = words.row[:n][inside]
                if not len(row):
                    continue
                own = shingles(words.hashes)[inside]
                fresh = np.diff(row, prepend=-1) > 0
                place = np.arange(len(row)) + np.cumsum(fresh)  # a wall before each row's shingles
                rows = np.asarray(part.column("row"))
                row_at, x = np.full(place[-1] + 2, -1), np.zeros(place[-1] + 2, U64)
                row_at[place], x[place] = row, own
                begin = np.zeros(part.num_rows, np.int64)
                begin[row[fresh]] = place[fresh]
                runs = _Runs(x)
                for f in range(hashes):
                    signs = np.zeros(len(x), U64)
                    signs[place] = _signatures(own, f)
                    c, l, r = compact_windows(signs, least)
                    l, r = np.maximum(l, c - least + 1), np.minimum(r, c + least - 1)
                    d, around = row_at[c], []
                    for low, high in _stretches(least) if sure else []:
                        low, high = np.clip(c + low, 0, len(x) - 1), np.clip(c + high, 0, len(x) - 1)  # walls at both ends
                        held_by = (row_at[low] == d) & (row_at[high] == d)
                        around.append(np.where(held_by, runs.hash(low, high + 1).astype(np.uint16) | np.uint16(1), np.uint16(0)).view(np.int16))
                    around = around or [np.zeros(len(c), np.int16)] * len(_SIDES)
                    held.append([signs[c].view(np.int64), rows[d], (c - begin[d]).astype(np.int32), (c - l).astype(np.int8), (r - c).astype(np.int8), *around, runs.hash(l, r + 1).view(np.int64)])
                    size += len(c)
                if size > most:
                    yield _flushed([np.concatenate(c) for c in zip(*held, strict=True)])
                    held, size = [], 0
        if held:
            yield _flushed([np.concatenate(c) for c in zip(*held, strict=True)])

    return run


def _whole_groups(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[pa.RecordBatch, bool]]:
    """Batches sorted by key, cut anew so that no key is in two of them; a key of over most rows comes alone and in parts, which the second value tells."""
    held: list[pa.RecordBatch] = []
    own, cut = None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.asarray(batch.column("key"))
        if own is not None and key[0] == own:
            if key[-1] == own:
                held.append(batch)
                if sum(b.num_rows for b in held) > most:
                    yield pa.concat_batches(held), True
                    held, cut = [], True
                continue
            if cut:
                low = int(np.searchsorted(key, own, side="right"))
                yield pa.concat_batches([*held, batch.slice(0, low)]), True
                held, batch = [], batch.slice(low)
        elif held:
            yield pa.concat_batches(held), cut
            held = []
        batch = pa.concat_batches([*held, batch])
        key = np.asarray(batch.column("key"))
        start = int(np.searchsorted(key, key[-1]))
        if start:
            yield batch.slice(0, start), False
        held, own, cut = [batch.slice(start)], key[-1], False
    if held:
        yield pa.concat_batches(held), cut


_MET = "key long, a long, a_at int, left byte, right byte, b long, b_at int, sides byte, also long"


def _several(*columns: np.ndarray) -> np.ndarray:
    """Which rows agree with another one in all columns."""
    order = np.lexsort(columns)
    same = np.logical_and.reduce([c[order][1:] == c[order][:-1] for c in columns])
    out = np.zeros(len(order), bool)
    out[order[1:]] = same
    out[order[:-1]] |= same
    return out


def _meet(most: int, large: int, sure: bool):
    """Windows by signature: those that are equal as wholes are tied to the first of them, which is tied to itself; the different ones go on if they agree with another one in some stretch.

    sides: of a signature with over large different windows, or over most in all, the stretches in which they agree, as bits; else 0. also: the next row that has an equal window, or -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def plain() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                known = pc.fill_null(pc.greater_equal(batch.column("other_at"), 0), False)
                if pc.any(known).as_py():
                    tied.append(batch.filter(known))
                    batch = batch.filter(pc.invert(known))
                yield batch

        def sent(batch: pa.RecordBatch, rows: np.ndarray, b: pa.Array, b_at: pa.Array, sides: np.ndarray, also: np.ndarray) -> pa.RecordBatch:
            some = [batch.column(c).take(pa.array(rows)) for c in ("key", "row", "at", "left", "right")]
            return pa.RecordBatch.from_arrays([*some, b, b_at, pa.array(sides.astype(np.int8)), pa.array(also)], names=[f.split()[0] for f in _MET.split(", ")])

        def tie(batch: pa.RecordBatch, rows: np.ndarray, b: pa.Array, b_at: pa.Array) -> pa.RecordBatch:
            return sent(batch, rows, b, b_at, np.zeros(len(rows)), np.full(len(rows), -1, np.int64))

        def spent() -> Iterator[pa.RecordBatch]:
            for batch in tied:
                yield tie(batch, np.arange(batch.num_rows), batch.column("other"), batch.column("other_at"))
            tied.clear()

        tied: list[pa.RecordBatch] = []
        for batch, part in _whole_groups(plain(), most):
            yield from spent()
            key, row, whole, at = (np.asarray(batch.column(c)) for c in ("key", "row", "whole", "at"))
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (whole[1:] != whole[:-1])
            first = np.flatnonzero(new)[np.cumsum(new) - 1]
            copies = np.flatnonzero(row != row[first])
            if len(copies):
                yield tie(batch, copies, pa.array(row[first[copies]]), pa.array(at[first[copies]]))
            own = np.flatnonzero(new)
            also = np.stack([np.asarray(pc.fill_null(batch.column("other"), -1)), _next_rows(first, row)])[:, own].view(U64).min(axis=0).view(np.int64)  # -1 is the greatest
            known = also >= 0
            yield tie(batch, own[known], pa.array(row[own[known]]), pa.array(at[own[known]]))
            key = key[own]
            starts = np.flatnonzero(np.diff(key, prepend=key[0] ^ 1))
            sizes = np.diff(starts, append=len(key))
            sides = np.zeros(len(key), np.int64)
            if sure:
                for k, name in enumerate(_SIDES):
                    side = np.asarray(batch.column(name))[own]
                    sides |= np.where((side != 0) & (part or _several(side, key)), 1 << k, 0)
                go = sides > 0
                sides[~(np.repeat(sizes > large, sizes) | part)] = 0
            else:
                go = np.repeat(sizes > 1, sizes) | part
            none = pa.nulls(int(go.sum()), pa.int64())
            yield sent(batch, own[go], none, none.cast(pa.int32()), sides[go], also[go])
        yield from spent()

    return run


_SPAN = "key long, row long, at int, left byte, near binary, also long, side byte"


def _spans(least: int):
    """Batches of (row, text, met) to spans (_SPAN): of every window met, 16 bits of each shingle within its reach.

    A window of a hot signature comes under keys made of the signature and of each stretch that it shares, so that those meet
    which agree in one, as those that share a passage must. side: that stretch, else 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, offsets in slices(batch, "text"):
                words, met = Words(raw, offsets), part.column("met")
                own, cuts = shingles(words.hashes), np.searchsorted(words.row, np.arange(len(offsets)))
                d = np.repeat(np.arange(part.num_rows), met.value_lengths().to_numpy(zero_copy_only=False))
                key, at, left, right, sides, also = (np.asarray(x) for x in met.flatten().flatten())
                key, at, left, right, middle = key.view(U64), at, left.astype(np.int64), right.astype(np.int64), cuts[d] + at
                keys, which = [key[sides == 0]], [np.flatnonzero(sides == 0)]
                for k, (low, high) in enumerate(_stretches(least)):
                    split = np.flatnonzero(sides & (1 << k))
                    mark = np.full(len(split), k + 1, U64)
                    for i in range(low, high + 1):
                        mark = mix(mark) + own[middle[split] + i]
                    keys.append(mix(key[split] ^ mix(mark)))
                    which.append(split)
                side = np.repeat([0, *range(len(_SIDES))], [len(k) for k in keys]).astype(np.int8)
                key, which = np.concatenate(keys), np.concatenate(which)
                at, left, right, middle, d, also = (x[which] for x in (at, left, right, middle, d, also))
                for some in np.array_split(np.arange(len(key)), len(key) // 20_000 + 1):
                    size = (left + right + 1)[some]
                    ends = np.cumsum(size)
                    within = np.arange(int(size.sum())) - np.repeat(ends - size, size)
                    near = (own[np.repeat((middle - left)[some], size) + within] >> U64(48)).astype(np.uint16) | np.uint16(1)
                    column = pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(np.concatenate([[0], 2 * ends]).astype(np.int32)), pa.py_buffer(near)])
                    yield pa.RecordBatch.from_arrays([pa.array(key[some].view(np.int64)), pa.array(np.asarray(part.column("row"))[d[some]]), pa.array(at[some]), pa.array(left[some].astype(np.int8)), column, pa.array(also[some]), pa.array(side[some])], names=[f.split()[0] for f in _SPAN.split(", ")])

    return run


def _laid_out(batch: pa.RecordBatch, least: int) -> np.ndarray:
    """The spans as rows of a matrix with the smallest value in the middle column; 0 where a span doesn't reach."""
    raw, offsets = flat(batch.column("near"))
    size, left = np.diff(offsets) // 2, np.asarray(batch.column("left")).astype(np.int64)
    near = np.zeros((len(size), 2 * least - 1), np.uint16)
    rows = np.repeat(np.arange(len(size)), size)
    near[rows, np.arange(int(size.sum())) - np.repeat(offsets[:-1] // 2, size) + np.repeat(least - 1 - left, size)] = np.frombuffer(raw.tobytes(), np.uint16)
    return near


def _enough(least: int, similarity: float) -> int:
    """How many shingles two runs of least or more that are so similar share at least."""
    return int(np.ceil(2 * least * similarity / (1 + similarity) - 1e-9))


def _equal_run(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(low, high) of the run of true values around the middle, ends included."""
    mid, ends = same.shape[1] // 2, []
    for side in (same.T[mid::-1], same.T[mid:]):
        alive, n = np.ones(len(same), bool), np.zeros(len(same), np.uint8)
        for here in side:
            alive &= here
            n += alive.view(np.uint8)
        ends.append(n.astype(np.int64))
    return mid - ends[0] + 1, mid + ends[1] - 1


def _count(same: np.ndarray) -> np.ndarray:
    """True values of each column."""
    return np.add.reduce(same.view(np.uint8), axis=0, dtype=np.uint8)


def _dense(same: np.ndarray, least: int, share: float, more: np.ndarray | int = 0) -> np.ndarray:
    """Columns that may hold a run of least places, about the middle, of which so large a share of places (less more * share / 2) are true; the others hold none.

    A run holds enough just if a balance doesn't fall by more from its one end to the other; rounding lets a few others pass."""
    width, n = same.shape
    unit = 256 if width < 120 else 32 * 128 // width
    down, enough = np.int16(share * unit), np.floor(np.asarray(more) * (share / 2 * unit)) - 1
    balance = np.zeros((width + 1, n), np.int16)
    np.multiply(same.view(np.uint8), np.int16(unit), out=balance[1:])
    balance[1:] -= down
    for i in range(1, width):
        balance[i + 1] += balance[i]
    lowest, best, rise = balance[0].copy(), np.full(n, -(1 << 15), np.int16), np.zeros(n, np.int16)
    for j in range(least, width + 1):
        np.minimum(lowest, balance[j - least], out=lowest)
        np.subtract(balance[j], lowest, out=rise)
        np.maximum(best, rise, out=best)
    return np.flatnonzero(best >= enough)


def _similar_run(same: np.ndarray, least: int, similarity: float, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(low, high) of each column's longest run that begins and ends with true values, is least places long on either side, of which the other is more places longer, and holds enough of them; low is -1 if there is none."""
    width, n = same.shape
    low, high, share = np.full(n, -1), np.full(n, -1), 2 * similarity / (1 + similarity)
    for part in np.array_split(np.arange(n), n // 4096 + 1) if n else []:
        held, far = same.take(part, axis=1), more[part]  # by take(), whose result has its places one after another
        sums = np.zeros((width + 1, len(part)), np.uint8)
        for i in range(width):
            np.add(sums[i], held[i].view(np.uint8), out=sums[i + 1])
        longest, at = np.zeros(len(part), np.int64), np.zeros(len(part), np.int64)
        for size in range(least, width + 1):
            need = np.ceil((2 * size + far) * (share / 2) - 1e-9).astype(np.uint8)
            good = sums[size:] - sums[: width + 1 - size] >= need
            good &= held[: width + 1 - size]
            good &= held[size - 1 :]
            fits = np.flatnonzero(np.logical_or.reduce(good, axis=0) & (size >= least - far))
            longest[fits], at[fits] = size, good[:, fits].argmax(axis=0)
        hit = longest > 0
        low[part[hit]], high[part[hit]] = at[hit], (at + longest)[hit] - 1
    return low, high


def _moved(x: np.ndarray, y: np.ndarray, same: np.ndarray, least: int, similarity: float) -> list[np.ndarray]:
    """[pair, low_x, high_x, low_y, high_y, similarity] of pairs (columns) alike but for words put in or left out at one place: beyond it, equal places are up to SHIFT apart."""
    width, mid = x.shape[0], x.shape[0] // 2
    here, found = _count(same), []
    for off in (*range(-SHIFT, 0), *range(1, SHIFT + 1)):
        a, b = max(0, -off), width - max(0, off)
        either = same.copy()
        either[a:b] |= x[a:b] == y[a + off : b + off]
        both = _count(either)
        pair = np.flatnonzero((both > here) & (both >= _enough(least, similarity)))
        found.append((pair, either.take(pair, axis=1), np.full(len(pair), off)))
    pair, either, off = (np.concatenate(c, axis=-1) for c in zip(*found, strict=True))
    more = np.concatenate([off, -off])  # the words are put in after the middle, or before it
    pair, either, off = np.tile(pair, 2), np.tile(either, 2), np.tile(off, 2)
    some = _dense(either, least, 2 * similarity / (1 + similarity), more)
    pair, off, more, either = pair[some], off[some], more[some], either.take(some, axis=1)
    low, high = _similar_run(either, least, similarity, more)
    g = np.flatnonzero((low >= 0) & np.where(more == off, high > mid, low < mid))
    pair, low, high, off, either = pair[g], low[g], high[g], off[g], either.take(g, axis=1)
    low_y, high_y = low + np.where(same[low, pair], 0, off), high + np.where(same[high, pair], 0, off)
    sums, each = np.cumsum(either, axis=0), np.arange(len(g))
    n = sums[high, each] - sums[low, each] + 1
    size_x, size_y = high - low + 1, high_y - low_y + 1
    s = n / np.maximum(size_x + size_y - n, 1)
    fits = (s >= similarity) & (np.minimum(size_x, size_y) >= least)
    return [c[fits] for c in (pair, low, high, low_y, high_y, s)]


def _near_by(x: np.ndarray, y: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Which places of x hold what y has at most SHIFT places away."""
    out, here, width = same.copy(), np.zeros(same.shape, bool), len(same)
    for off in (*range(-SHIFT, 0), *range(1, SHIFT + 1)):
        a, b = max(0, -off), width - max(0, off)
        np.equal(x[a:b], y[a + off : b + off], out=here[a:b])
        out[a:b] |= here[a:b]
    return out


def _matched(near: np.ndarray, a: np.ndarray, b: np.ndarray, least: int, similarity: float) -> list[np.ndarray]:
    """[a, b, low_a, high_a, low_b, high_b, similarity] of those pairs of spans that share a passage: columns of the matrix, ends included.

    Exactly where the equal run around the middle is long enough; else with words changed, and, for those whose equal
    run is of AHEAD places, with words put in or left out once. Of a passage's two parts the longer has that many, and a smallest value in it is
    likely under one of the hash functions. Pairs are columns here, so that each step is over many of them."""
    found: list[list[np.ndarray]] = []
    share = 2 * similarity / (1 + similarity)
    for part in np.array_split(np.arange(len(a)), len(a) // 8_192 + 1):
        x, y = np.ascontiguousarray(near[a[part]].T), np.ascontiguousarray(near[b[part]].T)
        x[x == 0] = 2  # places of no shingle equal nothing
        same = x == y
        low, high = _equal_run(same.T)
        exact = high - low + 1 >= least
        k = np.flatnonzero(exact)
        found.append([a[part[k]], b[part[k]], low[k], high[k], low[k], high[k], np.ones(len(k))])
        rest = ~exact
        k = np.flatnonzero(rest & (_count(same) >= _enough(least, similarity)))
        k = k[_dense(same.take(k, axis=1), least, share)]
        lo, hi = _similar_run(same.take(k, axis=1), least, similarity, np.zeros(len(k), np.int64))
        k, lo, hi = k[lo >= 0], lo[lo >= 0], hi[lo >= 0]
        sums = np.cumsum(same.take(k, axis=1), axis=0)
        own = sums[hi, np.arange(len(k))] - sums[lo, np.arange(len(k))] + 1
        found.append([a[part[k]], b[part[k]], lo, hi, lo, hi, own / (2 * (hi - lo + 1) - own)])
        rest[k] = False
        k = np.flatnonzero(rest & (high - low + 1 >= AHEAD))
        if len(k):  # a side of the run that is SHIFT places longer than the other holds so many less
            x, y, same = (c.take(k, axis=1) for c in (x, y, same))
            some = _dense(_near_by(x, y, same), least, share, -SHIFT)
            k, x, y, same = k[some], *(c.take(some, axis=1) for c in (x, y, same))
        if len(k):
            pair, *spans = _moved(x, y, same, least, similarity)
            found.append([a[part[k[pair]]], b[part[k[pair]]], *spans])
    return [np.concatenate(c) for c in zip(*found, strict=True)]


def _gathered(pairs: Iterator[tuple[np.ndarray, np.ndarray]], most: int = 8_192) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs in runs of about most, whichever groups they are of."""
    held, size = [], 0
    for a, b in pairs:
        held.append((a, b))
        size += len(a)
        if size >= most:
            a, b = (np.concatenate(c) for c in zip(*held, strict=True))
            for low in range(0, size - most + 1, most):
                yield a[low : low + most], b[low : low + most]
            held, size = [(a[size - size % most :], b[size - size % most :])], size % most
    if size:
        yield tuple(np.concatenate(c) for c in zip(*held, strict=True))


def _tables(near: np.ndarray, full: np.ndarray, one: tuple[int, int], two: tuple[int, int], enough: int, tile: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a span of one run of spans with a later one of another run (or of the same), by looking at each pair: tables of spans by spans, a column at a time."""
    mid, width = near.shape[1] // 2, near.shape[1]
    columns, others = np.ascontiguousarray(full[one[0] : one[1]].T), np.ascontiguousarray(near[two[0] : two[1]].T)
    for i in range(0, one[1] - one[0], 64):
        x = columns[:, i : i + 64, None]
        for j in range(i if one == two else 0, two[1] - two[0], tile // 64):
            y = others[:, None, j : j + tile // 64]
            same, run, here = (np.zeros((x.shape[1], y.shape[2]), kind) for kind in (np.uint8, np.uint8, bool))
            for side in (range(mid, width), range(mid - 1, -1, -1)):
                alive = np.ones(same.shape, bool)
                for c in side:
                    np.equal(x[c], y[c], out=here)
                    same += here.view(np.uint8)
                    if abs(c - mid) <= AHEAD:
                        alive &= here
                        run += alive.view(np.uint8)
            a, b = np.nonzero((same >= enough) | (run >= AHEAD))
            a, b = a + i + one[0], b + j + two[0]
            later = b > a
            yield a[later], b[later]


def _branches(side: np.ndarray, group: np.ndarray) -> np.ndarray:
    """[place, span]: a number that spans of a group share just if they are equal from the first place to that one."""
    named = np.column_stack([group, side]).astype(np.uint16)  # sorted as bytes, equal beginnings lie together
    order = np.argsort(named.view(f"V{2 * named.shape[1]}").ravel())
    named, numbers, out = named[order], np.zeros(side.shape, np.int64), np.zeros(side.T.shape, np.int64)
    np.cumsum(np.logical_or.accumulate(named[1:] != named[:-1], axis=1)[:, 1:], axis=0, out=numbers[1:])
    out[:, order] = numbers.T
    return out


def _expanded(first: np.ndarray, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """first, each as often as count says, and beside it start and what follows it."""
    ends = np.cumsum(count)
    return np.repeat(first, count), np.repeat(start - (ends - count), count) + np.arange(int(ends[-1]) if len(ends) else 0)


def _ends(key: np.ndarray) -> np.ndarray:
    """Of each place of a sorted array the end of its run of equal values."""
    edges = np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, len(key))
    return np.repeat(edges, np.diff(edges, prepend=0))


def _meetings(near: np.ndarray, group: np.ndarray, least: int, share: int = 16) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, many): all pairs a < b of spans of a group that may share a passage, found by sorting; groups that have too many such, for which others are left to tables.

    A passage ends, on either side, least places or more from its other end, with equal places, or with places up to SHIFT apart. If both ends lie in the
    run of equal places about the middle, that run is of least places. If an end of one span lies in it and the other's isn't that place, the
    run is as long as the other's passage. Else an end lies, in both spans, beyond a place where they differ. So spans meet by such ends alone, and text that many
    have about the middle, one word again and again too, brings none together. many: where more than one in share of all pairs would meet."""
    bits = 14  # of a span, a group and a branch: at most 1 << 14 spans
    n, mid, spans = len(near), near.shape[1] // 2, np.bincount(group)
    sides = [np.ascontiguousarray(near[:, mid:]), np.ascontiguousarray(near[:, mid::-1])]
    branches = [_branches(side, group) for side in sides]
    met, meet = np.zeros(len(spans)), []

    def add(a: np.ndarray, who: np.ndarray, start: np.ndarray, count: np.ndarray) -> None:
        """Each of a meets who[start : start + count]."""
        met[:] += np.bincount(group[a], count, len(spans))
        meet.append((a, who, start, count))

    for side, other, branch in zip(sides, sides[::-1], branches, strict=True):
        reach = np.count_nonzero(other, axis=1) - 1
        at, x = np.nonzero((side > 0).T & (np.arange(mid + 1)[:, None] >= np.maximum(least - 1 - reach, 1)))
        key = (group[x] << 24 | side[x, at].astype(np.int64) << 8 | at) << bits | branch[at, x]
        order = np.argsort(key)
        key, x = key[order], x[order]
        run, to = key >> bits, _ends(key)
        add(x, x, to, _ends(run) - to)
        begin = np.flatnonzero(np.diff(run, prepend=-1))
        runs, size = run[begin], np.diff(begin, append=len(run))
        for k in range(1, SHIFT + 1):
            one = np.flatnonzero(runs[k:] - runs[:-k] <= SHIFT)
            pair, j = _expanded(one, begin[one + k], size[one + k])
            own = runs[pair] << bits | branch[runs[pair] & 255, x[j]]
            low, high = np.searchsorted(key, own), np.searchsorted(key, own, side="right")
            add(x[j], x, begin[pair], low - begin[pair])
            add(x[j], x, high, begin[pair] + size[pair] - high)
    after, before = sides
    long = [np.flatnonzero((before[:, p] > 0) & (after[:, least - 1 - p] > 0)) for p in range(least)]
    x, p = np.concatenate(long), np.repeat(np.arange(least), [len(c) for c in long])
    q = np.minimum(least - p, mid)
    beyond = np.where((p == 0) | (after[x, q] == 0), n + x, branches[0][q, x])  # they part or end right after it, so each pair meets once
    key = (p << 2 * bits | branches[1][p, x] << bits | branches[0][least - 1 - p, x]) << bits + 1 | beyond
    order = np.argsort(key)
    key, x = key[order], x[order]
    to = _ends(key)
    add(x, x, to, _ends(key >> bits + 1) - to)
    many, codes = met > spans * (spans - 1) / 2 / share, []
    for a, who, start, count in meet:
        some = (count > 0) & ~many[group[a]]
        a, at = _expanded(a[some], start[some], count[some])
        b = who[at]
        codes.append(np.minimum(a, b) * n + np.maximum(a, b))
    code = np.unique(np.concatenate(codes))
    a, b = code // n, code % n
    return a[a != b], b[a != b], np.flatnonzero(many)


def _candidates(near: np.ndarray, starts: np.ndarray, least: int, similarity: float, few: int = 32, block: int = 1 << 13) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of spans of a group that are equal in so many places, or for so long about the middle, that they may share a passage.

    No pair of a group that may share one is left out: groups of few spans go pair by pair, larger ones by _meetings(), in blocks of spans of which any two of
    a group meet, and by _tables() where that would meet too many."""
    enough, mid = _enough(least, similarity), near.shape[1] // 2
    sizes = np.diff(starts, append=len(near))
    group = np.repeat(np.arange(len(starts)), sizes)
    full = np.where(near == 0, np.uint16(2), near)  # places of no shingle equal nothing

    def alike(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for part in np.array_split(np.arange(len(a)), len(a) // 4_000 + 1):
            x, y = a[part], b[part]
            same = full[x] == near[y]
            some = (np.count_nonzero(same, axis=1) >= enough) | same[:, mid - CONTEXT : mid + 1].all(axis=1) | same[:, mid : mid + CONTEXT + 1].all(axis=1)
            yield x[some], y[some]

    at = np.flatnonzero(sizes[group] <= few)
    for step in range(1, few):
        at = at[at + step < len(near)]
        at = at[group[at] == group[at + step]]
        yield from alike(at, at + step)
    large = sizes > few
    fits = np.flatnonzero(large & (sizes <= block))
    for some in np.split(fits, np.flatnonzero(np.diff((np.cumsum(sizes[fits]) - 1) // (block // 2))) + 1):
        for part in [some] if sizes[some].sum() <= block else [some[:1], some[1:]]:
            if len(part):
                at = np.flatnonzero(np.isin(group, part))
                a, b, many = _meetings(near[at], np.searchsorted(part, group[at]), least)
                yield from alike(at[a], at[b])
                for g in part[many]:
                    whole = (int(starts[g]), int(starts[g] + sizes[g]))
                    yield from _tables(near, full, whole, whole, enough)
    for g in np.flatnonzero(sizes > block):
        edges = np.linspace(starts[g], starts[g] + sizes[g], -(-int(sizes[g]) // (block // 2)) + 1).astype(int).tolist()
        parts = list(zip(edges[:-1], edges[1:], strict=True))
        for i, one in enumerate(parts):
            for two in parts[i:]:
                at = np.arange(*one) if one == two else np.concatenate([np.arange(*one), np.arange(*two)])
                a, b, many = _meetings(near[at], np.zeros(len(at), np.int64), least)
                if len(many):
                    yield from _tables(near, full, one, two, enough)
                else:
                    apart = (one == two) | ((a < one[1] - one[0]) & (b >= one[1] - one[0]))
                    yield from alike(at[a[apart]], at[b[apart]])


def _matches(near: np.ndarray, starts: np.ndarray, least: int, similarity: float, wanted, side: np.ndarray | None = None) -> Iterator[list[np.ndarray]]:
    """Matches, as _matched() gives them, of all pairs (a before b) of spans of a group for which wanted(a, b) holds when their turn comes.

    side: of each span the stretch by which its group meets. Those that agree in an earlier one too meet by that."""
    mid = near.shape[1] // 2
    for a, b in _gathered(_candidates(near, starts, least, similarity)):
        some = wanted(a, b)
        for k in range(0 if side is None else int(side[a].max())):
            low, high = (mid + p for p in _stretches(least)[k])
            i = np.flatnonzero(some & (side[a] > k))
            x, y = near[a[i], low : high + 1], near[b[i], low : high + 1]
            some[i[((x == y) & (x > 0)).all(axis=1)]] = False
        if some.any():
            found = _matched(near, a[some], b[some], least, similarity)
            if len(found[0]):
                yield found


def _pairs(near: np.ndarray, rows: np.ndarray, starts: np.ndarray, least: int, similarity: float) -> list[np.ndarray]:
    """Matches, as _matched() gives them, of all pairs of spans of a group, of different rows, which share a passage."""
    found = list(_matches(near, starts, least, similarity, lambda a, b: rows[a] != rows[b]))
    return [np.concatenate(c) for c in zip(*found, strict=True)] if found else _matched(near, starts[:0], starts[:0], least, similarity)


_LINK = "a long, b long, a_start int, a_end int, b_start int, b_end int, similarity double"


def _links(a: np.ndarray, b: np.ndarray, *spans: np.ndarray) -> pa.RecordBatch:
    """Links with the earlier row as a; none within a row."""
    keep, flip = a != b, a > b
    low_a, high_a, low_b, high_b, s = spans
    columns = [np.where(flip, x, y)[keep] for x, y in ((b, a), (a, b), (low_b, low_a), (high_b, high_a), (low_a, low_b), (high_a, high_b))]
    kinds = [np.int64, np.int64, np.int32, np.int32, np.int32, np.int32]
    return pa.RecordBatch.from_arrays([*(pa.array(c.astype(k)) for c, k in zip(columns, kinds, strict=True)), pa.array(s[keep])], names=[f.split()[0] for f in _LINK.split(", ")])


def _ties(least: int, similarity: float, most: int):
    """Batches of spans, sorted by key and row, to links: the interval join of the spans of each signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _ in _whole_groups(batches, 1 << 62):
            key, row, at = (np.asarray(batch.column(c)) for c in ("key", "row", "at"))
            starts = np.flatnonzero(np.diff(key, prepend=key[0] ^ 1))
            for a, b, low_a, high_a, low_b, high_b, s in _matches(_laid_out(batch, least), starts, least, similarity, lambda a, b, row=row: row[a] != row[b], np.asarray(batch.column("side"))):
                at_a, at_b = at[a] - least + 1, at[b] - least + 1
                yield _links(row[a], row[b], at_a + low_a, at_a + high_a + 1, at_b + low_b, at_b + high_b + 1, s)

    return run


def _roots(parent: np.ndarray, at: np.ndarray) -> np.ndarray:
    up = parent[at]
    while (more := parent[up] != up).any():
        up = np.where(more, parent[up], up)
    return up


def _unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the sets of a and b, each named by its smallest member."""
    while len(a):
        x, y = _roots(parent, a), _roots(parent, b)
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        parent[np.maximum(x, y)] = np.minimum(x, y)  # of several the last counts; the others come again


_SHARED = "row long, start int, end int, early_start int, early_end int, tie long, similarity double"


def _shared(least: int, similarity: float):
    """Batches of spans, sorted by key and row, to what each span shares (_SHARED): one row for a span, however many partners it has.

    All pairs of a group are looked at, and those are verified that can still add something: tie two sets of spans that
    weren't tied, or show that more of a span is shared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _ in _whole_groups(batches, 1 << 62):
            key, row, at, also = (np.asarray(batch.column(c)) for c in ("key", "row", "at", "also"))
            near = _laid_out(batch, least)
            begin, end = (near > 0).argmax(axis=1), near.shape[1] - 1 - (near[:, ::-1] > 0).argmax(axis=1)
            parent, best = np.arange(len(row)), np.zeros(len(row))
            low, high = np.full((2, len(row)), near.shape[1] + SHIFT), np.full((2, len(row)), -1 - SHIFT)  # with any row, and with an earlier one

            def wanted(a: np.ndarray, b: np.ndarray) -> np.ndarray:
                apart, out = row[a] != row[b], np.zeros(len(a), bool)
                for x, y in ((a, b), (b, a)):
                    left, right = np.maximum(begin[x], begin[y] - SHIFT), np.minimum(end[x], end[y] + SHIFT)
                    out |= (low[0, x] > left) | (high[0, x] < right)
                    if x is b:
                        out |= apart & ((low[1, x] > left) | (high[1, x] < right))
                out |= _roots(parent, a) != _roots(parent, b)
                return out & (apart | (also[a] >= 0) | (also[b] >= 0))

            for a, b, low_a, high_a, low_b, high_b, s in _matches(near, np.flatnonzero(np.diff(key, prepend=key[0] ^ 1)), least, similarity, wanted, np.asarray(batch.column("side"))):
                _unite(parent, a, b)
                apart = row[a] != row[b]
                for k, x, p, q, some in ((0, a, low_a, high_a, apart | (also[b] >= 0)), (0, b, low_b, high_b, apart | (also[a] >= 0)), (1, b, low_b, high_b, apart)):
                    np.minimum.at(low[k], x[some], p[some])
                    np.maximum.at(high[k], x[some], q[some])
                    np.maximum.at(best, x[some], s[some])
            held = np.flatnonzero(high[0] >= 0)
            first, early = at[held] - least + 1, high[1, held] >= 0
            columns = [row[held], first + low[0, held], first + high[0, held] + 1, np.where(early, first + low[1, held], -1), np.where(early, first + high[1, held] + 1, -1), row[_roots(parent, held)], best[held]]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(k)) for c, k in zip(columns, (np.int64, np.int32, np.int32, np.int32, np.int32, np.int64, np.float64), strict=True)], names=[f.split()[0] for f in _SHARED.split(", ")])

    return run


def _met_spans(rows: DataFrame, least: int, similarity: float, hashes: int, most: int, large: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """Windows tied to an equal one (_MET), spans that may share a passage (_SPAN) dealt and sorted by key, and the paths that both are read from.

    Windows meet by signature. Of windows equal as wholes, all are tied to the first. Of the others, those which agree with
    another in a stretch go on. Two runs of similarity s meet under one hash function with chance s, so under one of
    four with 0.998 where s is 0.8. The windows of a signature with over large different ones (or most in all) meet by
    signature and stretch. A key of over most spans even then is dealt in parts of which any two meet in one task."""
    sure = _sure(least, similarity)
    windows = rows.select("row", F.coalesce("text", F.lit("")).cast("binary").alias("text")).mapInArrow(_windows(hashes, least, sure), _WINDOW)
    known = F.coalesce(F.col("other_at") >= 0, F.lit(False))
    dealt = windows.repartition(F.when(known, F.xxhash64("row", "at", "key")).otherwise(F.col("key"))).sortWithinPartitions(known, "key", "whole", "row", "at")
    met, met_path = materialise(dealt.mapInArrow(_meet(most, large, sure), _MET), "met")
    asked = met.filter("b is null").groupBy(F.col("a").alias("row")).agg(F.collect_list(F.struct("key", F.col("a_at").alias("at"), "left", "right", "sides", "also")).alias("met"))
    texts = rows.join(asked.hint("shuffle_hash"), "row").select("row", F.coalesce("text", F.lit("")).cast("binary").alias("text"), "met")
    spans, spans_path = materialise(texts.mapInArrow(_spans(least), _SPAN), "spans")
    keys, keys_path = materialise(spans.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > most), "keys")
    met = met.filter("b is not null")
    if not keys.isEmpty():  # fewer than spans over most
        parts = F.ceil(F.col("n") * 2 / most).cast("int")
        hot = spans.join(F.broadcast(keys), "key").withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("row", "at"), F.col("parts")).cast("int"))
        pair = F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.xxhash64("key", F.least(p, "part"), F.greatest(p, "part"))))
        spans = spans.join(F.broadcast(keys), "key", "left_anti").unionByName(hot.withColumn("key", pair).drop("n", "parts", "part"))
    return met, spans.repartition("key").sortWithinPartitions("key", "row", "at"), [met_path, spans_path, keys_path]


def window_links(rows: DataFrame, least_words: int = 50, similarity: float = 0.8, hashes: int = 4, most: int = 200_000, large: int = 300) -> DataFrame:
    """(a, b, a_start, a_end, b_start, b_end, similarity) of rows (row, text): runs of shingles around a window's smallest value, ends exclusive, that rows a < b share.

    Equal windows are linked to the first of them; different ones of a signature all with each other, which takes as many rows as there are such pairs."""
    least = least_words - SHINGLE + 1
    met, spans, paths = _met_spans(rows, least, similarity, hashes, most, large)
    n = F.col("left") + F.col("right").cast("int") + 1
    start = [(F.col(f"{x}_at") - F.col("left")).cast("int") for x in "ba"]
    same = met.filter("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), start[0].alias("a_start"), (start[0] + n).cast("int").alias("a_end"), start[1].alias("b_start"), (start[1] + n).cast("int").alias("b_end"), F.lit(1.0).alias("similarity"))
    out, _ = materialise(same.unionAll(spans.mapInArrow(_ties(least, similarity, most), _LINK)), "links")
    for path in paths:
        forget(rows.sparkSession, path)
    return out


def _joined(low: np.ndarray, high: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, top) of runs of intervals, sorted by row and low, that overlap or touch: the first interval's index, and the greatest high."""
    if not len(low):
        return np.zeros(0, np.int64), high
    base = row * (int(high.max()) + 2)  # rows don't touch
    top = np.maximum.accumulate(base + high)
    fresh = np.ones(len(low), bool)
    fresh[1:] = (base + low)[1:] > top[:-1]
    first = np.flatnonzero(fresh)
    return first, top[np.append(first[1:] - 1, len(low) - 1)] - base[first]


_PASSAGE = "row long, start int, end int, extra boolean, similarity double, ties array<long>"


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of _SHARED, sorted by row (as key) and start, to passages (_PASSAGE); the first of a row has the other rows that it is tied to."""
    tail = SHINGLE - 1
    for batch, _ in _whole_groups(batches, 1 << 62):
        row, low, high, early_low, early_high, tie, s = (np.asarray(c) for c in batch.columns)
        _, at = np.unique(row, return_inverse=True)
        early = np.flatnonzero(early_high >= 0)
        early = early[np.lexsort((early_low[early], at[early]))]
        parts = [[], [], [], [], []]
        for extra, own, l, h in ((True, early, early_low, early_high), (False, np.arange(len(row)), low, high)):
            first, top = _joined(l[own].astype(np.int64), h[own].astype(np.int64), at[own])
            best = np.maximum.reduceat(s[own], first) if len(first) else s[:0]
            for c, x in zip(parts, (at[own[first]], l[own[first]], top, np.full(len(first), extra), best), strict=True):
                c.append(x)
        who, low, high, extra, s = (np.concatenate(c) for c in parts)
        order = np.lexsort((~extra, high, low, who))
        who, low, high, extra, s = (c[order] for c in (who, low, high, extra, s))
        again = np.zeros(len(who), bool)  # an earlier row has all of it
        again[1:] = (who[1:] == who[:-1]) & (low[1:] == low[:-1]) & (high[1:] == high[:-1])
        who, low, high, extra, s = (c[~again] for c in (who, low, high, extra, s))
        names = np.unique(row)
        edges = np.unique(np.stack([at, tie])[:, row != tie], axis=1)
        counts = np.zeros(len(who), np.int64)
        counts[np.searchsorted(who, np.arange(len(names)))] = np.bincount(edges[0], minlength=len(names))
        ties = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(edges[1]))
        yield pa.RecordBatch.from_arrays([pa.array(names[who]), pa.array(low.astype(np.int32)), pa.array((high + tail).astype(np.int32)), pa.array(extra), pa.array(s), ties], names=[f.split()[0] for f in _PASSAGE.split(", ")])


def row_passages(rows: DataFrame, least_words: int = 50, similarity: float = 0.8, hashes: int = 4, most: int = 200_000, large: int = 300) -> DataFrame:
    """row, start, end (words, end exclusive), extra, similarity, ties of rows (row, text): all passages that a row shares with others, as few rows as there are passages.

    extra: an earlier row has all of it; else it is shared with later rows, or in part with earlier ones. Runs that overlap or touch
    make one passage; of these its similarity is the greatest. ties: rows by which rows that share a passage hang together, with the row's first passage."""
    least = least_words - SHINGLE + 1
    met, spans, paths = _met_spans(rows, least, similarity, hashes, most, large)
    start, end = (F.col("a_at") - F.col("left")).cast("int"), (F.col("a_at") + F.col("right") + 1).cast("int")
    later = F.col("b") < F.col("a")
    same = met.select(F.col("a").alias("row"), start.alias("start"), end.alias("end"), F.when(later, start).otherwise(-1).alias("early_start"), F.when(later, end).otherwise(-1).alias("early_end"), F.col("b").alias("tie"), F.lit(1.0).alias("similarity"))
    shared = same.unionAll(spans.mapInArrow(_shared(least, similarity), _SHARED)).withColumnRenamed("row", "key")
    out, _ = materialise(shared.repartition("key").sortWithinPartitions("key", "start").mapInArrow(_merged, _PASSAGE), "passages")
    for path in paths:
        forget(rows.sparkSession, path)
    return out


def passage_links(rows: DataFrame, least_words: int = 50, similarity: float = 0.8, hashes: int = 4) -> DataFrame:
    """(a, a_start, a_end, b, b_start, b_end, similarity): passages of least_words words or more that rows a < b share, in words, ends exclusive.

    Runs around windows that overlap, with the same words on either side, make up one passage; of these its
    similarity is the least."""
    links = window_links(rows, least_words, similarity, hashes).withColumn("off", F.col("b_start") - F.col("a_start"))
    before = Window.partitionBy("a", "b", "off").orderBy("a_start", "a_end").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("a", "b", "off").orderBy("a_start", "a_end").rowsBetween(Window.unboundedPreceding, 0)
    links = links.withColumn("fresh", F.when(F.col("a_start") > F.max("a_end").over(before), 1).otherwise(0)).withColumn("part", F.sum("fresh").over(upto))
    tail = SHINGLE - 1
    whole = links.groupBy("a", "b", "off", "part").agg(F.min("a_start").alias("a_start"), (F.max("a_end") + tail).alias("a_end"), F.min("b_start").alias("b_start"), (F.max("b_end") + tail).alias("b_end"), F.min("similarity").alias("similarity"))
    return whole.select("a", "a_start", "a_end", "b", "b_start", "b_end", "similarity")


def repeated_passages(documents: DataFrame, least_words: int = 50, similarity: float = 0.8, hashes: int = 4) -> DataFrame:
    """doc_id, start_word, end_word (exclusive), partner_id, partner_start, partner_end, similarity, extra: every passage that a row shares with another, on both sides.

    extra: whether the partner comes earlier in the table, so that this side may go. Rows that share a passage
    are linked directly or through others that share it. Whole texts count. Every row is a document of its own, whatever
    its doc_id, so repeated rows are linked as copies and a null doc_id appears as null; null or short texts share
    nothing; passages within a single text are no links; other columns are not read; an empty table gives no rows."""
    rows, _ = numbered_rows(documents.select("doc_id", "text"))
    links, _ = materialise(passage_links(rows.select("row", "doc.text"), least_words, similarity, hashes), "passages")
    ids = rows.select("row", "doc.doc_id")
    named = links.join(ids.select(F.col("row").alias("a"), F.col("doc_id").alias("a_id")), "a").join(ids.select(F.col("row").alias("b"), F.col("doc_id").alias("b_id")), "b")

    def side(own: str, other: str) -> list:
        places = [(f"{own}_id", "doc_id"), (f"{own}_start", "start_word"), (f"{own}_end", "end_word"), (f"{other}_id", "partner_id"), (f"{other}_start", "partner_start"), (f"{other}_end", "partner_end")]
        return [F.struct(*[F.col(x).cast("long" if "_id" not in x else documents.schema["doc_id"].dataType).alias(y) for x, y in places], "similarity", F.lit(own == "b").alias("extra"))]

    return named.select(F.explode(F.array(*side("b", "a"), *side("a", "b"))).alias("x")).select("x.*")


def shared_passages(documents: DataFrame, least_words: int = 50, similarity: float = 0.8, hashes: int = 4) -> DataFrame:
    """doc_id, start_word, end_word (exclusive), class_id, similarity, extra: every passage that a row shares with another, once.

    class_id: the doc_id of the first row of the table that is reached from the row over shared passages. extra: an earlier row has
    all of the passage, so it may go. Rows, null and short texts and an empty table are taken as repeated_passages() takes them."""
    rows, path = numbered_rows(documents.select("doc_id", "text"))
    found = row_passages(rows.select("row", "doc.text"), least_words, similarity, hashes)
    roots = connected_components(found.select(F.col("row").alias("a"), F.explode("ties").alias("b")))
    ids = rows.select("row", "doc.doc_id")
    named = roots.join(ids.select(F.col("row").alias("root"), F.col("doc_id").alias("class_id")), "root").select(F.col("node").alias("row"), "class_id")
    return found.join(ids, "row").join(named, "row").select("doc_id", F.col("start").cast("long").alias("start_word"), F.col("end").cast("long").alias("end_word"), "class_id", "similarity", "extra")


def _without(texts: pa.Array, gone: pa.Array) -> pa.Array:
    """Texts without the runs of words gone."""
    out = []
    for text, spans in zip(texts.to_pylist(), gone.to_pylist(), strict=True):
        raw = text.encode()
        words = Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        kept, low = [], 0
        for s, e in sorted((g["s"], g["e"]) for g in spans):
            begin, end = int(words.start[s]), int(words.end[e - 1])
            kept.append(raw[low : max(begin, low)])
            low = max(low, end)
        out.append(b"".join([*kept, raw[low:]]).decode())
    return pa.array(out, pa.string())


def drop_repeats(documents: DataFrame, least_words: int = 50, similarity: float = 0.8) -> DataFrame:
    """documents without the passages that an earlier row of the table has too; a row of which no word is left goes.

    Rows are told apart by their place, not by doc_id: each text is cut where it repeats, of repeated rows the first
    stays, and null ids are kept like any other. Columns stay as they are but for text and, where there is one,
    n_chars, which is counted anew for texts that were cut. Null and empty texts stay; an empty table stays empty."""
    rows, _ = numbered_rows(documents)
    gone = row_passages(rows.select("row", "doc.text"), least_words, similarity).filter("extra").groupBy("row").agg(F.collect_set(F.struct(F.col("start").alias("s"), F.col("end").alias("e"))).alias("gone"))
    joined = rows.join(gone.hint("shuffle_hash"), "row", "left")
    whole, touched = joined.filter("gone is null").select("doc.*"), joined.filter("gone is not null").withColumn("left", F.arrow_udf(_without, "string")(F.col("doc.text"), F.col("gone"))).filter(F.col("left").rlike(r"[^\x20\x09-\x0D]"))
    new = {"text": F.col("left"), "n_chars": F.length("left")}
    return whole.unionAll(touched.select(*[(new[c].cast(kind) if c in new else F.col("doc")[c]).alias(c) for c, kind in documents.dtypes]))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All passages of 50 words or more that documents share, with the class of each document."""
    return shared_passages(table(spark, sf_dir, "documents"))
