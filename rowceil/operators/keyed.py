"""Degrees of keys within buckets, counted by tasks that hold all rows of their keys.

Rows are dealt by key: a task cuts what it reads into parts and sends the rows of a part packed, as arrays. The task of
a part adds them up to (key, value, rows) for each filter column, and counts from these the keys of each degree in every
bucket: null, not null, intervals, common values and grams. No row is spread over filter columns or buckets on its way.
A key's rows are added up as they come, so a key with many rows takes a task no more memory than its different values.
"""

from __future__ import annotations

import pickle
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Rows that a part is meant to hold, that are dealt at once, and keys whose intervals are added up at once.
PART_ROWS, DEAL_ROWS, SLICE = 150_000, 400_000, 1 << 16
#: What a row of the result is: keys of a degree in a bucket, keys of a degree for a rare value, for a rare gram.
BUCKET, VALUE, GRAM = 0, 1, 2
RESULT = "what int, i int, c int, b long, x double, d long, n long"
NULL, NOT_NULL, FIRST = 0, 1, 2  # numbers of buckets; from FIRST on intervals, then common values, then grams

_NONE = np.zeros(0, dtype=np.int64)


@dataclass
class Lists:
    """For each code some numbers: those of code c are ids[starts[c] : starts[c + 1]]."""

    starts: np.ndarray
    ids: np.ndarray

    @classmethod
    def of(cls, lists: list[list[int]]) -> Lists:
        return cls(np.cumsum([0, *map(len, lists)]), np.array([x for own in lists for x in own], dtype=np.int64))

    def spread(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every number of every code, the place of the code and the number."""
        lengths = self.starts[codes + 1] - self.starts[codes]
        at = np.repeat(np.arange(len(codes)), lengths)
        within = np.arange(len(at)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        return at, self.ids[self.starts[codes][at] + within]


@dataclass
class Filter:
    """What tasks need to know of a filter column. A value's code is its place in `values` (text), its bits (double) or itself."""

    kind: str  # text, double or long
    edges: list
    intervals: list[tuple[int, int]]  # first and last base bucket
    values: list[str] = field(default_factory=list)
    common: list = field(default_factory=list)  # codes of text, else values
    grams: list[list[int]] | None = None  # for each text, places of its grams that are counted
    rare: list[list[int]] | None = None

    def __post_init__(self) -> None:
        codes = self.code(self.common)
        order = np.argsort(codes, kind="stable")
        self.common_codes, self.places = codes[order], order
        self.bases = np.array([bisect_left(self.edges, v) for v in self.values], dtype=np.int64)
        self.gram_lists, self.rare_lists = (None if x is None else Lists.of(x) for x in (self.grams, self.rare))
        self.grams = self.rare = None

    def code(self, values) -> np.ndarray:
        if self.kind != "double":
            return np.asarray(values, dtype=np.int64)
        x = np.asarray(values, dtype=np.float64) + 0.0
        return np.where(np.isnan(x), np.nan, x).view(np.int64)

    def codes(self, a: pa.Array) -> tuple[np.ndarray, np.ndarray | None]:
        """Codes of a column, and where it is null."""
        null = np.asarray(pc.is_null(a)) if a.null_count else None
        if self.kind == "text":
            found = pc.index_in(a, value_set=pa.array(self.values, a.type))
            if found.null_count != a.null_count:
                raise ValueError("a value that was not counted")
            a = found
        return self.code(pc.fill_null(a, 0).to_numpy(zero_copy_only=False)), null

    def base(self, codes: np.ndarray) -> np.ndarray:
        if self.kind == "text":
            return self.bases[codes]
        return np.searchsorted(np.asarray(self.edges, dtype=np.float64 if self.kind == "double" else np.int64), codes.view(np.float64) if self.kind == "double" else codes, "left")

    def place(self, codes: np.ndarray) -> np.ndarray:
        """Place among the common values; -1 for none."""
        if not len(self.common_codes):
            return np.full(len(codes), -1)
        at = np.minimum(np.searchsorted(self.common_codes, codes), len(self.common_codes) - 1)
        return np.where(self.common_codes[at] == codes, self.places[at], -1)

    @property
    def first_value(self) -> int:
        return FIRST + len(self.intervals)

    @property
    def first_gram(self) -> int:
        return self.first_value + len(self.common)


def _small(codes: np.ndarray, kind: str) -> tuple[np.ndarray, bool]:
    """The same codes in fewer bytes, and whether they are hundredths of doubles."""
    if kind == "double":
        x = codes.view(np.float64)
        with np.errstate(all="ignore"):
            cents = np.rint(x * 100)
            if (np.abs(cents) < 1 << 31).all() and ((cents / 100 + 0.0).view(np.int64) == codes).all():
                return _small(cents.astype(np.int64), "long")[0], True
        return codes, False
    for t in (np.int8, np.int16, np.int32):
        if not len(codes) or (codes.min() >= np.iinfo(t).min and codes.max() <= np.iinfo(t).max):
            return codes.astype(t), False
    return codes, False


def _large(codes: np.ndarray, cents: bool) -> np.ndarray:
    return (codes / 100 + 0.0).view(np.int64) if cents else codes.astype(np.int64)


def _part(keys: np.ndarray, parts: int) -> np.ndarray:
    h = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(33)) % np.uint64(parts)


def dealt(filters: list[Filter], columns: list[tuple[int, int, int]]):
    """A function of batches (a column of keys for each of columns, n, a column for each filter): part, blob. Of each key column the number, its first part, and how many it has."""

    def deal(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(batches).combine_chunks()
        column = lambda i: table.column(i).combine_chunks() if isinstance(table.column(i), pa.ChunkedArray) else table.column(i)
        n = column(len(columns)).to_numpy(zero_copy_only=False)
        coded = [f.codes(column(len(columns) + 1 + i)) for i, f in enumerate(filters)]
        numbers, blobs = [], []
        for at, (c, before, own) in enumerate(columns):
            keys, there = column(at), slice(None)
            if keys.null_count:
                there = np.flatnonzero(np.asarray(pc.is_valid(keys)))
                keys = pc.drop_null(keys)
            keys = keys.to_numpy(zero_copy_only=False)
            part = _part(keys, own).astype(np.uint16 if own <= 1 << 16 else np.int64)
            order = np.argsort(part, kind="stable")
            ends = np.searchsorted(part[order], np.arange(own + 1))
            keys, weights = keys[order], n[there][order]
            ordered = [(x[there][order], None if null is None else null[there][order]) for x, null in coded]
            for p in np.flatnonzero(np.diff(ends)):
                at = slice(ends[p], ends[p + 1])
                some = [(*_small(x[at], f.kind), None if null is None or not null[at].any() else np.packbits(null[at])) for f, (x, null) in zip(filters, ordered, strict=True)]
                w = weights[at]
                numbers.append(before + int(p))
                blobs.append(pickle.dumps((c, _small(keys[at], "long")[0], None if (w == 1).all() else w, some), protocol=5))
        return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(blobs, pa.binary())], ["part", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= DEAL_ROWS:
                yield deal(held)
                held, rows = [], 0
        if rows:
            yield deal(held)

    return run


def added(keys: np.ndarray, codes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different (key, code) in order, and the sums of n."""
    if not len(keys):
        return _NONE, _NONE, _NONE
    order = np.lexsort((codes, keys))
    keys, codes, n = keys[order], codes[order], n[order]
    starts = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]) | (codes[1:] != codes[:-1]))))
    return keys[starts], codes[starts], np.add.reduceat(n, starts)


class _Held:
    """The rows of a key column's part, added up."""

    def __init__(self, filters: list[Filter]) -> None:
        self.filters, self.new, self.rows = filters, [], 0
        self.sums = [((_NONE,) * 3, (_NONE,) * 3) for _ in filters]  # of values, of null

    def take(self, keys, n, coded) -> None:
        self.new.append((keys.astype(np.int64), np.ones(len(keys), dtype=np.int64) if n is None else n, coded))
        self.rows += len(keys)
        if self.rows >= 2 * PART_ROWS:
            self.fold()

    def fold(self) -> None:
        new, self.new, self.rows = self.new, [], 0
        if not new:
            return
        keys, n = np.concatenate([x[0] for x in new]), np.concatenate([x[1] for x in new])
        for i in range(len(self.filters)):
            codes = np.concatenate([_large(x[2][i][0], x[2][i][1]) for x in new])
            null = np.concatenate([np.zeros(len(x[0]), dtype=bool) if x[2][i][2] is None else np.unpackbits(x[2][i][2], count=len(x[0])).astype(bool) for x in new])
            values, nulls = self.sums[i]
            more = [(keys[m], codes[m], n[m]) for m in (~null, null)] if null.any() else [(keys, codes, n), (_NONE,) * 3]
            more[1] = (more[1][0], np.zeros_like(more[1][1]), more[1][2])
            self.sums[i] = tuple(added(*(np.concatenate(x) for x in zip(old, some, strict=True))) for old, some in zip((values, nulls), more, strict=True))


def _tally(b: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different (b, d), and how often they occur."""
    if not len(b):
        return _NONE, _NONE, _NONE
    wide = int(d.max()) + 1
    if (int(b.max()) + 1) * wide < 1 << 62:
        each = b * wide + d
        if int(each.max()) <= 4 * len(each) + 10_000:
            n = np.bincount(each)
            each = np.flatnonzero(n)
            n = n[each]
        else:
            each, n = np.unique(each, return_counts=True)
        return each // wide, each % wide, n
    return added(b, d, np.ones(len(b), dtype=np.int64))


def _summed(k: np.ndarray, b: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """b and the sum of n, for all different (k, b)."""
    _, b, n = added(k, b, n)
    return b, n


def _tallies(f: Filter, values, nulls) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """what, b, d, n from the sums of a part."""
    _, _, n = nulls
    yield BUCKET, *_tally(np.full(len(n), NULL), n)
    keys, codes, n = values
    if not len(keys):
        return
    k = np.cumsum(np.concatenate(([0], keys[1:] != keys[:-1])))
    yield BUCKET, *_tally(np.full(int(k[-1]) + 1, NOT_NULL), np.bincount(k, n).astype(np.int64))
    base, bins = f.base(codes), len(f.edges) + 1
    cuts = np.searchsorted(k, np.arange(0, int(k[-1]) + 1 + SLICE, SLICE))
    for start, end in zip(cuts[:-1], cuts[1:], strict=True):
        own = k[start:end] - k[start] if end > start else _NONE
        if f.intervals and len(own):
            sums = np.bincount(own * bins + base[start:end], n[start:end], (int(own[-1]) + 1) * bins).astype(np.int64).reshape(-1, bins)
            upto = np.concatenate((np.zeros((len(sums), 1), dtype=np.int64), np.cumsum(sums, axis=1)), axis=1)
            for at, (first, last) in enumerate(f.intervals):
                d = upto[:, last + 1] - upto[:, first]
                d = d[d > 0]
                yield BUCKET, *_tally(np.full(len(d), FIRST + at), d)
    for lists, what, first in ((f.gram_lists, BUCKET, f.first_gram), (f.rare_lists, GRAM, 0)):
        for start, end in _chunks(k, 4 * SLICE) if lists is not None else ():
            at, g = lists.spread(codes[start:end])
            b, d = _summed(k[start:end][at], g, n[start:end][at])
            yield what, *_tally(b + first, d)
    place = f.place(codes)
    hit = place >= 0
    yield BUCKET, *_tally(place[hit] + f.first_value, n[hit])
    rest = ~hit if f.kind == "text" else ~hit & (n > 1)  # keys with one row are known from the values' rows
    order = np.lexsort((n[rest], codes[rest]))
    yield VALUE, *added(codes[rest][order], n[rest][order], np.ones(len(order), dtype=np.int64))


def _chunks(k: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Starts and ends of about so many rows that hold all of their keys; k ascends."""
    start = 0
    while start < len(k):
        end = min(start + size, len(k))
        if end < len(k):
            end = int(np.searchsorted(k, k[end], "left"))
        if end <= start:
            end = int(np.searchsorted(k, k[start], "right"))
        yield start, end
        start = end


def counted(filters: list[Filter]):
    """A function of batches of part, blob: rows of RESULT."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, _Held] = {}
        for b in batches:
            for blob in b.column("blob"):
                c, keys, n, coded = pickle.loads(blob.as_buffer())
                held.setdefault(c, _Held(filters)).take(keys, n, coded)
        for c in list(held):
            own = held.pop(c)
            own.fold()
            for i, f in enumerate(filters):
                made, own.sums[i] = own.sums[i], None
                for what, b, d, n in _tallies(f, *made):
                    if len(b):
                        x = b.view(np.float64) if what == VALUE and f.kind == "double" else None
                        same = lambda v, m=len(b): pa.array(np.full(m, v, dtype=np.int32))
                        yield pa.RecordBatch.from_arrays(
                            [same(what), same(i), same(c), pa.array(b if x is None else np.zeros_like(b)), pa.nulls(len(b), pa.float64()) if x is None else pa.array(x), pa.array(d.astype(np.int64)), pa.array(n.astype(np.int64))],
                            ["what", "i", "c", "b", "x", "d", "n"],
                        )

    return run


def row_sums(filters: list[Filter]):
    """A function of batches of i, f, b, x, n (values and their rows): what, i, b, n. Rows of null, of each base bucket (from FIRST on),
    of common values and grams, numbered after the intervals; of rare values (the most of one, b -1) and of rare grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which = batch.column("i").to_numpy()
            for i, f in enumerate(filters):
                own = batch.filter(pa.array(which == i))
                n = own.column("n").to_numpy(zero_copy_only=False)
                codes, null = f.codes(own.column({"text": "f", "double": "x", "long": "b"}[f.kind]))
                null = np.zeros(len(n), dtype=bool) if null is None else null
                codes, valid = codes[~null], n[~null]
                found = [(0, np.full(int(null.sum()), NULL), n[null]), (1, f.base(codes), valid)]
                place = f.place(codes)
                found.append((2, place[place >= 0], valid[place >= 0]))
                found.append((3, np.full(int((place < 0).sum()), 0), valid[place < 0]))
                for what, lists in ((4, f.gram_lists), (5, f.rare_lists)):
                    if lists is not None:
                        at, g = lists.spread(codes)
                        found.append((what, g, valid[at]))
                for what, b, m in found:
                    if len(b):
                        if what == 3:
                            b, m = b[:1], np.array([m.max()])
                        else:
                            b, m = _summed(np.zeros(len(b), dtype=np.int64), b.astype(np.int64), m)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b), what, dtype=np.int32)), pa.array(np.full(len(b), i, dtype=np.int32)), pa.array(b.astype(np.int64)), pa.array(m.astype(np.int64))], ["what", "i", "b", "n"])

    return run
