"""Packing documents into sequences of fixed length: shortest-pack-first over the histogram of lengths.

A document's ids (with the end id) are cut into pieces of the full length and one rest. The histogram of piece
lengths has at most as many rows as a sequence has ids, so packing runs on the driver whatever the number of
documents: lengths go longest first, each into the open pattern that is filled least and still has room, as many
copies at once as there are. Pieces then meet their places by rank among pieces of their length: for rests the rank is
counted within (length, part), with as many parts as the counts ask for; pieces of the full length are numbered where
they are cut, and tasks follow each other.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored
from .tokens import END_ID, encoder

#: Pieces of one length that are ranked together, about.
RANKED = 250_000
NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
PIECES = ", ".join(f"{x} long" for x in NAMES)


def pack_histogram(counts: dict[int, int], room: int) -> list[tuple[tuple[int, ...], int]]:
    """counts: pieces by length, 1 to room. Returns patterns (lengths, longest first) and how many sequences have each.

    The order of the result and the choice among equals are fixed by the lengths alone.
    """
    if any(n and not 0 < length <= room for length, n in counts.items()):
        raise ValueError("a piece doesn't fit")
    open_: dict[int, list[list]] = {}  # by free ids
    frees: list[int] = []
    full: list[tuple[tuple[int, ...], int]] = []

    def put(pattern: tuple[int, ...], n: int, free: int) -> None:
        if not free:
            full.append((pattern, n))
        elif free in open_:
            open_[free].append([pattern, n])
        else:
            open_[free] = [[pattern, n]]
            insort(frees, free)

    for length in sorted((x for x, n in counts.items() if n), reverse=True):
        left = counts[length]
        while left and frees and frees[-1] >= length:
            free = frees[-1]
            pattern, n = open_[free].pop()
            if not open_[free]:
                del open_[free]
                frees.pop()
            used = min(n, left)
            if n > used:
                put(pattern, n - used, free)
            put((*pattern, length), used, free - length)
            left -= used
        if left:
            times = room // length  # none is open that has room: new ones, filled with this length alone
            if times > 1 and left >= times:
                put((length,) * times, left // times, room - times * length)
                left %= times
            if left:
                put((length,) * left, 1, room - left * length) if left * length <= room else put((length,), left, room - length)
    return full + [(p, n) for free in sorted(frees) for p, n in open_[free]]


class Places:
    """Sequence and offset of the piece with a given length and rank among pieces of that length."""

    def __init__(self, patterns: list[tuple[tuple[int, ...], int]], room: int) -> None:
        rows: list[list[tuple[int, int, int, int]]] = [[] for _ in range(room + 1)]
        ranks, base = [0] * (room + 1), 0
        for pattern, n in patterns:
            offset, i = 0, 0
            while i < len(pattern):
                length, times = pattern[i], pattern.count(pattern[i])
                rows[length].append((ranks[length], base, times, offset))
                ranks[length] += times * n
                offset += times * length
                i += times
            base += n
        self.table = {length: np.array(r, dtype=np.int64).T for length, r in enumerate(rows) if r}

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        for one in np.unique(length):
            at = np.flatnonzero(length == one)
            first, base, times, start = self.table[int(one)]
            i = np.searchsorted(first, rank[at], side="right") - 1
            into = rank[at] - first[i]
            sequence[at] = base[i] + into // times[i]
            offset[at] = start[i] + into % times[i] * one
        return sequence, offset


def cut_into_pieces(docs: DataFrame, tokenizer: str, room: int) -> DataFrame:
    """PIECES, and nth: of a piece of the full length its number among those of its task, from 0; null for others."""

    def cut(batches):
        enc, end, full = encoder(tokenizer), np.array([END_ID], dtype="<u4").tobytes(), 0
        for b in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for doc_id, ids in zip(b.column("doc_id").to_pylist(), enc.encode(b.column("text").to_pylist()), strict=True):
                ids = memoryview(ids + end)
                n = len(ids) // 4
                for start in range(0, n, room):
                    piece = ids[4 * start : 4 * (start + room)]
                    whole = len(piece) == 4 * room
                    for col, x in zip(out, (doc_id, start, len(piece) // 4, zlib.crc32(piece), n, full if whole else None), strict=True):
                        col.append(x)
                    full += whole
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "nth"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, PIECES + ", nth long")


def pack(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", room: int = 1024) -> DataFrame:
    """doc_id and text of docs, as pieces with a place in a sequence: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null text is empty: its document is the end id alone. Repeated rows are packed once each; a null doc_id stays
    null; other columns are ignored; no rows give no rows. Pieces of one length with equal doc_id and start have
    equal claims to their places, and their checksum decides.
    """
    pieces = stored(cut_into_pieces(docs, tokenizer, room).withColumn("task", F.spark_partition_id()), "pieces")
    total = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # room rows at most
    places = Places(pack_histogram(total, room), room)
    parts = [max(1, -(-total.get(length, 0) // RANKED)) for length in range(room + 1)]
    key = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.element_at(F.array(*map(F.lit, parts)), F.col("length").cast("int") + 1)).cast("int")
    rests = pieces.where("nth is null").withColumn("part", key)
    counts = rests.groupBy("length", "part").count().collect()  # a row for each RANKED pieces, and room more
    tasks = pieces.where("nth is not null").groupBy("task").count().collect()  # a row for each task that has cut documents
    before: dict[int, np.ndarray] = {length: np.zeros(n, dtype=np.int64) for length, n in enumerate(parts)}
    for length, part, n in map(tuple, counts):
        before[length][part] = n
    before = {length: np.cumsum(n) - n for length, n in before.items() if n.any()}
    first, so_far = np.zeros(max((r["task"] for r in tasks), default=0) + 1, dtype=np.int64), 0
    for task, n in sorted(map(tuple, tasks)):
        first[task], so_far = so_far, so_far + n

    def put(b, length, rank):
        sequence, offset = places.find(length, rank)
        return pa.RecordBatch.from_arrays([*(b.column(c) for c in NAMES), pa.array(sequence), pa.array(offset)], [*NAMES, "sequence_id", "offset"])

    def place(batches):
        for b in batches:
            length, part = b.column("length").to_numpy(), b.column("part").to_numpy()
            rank = b.column("n").to_numpy() - 1
            for one in np.unique(length).tolist():
                at = np.flatnonzero(length == one)
                rank[at] += before[one][part[at]]
            yield put(b, length, rank)

    def place_full(batches):
        for b in batches:
            yield put(b, b.column("length").to_numpy(), first[b.column("task").to_numpy()] + b.column("nth").to_numpy())

    ranked = rests.withColumn("n", F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "start", "ids_crc32")).cast("long"))
    schema = PIECES + ", sequence_id long, offset long"
    return ranked.mapInArrow(place, schema).union(pieces.where("nth is not null").mapInArrow(place_full, schema))
