"""SimHash near-duplicates: fingerprints of word shingles, compared exactly in tiles of equal population counts.

Two 64-bit fingerprints that differ in at most `radius` bits have population counts, over the high and over the low
half, whose differences add up to no more than the radius. Distinct fingerprints are dealt into cells by these two
counts, and only tiles of cells that near each other are compared: numpy exclusive-or and bit counts over whole
tiles, every pair of such tiles, so no pair within the radius is missed. Each cell is cut into as many parts of about
TILE fingerprints as it needs, and a task holds one part of one cell and one part of each cell beside it, whatever the
input. Comparisons grow with the square of the number of distinct fingerprints, as exact comparison does.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .graph import Forest, components

TILE = 16_384
SEED = 42
_KEY = ["key_id", "key_null", "key_text"]


def fingerprint(text: str | None, size: int = 3) -> int:
    """The 64-bit SimHash of a text as an unsigned integer."""
    import xxhash

    words = (text or "").encode().lower().split()  # on bytes: only A-Z change, only the six ASCII blanks separate
    if not words:
        return 0
    whole = b" ".join(words)
    if len(words) <= size:
        shingles = [whole]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate(([0], ends[: -size]))
        shingles = [whole[a:b] for a, b in zip(starts.tolist(), (ends[size - 1 :] - 1).tolist(), strict=True)]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(x, SEED) for x in shingles], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), 65_536):
        bits = np.unpackbits(h[i : i + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a signed long) of each row."""

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(x) for x in b.column("text").to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _near(radius: int) -> list[tuple[int, int]]:
    """Steps between cells within the radius, one of each pair of opposite ones."""
    return [(x, y) for x in range(radius + 1) for y in range(-radius, radius + 1) if x + abs(y) <= radius and (x, y) >= (0, 0)]


def links(prints: DataFrame, radius: int) -> DataFrame:
    """prints: fp, each once. Pairs a, b of fingerprints that join the same groups as all pairs within the radius do.

    Each task returns a spanning forest of the pairs it finds, so the rows are fewer than the fingerprints it holds.
    """
    halves = prints.select("fp", F.bit_count(F.shiftrightunsigned("fp", 32)).alias("high"), F.bit_count(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))).alias("low"))
    cells = halves.groupBy("high", "low").count().collect()  # 33 x 33 rows at most
    steps = _near(radius)
    parts = np.zeros((33, 33), dtype=np.int64)
    for r in cells:
        parts[r["high"], r["low"]] = -(-r["count"] // TILE)
    most = max(1, int(parts.max()))
    meets = np.zeros_like(parts)  # the most parts that a cell beside has, or the cell itself
    for x, y in steps:
        meets[: 33 - x, max(0, -y) : 33 - max(0, y)] = np.maximum(meets[: 33 - x, max(0, -y) : 33 - max(0, y)], parts[x:, max(0, y) : 33 + min(0, y)])

    def deal(batches):
        for b in batches:
            fp, high, low = (b.column(c).to_numpy() for c in ("fp", "high", "low"))
            high, low = high.astype(np.int64), low.astype(np.int64)
            part = ((fp.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(24)) % parts[high, low].astype(np.uint64)).astype(np.int64)

            def rows(ok, cell, i, j, role):
                return pa.RecordBatch.from_arrays([pa.array((cell * most + i) * most + j), pa.array(np.full(int(ok.sum()), role)), pa.array(fp[ok])], ["tile", "role", "fp"])

            for j in range(int(meets[high, low].max(initial=0))):  # as the owner: meets part j of the cells beside it
                ok = meets[high, low] > j
                yield rows(ok, high[ok] * 33 + low[ok], part[ok], j, -1)
            for k, (x, y) in enumerate(steps):  # as the guest of the owner's parts
                h, w = high - x, low - y
                inside = (h >= 0) & (w >= 0) & (w < 33)
                owners = np.where(inside, parts[h * inside, w * inside], 0)
                for i in range(int(owners.max(initial=0))):
                    ok = (owners > i) & (part >= i) if (x, y) == (0, 0) else owners > i
                    if ok.any():
                        yield rows(ok, h[ok] * 33 + w[ok], i, part[ok], k)

    def compare(t: pa.Table) -> pa.Table:
        role, fp = t["role"].to_numpy(), t["fp"].to_numpy().view(np.uint64)
        own = fp[role < 0]
        forest, got = Forest(), []
        for k in range(len(steps)):
            guest = fp[role == k]
            rows = max(1, 4_000_000 // max(1, len(guest)))
            for i in range(0, len(own) if len(guest) else 0, rows):
                x, y = np.nonzero(np.bitwise_count(own[i : i + rows, None] ^ guest[None, :]) <= radius)
                for a, b in zip(own[i + x].view(np.int64).tolist(), guest[y].view(np.int64).tolist(), strict=True):
                    if forest.join(a, b):
                        got.append((a, b))
        return pa.table({"a": pa.array([g[0] for g in got], pa.int64()), "b": pa.array([g[1] for g in got], pa.int64())})

    return halves.mapInArrow(deal, "tile long, role long, fp long").groupBy("tile").applyInArrow(compare, "a long, b long")


def _groups(prints: DataFrame, radius: int) -> DataFrame:
    """fp and group (the least fingerprint reached, as a signed long) of each fingerprint in prints (fp, with repeats)."""
    distinct = stored(prints.select("fp").distinct(), "prints")
    found = components(links(distinct, radius)).select(F.col("node").alias("fp"), "component")
    return distinct.join(found, "fp", "left").select("fp", F.coalesce("component", "fp").alias("group"))


def near_duplicates(docs: DataFrame, radius: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits) and component_id of each row of docs, by doc_id and text.

    Rows whose fingerprints differ in at most `radius` bits are linked; component_id is the smallest doc_id that
    links reach, null if none of them has one. Null text is empty; texts without words have fingerprint zero and link
    like any other. Repeated rows and rows that share a doc_id link by their own fingerprints. Other columns are
    ignored; no rows give no rows.
    """
    made = stored(fingerprints(docs), "fingerprints")
    groups = stored(_groups(made, radius), "fingerprint-groups")
    least = made.groupBy("fp").agg(F.min("doc_id").alias("doc_id")).join(groups, "fp").groupBy("group").agg(F.min("doc_id").alias("component_id"))
    final = groups.join(least, "group").select("fp", "component_id")
    return made.join(final, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def clean(docs: DataFrame, radius: int = 2) -> DataFrame:
    """One row of docs, with all its columns, of each group that links join: that of least doc_id (null last), then of least hash of the text.

    Rows are told apart by doc_id and text; of rows equal in both, one stays. Texts that share a doc_id are rows of
    their own, so no text goes unless a row of its group stays. No rows give no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = lambda t: [F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("key_id"), F.col("doc_id").isNull().alias("key_null"), F.xxhash64(t).alias("key_text")]

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(x) for x in b.column("text").to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in _KEY), pa.array(fp)], [*_KEY, "fp"])

    made = stored(docs.select(*key(text), text.alias("text")).mapInArrow(run, "key_id long, key_null boolean, key_text long, fp long"), "fingerprints")
    first = F.min(F.struct("key_null", "key_id", "key_text"))
    best = made.groupBy("fp").agg(first.alias("k")).join(_groups(made, radius), "fp").groupBy("group").agg(F.min("k").alias("k")).select("k.*")
    rows = docs.select(*key(text), F.struct("*").alias("row"))
    return rows.join(best, _KEY, "left_semi").dropDuplicates(_KEY).select("row.*")

