"""Mixing sources to target weights by temperature.

A source's weight is its share of all tokens to the power of an exponent, normalised: 1 keeps the shares, 0 makes
sources equal. The exponent is bisected to the largest that reaches the target entropy; if some source would then be
repeated more than the limit, it is bisected to the smallest that keeps the limit. Each source's token budget is then
spent in epochs: whole passes over its blocks of documents, each in a permutation of its own, and of the last pass as
many blocks as the budget allows, the last of them in part. Tokens are ids of the tokenizer that later stages use.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import looked_up, stored
from .tokens import encoder


@dataclass(frozen=True)
class Mix:
    #: Target entropy as a share of the greatest that this number of sources can have.
    entropy_share: float = 0.95
    #: The most times a source's tokens may be used.
    max_repeats: float = 4.0
    #: Tokens of the mix as a multiple of the tokens there are.
    budget_share: float = 1.0
    block_tokens: int = 1 << 20
    tokenizer: str = "byte_bpe_50k.json"
    seed: int = 1


#: Halvings for each job: its 2 ** DEPTH - 1 exponents are all the middles that so many halvings may ask for.
DEPTH, ROUNDS = 6, 5


def _source() -> Column:
    return F.coalesce(F.col("source").cast("string"), F.lit(""))


def token_counts(docs: DataFrame, mix: Mix) -> DataFrame:
    """doc_id, src, key (that of `_row_key`) and tokens (ids, and one for the end) of each row of docs."""

    def count(batches):
        enc = encoder(mix.tokenizer)
        for b in batches:
            tokens = [len(x) // 4 + 1 for x in enc.encode(b.column("text").to_pylist())]
            yield b.drop_columns(["text"]).append_column("tokens", pa.array(tokens, pa.int64()))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _source().alias("src"), _row_key(mix.seed).alias("key"), F.col("text").cast("string").alias("text"))
    return stored(rows.mapInArrow(count, "doc_id long, src string, key long, tokens long"), "mix-rows")


def _row_key(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")))


def weights_at(shares: DataFrame, exponents: list[float]) -> list[tuple[float, float]]:
    """For each exponent the entropy of the weights and the greatest ratio of weight to share. shares: p above zero."""
    each = shares.select("p", F.explode(F.array(*map(F.lit, exponents))).alias("x"))
    power = F.exp(F.col("x") * F.log("p"))
    rows = each.groupBy("x").agg(F.sum(power).alias("z"), F.sum(power * F.log("p")).alias("l"), F.min("p").alias("least"), F.max("p").alias("most")).collect()
    found = {r["x"]: (math.log(r["z"]) - r["x"] * r["l"] / r["z"], max(r["least"] ** (r["x"] - 1), r["most"] ** (r["x"] - 1)) / r["z"]) for r in rows}
    return [found[x] for x in exponents]


def _bisect(shares: DataFrame, low_side) -> float:
    """The greatest exponent in 0 to 1, to 2 ** -(DEPTH * ROUNDS), up to which low_side(entropy, ratio) holds; it holds up to some point."""
    lo, hi = 0.0, 1.0
    if low_side(*weights_at(shares, [1.0])[0]):
        return 1.0
    for _ in range(ROUNDS):
        n = 2**DEPTH
        grid = [lo + (hi - lo) * i / n for i in range(1, n)]
        holds = [low_side(*x) for x in weights_at(shares, grid)]
        a, b = 0, n
        for _ in range(DEPTH):
            mid = (a + b) // 2
            a, b = (mid, b) if holds[mid - 1] else (a, mid)
        lo, hi = lo + (hi - lo) * a / n, lo + (hi - lo) * b / n
    return lo


def find_exponent(shares: DataFrame, mix: Mix = Mix()) -> float:  # noqa: B008
    """shares: a row for each source with p, its share of the tokens."""
    n = shares.count()
    if n < 2:
        return 1.0
    target = mix.entropy_share * math.log(n)
    x = _bisect(shares, lambda entropy, ratio: entropy >= target)
    limit = max(mix.max_repeats / mix.budget_share, 1.0)
    if weights_at(shares, [x])[0][1] <= limit * (1 + 1e-9):
        return x
    return min(1.0, _bisect(shares, lambda entropy, ratio: ratio > limit) + 2.0 ** -(DEPTH * ROUNDS))


#: Parts of the order of a source's blocks that are summed first.
PARTS = 1024


def plan(rows: DataFrame, mix: Mix = Mix()) -> DataFrame:  # noqa: B008
    """rows: of token_counts. A row for each block of documents that is used: src, block, blocks (of the source), cut
    (null, or the greatest row key of its last use, in part), part (the epoch of that use) and at (its epochs, with its
    place in the source's stream, as a share of it)."""
    totals = rows.groupBy("src").agg(F.sum("tokens").alias("total"))
    total = totals.agg(F.sum("total")).first()[0] or 0
    shares = stored(totals.withColumn("p", F.col("total") / F.lit(float(total or 1))), "mix-shares")
    x = find_exponent(shares, mix)
    z = shares.agg(F.sum(F.pow("p", F.lit(x)))).first()[0] or 1.0
    budget = F.floor(F.pow("p", F.lit(x)) / F.lit(z) * F.lit(mix.budget_share * total) + F.lit(1e-6)).cast("long")
    sources = stored(shares.select("src", "total", budget.alias("budget"), F.ceil(F.col("total") / F.lit(mix.block_tokens)).alias("blocks")), "mix-sources")
    dealt = looked_up(rows, sources, ["src"], F.col("key")).withColumn("block", block_of(mix.seed, F.col("key"), F.col("blocks")))
    blocks = dealt.groupBy("src", "block").agg(F.sum("tokens").alias("size"), F.first("total").alias("total"), F.first("budget").alias("budget"), F.first("blocks").alias("blocks"))
    passes = F.sequence(F.lit(0).cast("long"), F.floor(F.col("budget") / F.col("total")))
    uses = blocks.withColumn("epoch", F.explode(passes)).withColumn("order", F.xxhash64(F.lit(mix.seed), "src", "epoch", "block"))
    # sums over what comes before, by parts of the order, so that no source is one task's work
    part = F.shiftright("order", 64 - int(math.log2(PARTS))).cast("int")
    uses = stored(uses.withColumn("segment", part), "mix-blocks")
    running = lambda keys, order: F.sum("size").over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    segments = uses.groupBy("src", "epoch", "segment").agg(F.sum("size").alias("size"))
    epochs = segments.groupBy("src", "epoch").agg(F.sum("size").alias("size"))
    epochs = epochs.select("src", "epoch", running(["src"], ["epoch"]).alias("before_epoch"))  # an epoch is one row
    segments = segments.withColumn("inside", running(["src", "epoch"], ["segment"])).join(epochs, ["src", "epoch"]).select("src", "epoch", "segment", (F.col("inside") + F.col("before_epoch")).alias("start"))
    uses = uses.withColumn("so_far", running(["src", "epoch", "segment"], ["order", "block"])).join(segments, ["src", "epoch", "segment"])
    uses = stored(uses.withColumn("before", F.col("so_far") + F.col("start")).where("before < budget"), "mix-uses")
    last = uses.where("before + size > budget").select("src", "block", (F.col("budget") - F.col("before")).alias("room"))  # one block of a source at most
    inside = dealt.select("src", "block", "key", "tokens").join(last, ["src", "block"])
    up_to = F.sum("tokens").over(Window.partitionBy("src", "block").orderBy("key").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    cuts = inside.withColumn("up_to", up_to).where("up_to <= room").groupBy("src", "block").agg(F.max("key").alias("cut"))
    full = F.col("before") + F.col("size") <= F.col("budget")
    place = (F.col("before") / F.col("budget")).alias("at")
    used = uses.groupBy("src", "block").agg(F.first("blocks").alias("blocks"), F.array_sort(F.collect_list(F.struct("epoch", place))).alias("at"), F.max(F.when(~full, F.col("epoch"))).alias("part"))
    return stored(used.join(cuts, ["src", "block"], "left").select("src", "block", "blocks", "cut", "part", "at"), "mix-plan")


def block_of(seed: int, key: Column, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.lit("block"), key), blocks)


def _used(rows: DataFrame, made: DataFrame, mix: Mix) -> DataFrame:
    """rows (src, key, others not called use, blocks, cut, part or at) with block and use, a struct of epoch and at, for each time that a row is used."""
    dealt = looked_up(rows, stored(made.groupBy("src").agg(F.first("blocks").alias("blocks")), "mix-known"), ["src"], F.col("key"))
    dealt = dealt.withColumn("block", block_of(mix.seed, F.col("key"), F.col("blocks"))).drop("blocks").join(made.drop("blocks"), ["src", "block"])
    mine = F.filter("at", lambda u: F.col("part").isNull() | (u["epoch"] != F.col("part")) | F.coalesce(F.col("key") <= F.col("cut"), F.lit(False)))
    return dealt.withColumn("use", F.explode(mine))


def schedule(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:  # noqa: B008
    """A row for each time a row of docs (doc_id, text, source) is used: doc_id, source, tokens, epoch, block, position.

    position (0 to 1) is where the block starts in its source's stream; sorting by it interleaves the sources by
    weight. Null text has the end token alone; a null source is the source ''; null doc_ids and repeated rows are
    used like any other, equal rows together. Other columns are ignored; no rows give no rows.
    """
    rows = token_counts(docs, mix)
    used = _used(rows, plan(rows, mix), mix)
    return used.select("doc_id", F.col("src").alias("source"), "tokens", F.col("use.epoch").alias("epoch"), "block", F.col("use.at").alias("position"))


def mixed(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:  # noqa: B008
    """The rows of docs, each as often as the mix uses it, with their columns."""
    rows = docs.select(F.struct("*").alias("row"), _source().alias("src"), _row_key(mix.seed).alias("key"))
    return _used(rows, plan(token_counts(docs, mix), mix), mix).select("row.*")
