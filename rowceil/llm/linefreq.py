"""Quality rules with cross-document line frequency, in DataFrame functions alone.

Base rules look at one text: its words, symbols, repeated lines, and the words that stand in three-word windows
found twice or more. The method then hashes normalised lines (lower case, runs of blanks as one, ends trimmed),
counts the distinct documents of each line in each host, removes lines above the limits, and rejects documents of
which too little is left. Documents are rows told apart by doc_id and text; with `Limits.by_text` exact copies of a
text within a host count once, so that copying a page does not make boilerplate of it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK_RUN, stored, words_of

SYMBOLS = r"[#*$%&|<>]"


@dataclass(frozen=True)
class Limits:
    """A line goes if at least min_docs documents of its host, and over max_share of them, have it (in hundredths)."""

    min_docs: int = 5
    max_share: int = 2
    least_words: int = 50
    max_repeat_share: int = 50
    #: A document goes if fewer than this many hundredths of its words are left.
    least_left: int = 50
    #: Whether to count distinct texts in place of distinct documents.
    by_text: bool = False


def let(value: Column, body) -> Column:
    """body(value), with value computed once for each row."""
    return F.transform(F.array(value), body)[0]


def repeat_words(words: Column) -> Column:
    """Words that stand in a three-word window found twice or more among `words`.

    Window hashes are sorted with the window's place in their low bits, so equal windows come to lie beside each
    other; a neighbour counts only if its three words are equal too.
    """

    def with_mask(w: Column, mask: Column) -> Column:
        window = lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2])
        keyed = F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: window(i).bitwiseAND(F.bitwise_not(mask)).bitwiseOR(i.cast("long"))))

        def same(x: Column, y: Column) -> Column:
            at = lambda k, j: w[(k.bitwiseAND(mask)).cast("int") + j]
            return x.bitwiseXOR(y).between(F.lit(0), mask) & (at(x, 0) == at(y, 0)) & (at(x, 1) == at(y, 1)) & (at(x, 2) == at(y, 2))

        def covered(k: Column) -> Column:
            again = F.filter(k, lambda x, i: ((i > 0) & same(x, F.get(k, i - 1))) | ((i < F.size(k) - 1) & same(x, F.get(k, i + 1))))
            places = F.sort_array(F.transform(again, lambda x: x.bitwiseAND(mask)))
            start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).cast("long").alias("last"))
            step = lambda a, p: F.struct((a["n"] + F.least(F.lit(3).cast("long"), p - a["last"])).alias("n"), p.alias("last"))
            return F.aggregate(places, start, step, lambda a: a["n"])

        return let(keyed, covered)

    mask_of = lambda w: (F.pow(F.lit(2.0), F.length(F.bin(F.size(w).cast("long")))).cast("long") - 1)
    return F.when(F.size(words) < 3, F.lit(0).cast("long")).otherwise(let(words, lambda w: let(mask_of(w), lambda m: with_mask(w, m))))


def base_stats(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """doc_id, host, text_hash and the base columns of each row; only these."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _host(docs), F.xxhash64(text).alias("text_hash"), words_of(text).alias("w"), lines.alias("l"))
    rows = rows.select("doc_id", "host", "text_hash", "w", F.concat_ws("", "w").alias("c"), (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"))
    rows = rows.select(
        "doc_id", "host", "text_hash", F.size("w").cast("long").alias("n_words"), F.length("c").cast("long").alias("word_chars"),
        (F.length("c") - F.length(F.regexp_replace("c", SYMBOLS, ""))).cast("long").alias("n_symbols"), "n_dup_lines", repeat_words(F.col("w")).alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < limits.least_words) | (100 * F.col("n_repeat_words") > limits.max_repeat_share * F.col("n_words"))
    return rows.withColumn("base_failed", failed)


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def _host(docs: DataFrame, column: str = "source") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("")).alias("host")


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, host, text_hash and the array of normalised lines, empty for lines without a word, in their places."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    norm = F.regexp_replace(F.lower(text), r"[\x20\x09\x0B-\x0D]+", " ")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _host(docs), F.xxhash64(text).alias("text_hash"), F.transform(F.split(norm, "\n"), lambda x: F.trim(x)).alias("l"))


def frequent_lines(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """host, line_hash, n_docs of the lines above the limits. Repeated rows are one document."""
    one = ["host", "text_hash"] if limits.by_text else ["host", "doc_id", "text_hash"]
    hashed = F.array_distinct(F.transform(F.filter("l", lambda x: x != ""), lambda x: F.xxhash64(x)))
    each = _lines(docs).select(*one, F.explode(hashed).alias("line_hash")).distinct()
    counts = each.groupBy("host", "line_hash").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") >= limits.min_docs)
    hosts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _host(docs), F.xxhash64(_text()).alias("text_hash")).select(*one).distinct().groupBy("host").agg(F.count("*").alias("host_docs"))
    return counts.join(hosts, "host").where(100 * F.col("n_docs") > limits.max_share * F.col("host_docs")).select("host", "line_hash", "n_docs")


def removals(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """For each row with lines above the limits: doc_id, host, text_hash, places of those lines, words in them."""
    often = stored(frequent_lines(docs, limits).select("host", "line_hash"), "frequent-lines")
    each = _lines(docs).select("doc_id", "host", "text_hash", F.posexplode("l").alias("place", "line")).where("line <> ''")
    words = (F.length("line") - F.length(F.replace(F.col("line"), F.lit(" "), F.lit(""))) + 1).cast("long")
    hit = each.select("doc_id", "host", "text_hash", "place", F.xxhash64("line").alias("line_hash"), words.alias("words")).join(often, ["host", "line_hash"])
    once = hit.groupBy("doc_id", "host", "text_hash", "place").agg(F.first("words").alias("words"))  # repeated rows
    return once.groupBy("doc_id", "host", "text_hash").agg(F.array_sort(F.collect_list("place")).alias("places"), F.sum("words").alias("words_removed"))


def _verdict(rows: DataFrame, gone: DataFrame, limits: Limits) -> DataFrame:
    g = gone.select(F.col("doc_id").alias("gone_id"), F.col("host").alias("gone_host"), F.col("text_hash").alias("gone_hash"), "places", F.col("words_removed").alias("gone_words"))
    joined = rows.join(g, F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("host") == F.col("gone_host")) & (F.col("text_hash") == F.col("gone_hash")), "left")
    removed = F.coalesce("gone_words", F.lit(0))
    left = 100 * (F.col("n_words") - removed) >= limits.least_left * F.col("n_words")
    return joined.withColumn("words_removed", removed).withColumn("kept", ~F.col("base_failed") & left).drop("gone_id", "gone_host", "gone_hash", "gone_words")


def judge(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """doc_id, the base columns, words_removed and kept for each row of docs (doc_id, text, source).

    Null text is a text without words, which fails; a null source is the host ''; null doc_ids stay null. Repeated
    rows each get their row. Rows are told apart by doc_id, host and text. Other columns are ignored.
    """
    return _verdict(base_stats(docs, limits), removals(docs, limits), limits).drop("places", "host", "text_hash")


def clean(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """The documents that are kept, with all their columns, their text without the lines above the limits."""
    verdict = _verdict(base_stats(docs, limits), removals(docs, limits), limits).where("not kept or places is not null")
    k = verdict.groupBy("doc_id", "host", "text_hash").agg(F.first("kept").alias("kept"), F.first("places").alias("places")).toDF("key_id", "key_host", "key_hash", "kept", "places")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), _host(docs), F.xxhash64(_text()).alias("text_hash"))
    joined = rows.join(k, F.col("doc_id").eqNullSafe(F.col("key_id")) & (F.col("host") == F.col("key_host")) & (F.col("text_hash") == F.col("key_hash")), "left")
    text = F.col("row.text").cast("string")
    rest = F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains(F.col("places"), i)), "\n")
    out = joined.where(F.coalesce("kept", F.lit(True))).select(F.col("row").withField("text", F.when(F.col("places").isNull(), text).otherwise(rest)).alias("row"))
    return out.select("row.*")


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, host, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
i AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS p, w FROM w WHERE len(w) >= 3),
g AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, w[p], w[p + 1], w[p + 2]) AS n FROM i),
r AS (SELECT doc_id, count(DISTINCT p + o) AS n FROM g, (VALUES (0), (1), (2)) AS o(o) WHERE g.n > 1 GROUP BY doc_id),
b AS (SELECT w.doc_id, host, text, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
             (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN r ON r.doc_id = w.doc_id),
s AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b),
e AS (SELECT doc_id, host, text, unnest(string_split(regexp_replace(lower(text), '[\x20\x09\x0B-\x0D]+', ' ', 'g'), chr(10))) AS line FROM d),
t AS (SELECT doc_id, host, text, trim(line, ' ') AS line FROM e WHERE trim(line, ' ') <> ''),
h AS (SELECT host, count(DISTINCT doc_id) AS n FROM d GROUP BY host),
c AS (SELECT t.host, t.line FROM t JOIN h USING (host) GROUP BY t.host, t.line HAVING count(DISTINCT t.doc_id) >= 5 AND 100 * count(DISTINCT t.doc_id) > 2 * max(h.n)),
x AS (SELECT doc_id, sum(length(line) - length(replace(line, ' ', '')) + 1)::BIGINT AS n FROM t JOIN c USING (host, line) GROUP BY doc_id)
SELECT s.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, coalesce(x.n, 0)::BIGINT AS words_removed,
       NOT base_failed AND 100 * (n_words - coalesce(x.n, 0)) >= 50 * n_words AS kept
FROM s LEFT JOIN x ON x.doc_id = s.doc_id
"""
