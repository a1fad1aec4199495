"""Licence scans in DataFrame functions alone: sparse TF-IDF cosine to templates, then inheritance along paths.

What a text may say of its licence is cut out in several ways, and each unit is compared with the templates: sentences,
by lines and across lines, paragraphs (such as headers), and all paragraphs of the text that speak of licences together
(such as the whole of a licence file). Marks of comments are left out. A paragraph or sentence speaks of licences if it
holds one of MARKS, as every template does and every part of a licence that could be alike to one alone. Terms weigh by
their rarity among all units of the corpus and the templates; a unit that occurs often is compared once and counted as
often as it occurs. The longest unit that is like a template decides, so that a phrase which many licences share
doesn't outvote a body; an SPDX identifier comes before all. A file mostly made of notices, or named like a licence
file, speaks for its directory, and a file without a licence of its own takes that of its nearest ancestor directory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import looked_up, stored
from .license_texts import MARKS, TEMPLATES

MARK = "|".join(MARKS)
LICENCE_FILE = r"(^|/)(licen[cs]es?|copying|unlicense)([.\-_][^/]*)?$"
LEADERS = r"^[ \t]*(//+|/\*+|\*+/?|#+|--+|;+|<!--)[ \t]*"
SPDX = r"spdx-license-identifier:[ \t]*([a-z0-9.+-]+)"
BLANK_LINE = r"\n[ \t\r]*\n"
SENTENCE_END = r"([.!?])[ \t]+"
LEAST_COSINE = 0.7
#: Hundredths of a file's words that notices must be, for it to speak for its directory.
LEAST_SHARE = 50


def _lower(text: Column) -> Column:
    return F.lower(F.coalesce(text.cast("string"), F.lit("")))


def canonical(text: Column) -> Column:
    """The terms of a lower-case text, a blank between each two."""
    return F.trim(F.regexp_replace(text, "[^a-z0-9]+", " "))


def n_terms(unit: Column) -> Column:
    return F.when(unit == "", F.lit(0)).otherwise(F.size(F.split(unit, " "))).cast("long")


def units(low: Column) -> Column:
    """(kind, i, unit) of a lower-case text, in canonical form: 0 sentences by lines, 1 sentences across lines, 2 paragraphs, 3 all paragraphs."""
    marked = lambda a: F.filter(a, lambda x: x.rlike(MARK))
    cut = lambda x: F.split(F.regexp_replace(x, SENTENCE_END, "$1\n"), "\n")
    named = lambda kind, a: F.transform(a, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), canonical(x).alias("unit")))
    plain = F.regexp_replace(low, "(?md)" + LEADERS, "")
    paragraphs = marked(F.split(plain, BLANK_LINE))
    across = marked(F.flatten(F.transform(paragraphs, lambda x: cut(F.replace(x, F.lit("\n"), F.lit(" "))))))
    return F.concat(named(0, marked(cut(plain))), named(1, across), named(2, paragraphs), named(3, F.array(F.concat_ws(" ", paragraphs))))


def spdx_name(low: Column) -> Column:
    """The licence that the first SPDX identifier names, null if there is none or it is none of the templates'."""
    name = F.regexp_replace(F.regexp_extract(low, SPDX, 1), r"(-only|-or-later|\+)$", "")
    known = sorted({license for license, _ in TEMPLATES})
    return F.coalesce(*(F.when(name == x.lower(), F.lit(x)) for x in known))


def matches(found: DataFrame) -> DataFrame:
    """found: u1, u2 (a unit's name), unit, n (occurrences), each once. u1, u2, license, cosine of its best template at
    LEAST_COSINE or more. Units are long, so only their names go along with their terms."""
    name = ["u1", "u2"]
    spark = found.sparkSession
    made = [(t, license, term) for t, (license, text) in enumerate(TEMPLATES) for term in _plain_terms(text)]
    template = spark.createDataFrame(made, "t int, license string, term string").groupBy("t", "license", "term").agg(F.count("*").alias("tf"))
    own = found.select(*name, "n", F.explode(F.split("unit", " ")).alias("term")).groupBy(*name, "term").agg(F.count("*").alias("tf"), F.first("n").alias("n"))
    own = stored(own, "licence-terms")
    both = own.groupBy("term").agg(F.sum("n").alias("df")).unionByName(template.groupBy("term").agg(F.count("*").alias("df")))
    total = (found.agg(F.sum("n")).first()[0] or 0) + len(TEMPLATES)
    idf = both.groupBy("term").agg(F.sum("df").alias("df")).select("term", (F.log((1.0 + F.lit(total)) / (1.0 + F.col("df"))) + 1.0).alias("idf"))
    weigh = lambda df: df.join(idf, "term").withColumn("w", F.col("tf") * F.col("idf"))
    left, right = weigh(own), weigh(template)
    right = right.join(right.groupBy("t").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size")), "t").select("t", "license", "term", (F.col("w") / F.col("size")).alias("v"))
    sizes = left.groupBy(*name).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"))
    dots = left.join(F.broadcast(right), "term").groupBy(*name, "t", "license").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))  # right: the templates' terms
    scored = dots.join(sizes, name).select(*name, "license", F.round(F.col("dot") / F.col("size"), 6).alias("cosine")).where(F.col("cosine") >= LEAST_COSINE)
    best = scored.groupBy(*name).agg(F.min(F.struct((-F.col("cosine")).alias("c"), F.col("license"))).alias("m"))
    return best.select(*name, "m.license", (-F.col("m.c")).alias("cosine"))


def _plain_terms(text: str) -> list[str]:
    out, word = [], ""
    for c in text.lower() + " ":
        if c.isascii() and c.isalnum():
            word += c
        elif word:
            out.append(word)
            word = ""
    return out


def _directory(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def scan(files: DataFrame) -> DataFrame:
    """files: doc_id, path, text. doc_id, path, own_license, cosine, license, inherited_from, levels for each row.

    own_license is that of an SPDX identifier, else of the longest unit (in terms) that is like a template, then of
    highest cosine, then of least name; license is it or the inherited one, with the directory it comes from and how
    many levels above the file's own directory that is. Of several files that speak for one directory the same order
    decides. Null text has no licence; a null path is '', which lies in the root ''. Repeated rows each get their row;
    other columns are ignored; no rows give no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = files.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("path").cast("string"), F.lit("")).alias("path"), text.alias("text"))
    low = rows.select("path", F.xxhash64("text").alias("h"), F.lower("text").alias("low"))
    speaks_of = F.lit(False)
    for mark in MARKS:
        speaks_of = speaks_of | F.contains("low", F.lit(mark))
    marked = low.where(speaks_of).select("path", "h", n_terms(canonical(F.col("low"))).alias("words"), spdx_name(F.col("low")).alias("spdx"), units(F.col("low")).alias("u"))
    marked = stored(marked.dropDuplicates(["path", "h"]), "licence-units")
    each = marked.select("path", "h", "words", F.explode("u").alias("u")).select("path", "h", "words", "u.kind", "u.unit").where("unit <> ''")
    each = stored(each.withColumns({"u1": F.xxhash64("unit"), "u2": F.xxhash64(F.lit(1), "unit"), "of": n_terms(F.col("unit"))}), "licence-each")
    best = stored(matches(each.groupBy("u1", "u2").agg(F.first("unit").alias("unit"), F.count("*").alias("n"))), "licence-matches")
    hits = each.join(best, ["u1", "u2"]).select("path", "h", "words", "kind", "license", "cosine", "of")
    named = marked.where("spdx is not null").select("path", "h", "words", F.lit(-1).alias("kind"), F.col("spdx").alias("license"), F.lit(1.0).alias("cosine"), F.lit(0).cast("long").alias("of"))
    first = F.when(F.col("kind") < 0, F.lit(-(2**31))).otherwise(-F.col("of")).alias("size")
    by_kind = hits.union(named).groupBy("path", "h", "kind").agg(F.min(F.struct(first, (-F.col("cosine")).alias("c"), "license")).alias("m"), F.sum("of").alias("of"), F.first("words").alias("words"))
    own = by_kind.groupBy("path", "h").agg(F.min("m").alias("m"), F.max("of").alias("of"), F.first("words").alias("words"))
    own = stored(own.select("path", "h", "m", F.col("m.license").alias("own_license"), (-F.col("m.c")).alias("cosine"), "of", "words"), "licence-own")
    speaks = (100 * F.col("of") >= LEAST_SHARE * F.col("words")) | F.lower("path").rlike(LICENCE_FILE)
    declared = own.where(speaks).groupBy(_directory(F.col("path")).alias("dir")).agg(F.min("m").alias("m")).select(F.col("dir").alias("above"), F.col("m.license").alias("inherited"))
    # resolve each directory once, whatever the number of its files
    dirs = rows.select(_directory(F.col("path")).alias("dir")).distinct()
    parts = F.split("dir", "/")
    depth = F.when(F.col("dir") == "", F.lit(0)).otherwise(F.size(parts))
    ups = dirs.select("dir", F.explode(F.transform(F.sequence(F.lit(0), depth), lambda k: F.struct(k.alias("levels"), F.array_join(F.slice(parts, F.lit(1), depth - k), "/").alias("above")))).alias("u")).select("dir", "u.levels", "u.above")
    nearest = F.min(F.struct("levels", F.col("above").alias("from_dir"), "inherited")).alias("near")
    inherits = stored(ups.join(declared, "above").groupBy("dir").agg(nearest), "licence-dirs").select("dir", "near.*")
    keyed = rows.select("doc_id", "path", F.xxhash64("text").alias("h"), _directory(F.col("path")).alias("dir")).join(own.select("path", "h", "own_license", "cosine"), ["path", "h"], "left")
    out = looked_up(keyed, inherits, ["dir"], F.col("h"), "left")  # a directory may hold very many files
    takes = F.col("own_license").isNull() & F.col("inherited").isNotNull()
    return out.select(
        "doc_id", "path", "own_license", "cosine", F.coalesce("own_license", "inherited").alias("license"),
        F.when(takes, F.col("from_dir")).alias("inherited_from"), F.when(takes, F.col("levels")).cast("int").alias("levels"),
    )


def as_files(docs: DataFrame) -> DataFrame:
    """Documents as files in the tree source/lang/doc_id."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return docs.select("doc_id", F.concat_ws("/", name("source"), name("lang"), name("doc_id")).alias("path"), "text")


def _sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    values = ", ".join(f"({t}, {quoted(license)}, {quoted(text)})" for t, (license, text) in enumerate(TEMPLATES))
    known = ", ".join(f"({quoted(x)})" for x in sorted({license for license, _ in TEMPLATES}))
    norm = lambda x: f"trim(regexp_replace({x}, '[^a-z0-9]+', ' ', 'g'))"
    size = lambda x: f"(CASE WHEN {x} = '' THEN 0 ELSE len(string_split({x}, ' ')) END)"
    cut = lambda x: f"string_split(regexp_replace({x}, '{SENTENCE_END}', '\\1' || chr(10), 'g'), chr(10))"
    return rf"""
WITH tt AS (SELECT t, license, term, count(*) AS tf FROM (SELECT t, license, unnest(string_split({norm("lower(body)")}, ' ')) AS term FROM (VALUES {values}) AS v(t, license, body)) GROUP BY ALL),
known AS (SELECT * FROM (VALUES {known}) AS k(license)),
f AS (SELECT doc_id, concat_ws('/', coalesce(source, ''), coalesce(lang, ''), doc_id) AS path, lower(coalesce(text, '')) AS low FROM documents),
m AS (SELECT *, regexp_replace(low, '(?m){LEADERS}', '', 'g') AS plain FROM f WHERE regexp_matches(low, '{MARK}')),
p AS (SELECT doc_id, path, low, plain, list_filter(string_split_regex(plain, '{BLANK_LINE}'), lambda x: regexp_matches(x, '{MARK}')) AS ps FROM m),
e AS (SELECT doc_id, 0 AS kind, unnest({cut("plain")}) AS part FROM p
      UNION ALL SELECT doc_id, 1, unnest(string_split(regexp_replace(replace(x, chr(10), ' '), '{SENTENCE_END}', '\1' || chr(10), 'g'), chr(10))) FROM (SELECT doc_id, unnest(ps) AS x FROM p)
      UNION ALL SELECT doc_id, 2, unnest(ps) FROM p
      UNION ALL SELECT doc_id, 3, array_to_string(ps, ' ') FROM p),
s AS (SELECT doc_id, kind, {norm("part")} AS unit FROM e WHERE regexp_matches(part, '{MARK}')),
u AS (SELECT unit, count(*) AS n FROM s WHERE unit <> '' GROUP BY unit),
o AS (SELECT unit, n, term, count(*) AS tf FROM (SELECT unit, n, unnest(string_split(unit, ' ')) AS term FROM u) GROUP BY ALL),
d AS (SELECT term, sum(df) AS df FROM (SELECT term, sum(n) AS df FROM o GROUP BY term UNION ALL SELECT term, count(*) AS df FROM tt GROUP BY term) GROUP BY term),
x AS (SELECT term, ln((1.0 + (SELECT coalesce(sum(n), 0) FROM u) + {len(TEMPLATES)})::DOUBLE / (1.0 + df)::DOUBLE) + 1.0 AS idf FROM d),
l AS (SELECT unit, term, tf * idf AS w FROM o JOIN x USING (term)),
r AS (SELECT t, license, term, tf * idf AS w FROM tt JOIN x USING (term)),
ls AS (SELECT unit, sqrt(sum(w * w)) AS size FROM l GROUP BY unit),
rs AS (SELECT t, sqrt(sum(w * w)) AS size FROM r GROUP BY t),
c AS (SELECT unit, t, license, round(sum(l.w * r.w / rs.size) / max(ls.size), 6) AS cosine FROM l JOIN r USING (term) JOIN rs USING (t) JOIN ls USING (unit) GROUP BY ALL),
b AS (SELECT unit, license, cosine FROM c WHERE cosine >= {LEAST_COSINE} QUALIFY row_number() OVER (PARTITION BY unit ORDER BY cosine DESC, license) = 1),
sp AS (SELECT doc_id, known.license FROM p JOIN known ON lower(known.license) = regexp_replace(regexp_extract(low, '{SPDX}', 1), '(-only|-or-later|\+)$', '')),
h AS (SELECT doc_id, kind, b.license, b.cosine, {size("unit")}::BIGINT AS "of", -{size("unit")}::BIGINT AS rank FROM s JOIN b USING (unit)
      UNION ALL SELECT doc_id, -1, license, 1.0, 0, -2147483648 FROM sp),
w AS (SELECT doc_id, license AS own_license, cosine, rank FROM h QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY rank, cosine DESC, license) = 1),
n AS (SELECT doc_id, max("of") AS "of" FROM (SELECT doc_id, kind, sum("of") AS "of" FROM h GROUP BY ALL) GROUP BY doc_id),
g AS (SELECT regexp_replace(path, '/?[^/]*$', '') AS dir, own_license AS inherited FROM w JOIN n USING (doc_id) JOIN p USING (doc_id)
      WHERE 100 * "of" >= {LEAST_SHARE} * {size(norm("low"))} OR regexp_matches(lower(path), '{LICENCE_FILE}')
      QUALIFY row_number() OVER (PARTITION BY dir ORDER BY rank, cosine DESC, own_license) = 1),
pp AS (SELECT doc_id, path, regexp_replace(path, '/?[^/]*$', '') AS dir FROM f),
q AS (SELECT DISTINCT dir, unnest(range(0, len(string_split(dir, '/')) + 1)) AS levels FROM pp),
k AS (SELECT q.dir, q.levels, g.dir AS above, g.inherited FROM q JOIN g ON g.dir = array_to_string(string_split(q.dir, '/')[1 : len(string_split(q.dir, '/')) - levels], '/')
      QUALIFY row_number() OVER (PARTITION BY q.dir ORDER BY q.levels) = 1)
SELECT pp.doc_id, pp.path, own_license, cosine, coalesce(own_license, inherited) AS license,
       CASE WHEN own_license IS NULL AND inherited IS NOT NULL THEN above END AS inherited_from,
       CASE WHEN own_license IS NULL AND inherited IS NOT NULL THEN levels::INTEGER END AS levels
FROM pp LEFT JOIN w ON w.doc_id = pp.doc_id LEFT JOIN k ON k.dir = pp.dir
"""


SQL = _sql()
