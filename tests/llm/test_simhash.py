import xxhash

from rowceil.llm import common, simhash
from rowceil.llm.graph import components


def plain_print(text):
    words = []
    word = ""
    for c in (text or "") + " ":
        if c in common.BLANKS:
            if word:
                words.append(word)
            word = ""
        else:
            word += c.lower() if "A" <= c <= "Z" else c
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_groups(prints, radius=2):
    """prints: list of (doc_id, fingerprint); the smallest id reachable for each position."""
    ids = [i for i, _ in prints]
    label = list(range(len(prints)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= radius:
                label[root(i)] = root(j)
    best = {}
    for i in range(len(prints)):
        best[root(i)] = min(best.get(root(i), ids[i]), ids[i])
    return [best[root(i)] for i in range(len(prints))]


def test_whole_table_against_brute_force(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    prints = [(i, plain_print(t)) for i, t in rows]
    want = {i: (f"{fp:016x}", g) for (i, fp), g in zip(prints, plain_groups(prints), strict=True)}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == want


def test_odd_texts(spark, make_docs, odd_texts):
    rows = [(i + 3, t, "s") for i, t in enumerate(odd_texts)] + [(None, "a", "s"), (None, "only here, without an id", "s"), (3, None, "s"), (3, None, "s")]
    got = simhash.near_duplicates(make_docs(rows, extra=True)).collect()
    prints = [(i, plain_print(t)) for i, t, _ in rows if i is not None]
    want = sorted((i, f"{fp:016x}", g) for (i, fp), g in zip(prints, plain_groups(prints), strict=True))
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got if r.doc_id is not None) == want
    nulls = {r.fingerprint: r.component_id for r in got if r.doc_id is None}
    assert len(nulls) == 2 and None in nulls.values()
    assert simhash.near_duplicates(make_docs([])).count() == 0


def test_tiles_of_several_parts_find_the_same(spark, monkeypatch):
    import random

    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(60)]
    fps = {b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(3))) & (2**64 - 1) for b in base for _ in range(8)} | {0, 1, 3, 7, 2**64 - 1, 2**63}
    prints = sorted((i, fp) for i, fp in enumerate(sorted(fps)))
    df = spark.createDataFrame([(i, fp - 2**64 if fp >= 2**63 else fp) for i, fp in prints], "node long, fp long")
    want = plain_groups(prints)
    names = {fp - 2**64 if fp >= 2**63 else fp: i for i, fp in prints}
    for tile in (8192, 2):
        monkeypatch.setattr(simhash, "TILE", tile)
        found = {names[r.node]: r.component for r in components(simhash.links(df.select("fp"), 2)).collect()}
        least = {}
        for i, c in found.items():
            least[c] = min(i, least.get(c, i))
        assert [least[found[i]] if i in found else i for i, _ in prints] == want


def test_clean_keeps_one_row_of_each_group_and_no_text_is_lost(make_docs):
    from pyspark.sql import functions as F

    a, b = "one text of several words that stands alone", "quite another text that others nearly copy, word for word"
    docs = make_docs([(1, a, "s"), (7, a, "s"), (7, b, "s"), (9, b, "t"), (9, b, "s"), (None, "a text without an id", "s"), (None, "a text without an id", "s"), (None, "one more text without an id", "s")])
    for c in ("_d", "fp", "key_id", "row", "group"):
        docs = docs.withColumn(c, F.lit("x"))
    out = simhash.clean(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert sorted(((r.doc_id, r.text) for r in rows), key=repr) == sorted([(1, a), (7, b), (None, "a text without an id"), (None, "one more text without an id")], key=repr)
    assert all(r.fp == r.group == r._d == "x" for r in rows)
    assert simhash.clean(make_docs([])).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (7, 8), (8, 7), (None, 3), (500, None), (300, 139)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)} | {300: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
