import math
from collections import Counter

import pytest

from rowceil.llm import common, mixing
from rowceil.llm.mixing import Mix


def weights(shares, x):
    z = sum(p**x for p in shares)
    return [p**x / z for p in shares]


def entropy(w):
    return -sum(p * math.log(p) for p in w if p > 0)


@pytest.mark.parametrize("sizes", [(900, 50, 30, 20), (10, 10, 10), (1000, 1), (5,), (600, 300, 50, 25, 12, 6, 3, 2, 1, 1)])
def test_exponent(spark, sizes):
    p = [s / sum(sizes) for s in sizes]
    df = spark.createDataFrame([(x,) for x in p], "p double")
    for mix in (Mix(), Mix(entropy_share=0.8, max_repeats=1e9), Mix(max_repeats=1.5)):
        x = mixing.find_exponent(df, mix)
        w = weights(p, x)
        worst = max(a / b for a, b in zip(w, p, strict=True))
        assert worst <= mix.max_repeats * (1 + 1e-6)
        if worst < mix.max_repeats * (1 - 1e-3) and len(p) > 1:  # the limit doesn't bind: the target is met, as barely as it can be
            assert entropy(w) >= mix.entropy_share * math.log(len(p)) - 1e-6
            assert x == 1.0 or entropy(weights(p, min(1.0, x + 1e-4))) < mix.entropy_share * math.log(len(p)) + 1e-6


def check(docs, mix):
    """docs: rows of (doc_id, text, source). Ids by source, by the library itself, one more for each end."""
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path(mix.tokenizer))
    tokens = Counter()
    for _, t, s in docs:
        tokens[s or ""] += len(library.encode(t or "", add_special_tokens=False).ids) + 1
    return tokens


def test_budgets_are_spent(spark, make_docs):
    rows = [(i, " ".join(["unwordly"] * (i % 37)), f"s{0 if i % 3 else i % 5}") for i in range(900)]
    mix = Mix(block_tokens=200)
    got = mixing.schedule(make_docs(rows, extra=True), mix).collect()
    tokens = check(rows, mix)
    total = sum(tokens.values())
    p = {s: n / total for s, n in tokens.items()}
    x = mixing.find_exponent(spark.createDataFrame([(v,) for v in p.values()], "p double"), mix)
    z = sum(v**x for v in p.values())
    used, times = Counter(), Counter()
    for r in got:
        used[r.source] += r.tokens
        times[r.doc_id] += 1
    for s in tokens:
        budget = p[s] ** x / z * total
        assert budget - 160 <= used[s] <= budget + 1  # less than one document is left over
    by = {}
    for i, _, s in rows:
        by.setdefault(s, set()).add(times[i])
    for s, seen in by.items():
        assert max(seen) - min(seen) <= 1 and max(seen) <= math.ceil(mix.max_repeats)  # whole passes, then a part of one
    copies = Counter((r.doc_id, r.epoch) for r in got)
    assert set(copies.values()) == {1} and all(0 <= r.position <= 1 for r in got)
    again = mixing.schedule(make_docs(rows), mix).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_mixed_documents(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    a, b = Counter(r.doc_id for r in out.collect()), Counter(r.doc_id for r in mixing.schedule(docs).collect())
    assert a == b


def test_odd_documents(spark, make_docs, odd_texts):
    rows = [(i, t, None if i % 2 else "s") for i, t in enumerate(odd_texts)] + [(None, "x y", "s"), (3, "twice", "s"), (3, "twice", "s")]
    got = mixing.schedule(make_docs(rows, extra=True)).collect()
    assert {r.source for r in got} == {"", "s"} and sum(r.tokens for r in got) > 0
    assert mixing.schedule(make_docs([])).count() == 0 == mixing.mixed(make_docs([])).count()
    one = mixing.schedule(make_docs(["a b c", "d"])).collect()
    assert sorted(r.doc_id for r in one) == [0, 1]


def test_columns_of_any_name_stay_and_positions_ascend(spark, make_docs):
    from pyspark.sql import functions as F

    rows = [(i, "some words " * (i % 7 + 1), "a" if i % 4 else "b") for i in range(400)]
    docs = make_docs(rows, extra=True)
    for c in ("_src", "_key", "_blocks", "src", "blocks", "use", "at", "cut", "salt_"):
        docs = docs.withColumn(c, F.lit("y"))
    mix = Mix(block_tokens=50)
    out = mixing.mixed(docs, mix)
    assert out.columns == docs.columns
    assert {(r._src, r._key, r._blocks, r.use, r.salt_) for r in out.collect()} == {("y",) * 5}
    starts = {}
    for r in mixing.schedule(docs, mix).collect():
        starts.setdefault(r.source, set()).add((r.position, r.epoch, r.block))
    for x in starts.values():  # no two blocks start at one place, and epochs follow each other
        assert len({p for p, _, _ in x}) == len(x) and [e for _, e, _ in sorted(x)] == sorted(e for _, e, _ in x)


def test_tables_too_large_to_broadcast_are_salted(make_docs, monkeypatch):
    docs = make_docs([(i, "some words " * (i % 7 + 1), f"s{i % 5}") for i in range(200)])
    want = sorted(map(tuple, mixing.schedule(docs, Mix(block_tokens=60)).collect()))
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, mixing.schedule(docs, Mix(block_tokens=60)).collect())) == want
