import re
import zlib

import numpy as np

from rowceil.llm import common, linefreq, rulefit

BLANK = "[ \t-\r]+"


def plain_judge(rows, lim=linefreq.Limits()):  # noqa: B008
    """rows: (doc_id, text, source). Verdicts in the rows' order."""
    norm = lambda x: re.sub("[ \t\x0b-\r]+", " ", x).strip(" ")
    hosts, lines = {}, {}
    for i, t, s in rows:
        one = t or "" if lim.by_text else (i, t or "")
        hosts.setdefault(s or "", set()).add(one)
        for x in {norm(x) for x in (t or "").lower().split("\n")} - {""}:
            lines.setdefault((s or "", x), set()).add(one)
    often = {k for k, v in lines.items() if len(v) >= lim.min_docs and 100 * len(v) > lim.max_share * len(hosts[k[0]])}
    out = []
    for i, t, s in rows:
        t = t or ""
        w = [x for x in re.split(BLANK, t) if x]
        real = [x for x in t.split("\n") if re.search("[^ \t-\r]", x)]
        wins = {}
        for k in range(len(w) - 2):
            wins.setdefault(tuple(w[k : k + 3]), []).append(k)
        rep = len({k + o for ks in wins.values() if len(ks) > 1 for k in ks for o in range(3)})
        failed = len(w) < lim.least_words or 100 * rep > lim.max_repeat_share * len(w)
        gone = sum(len(x.split(" ")) for x in map(norm, t.lower().split("\n")) if (s or "", x) in often)
        kept = not failed and 100 * (len(w) - gone) >= lim.least_left * len(w)
        out.append((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(real) - len(set(real)), rep, failed, gone, kept))
    return out


def as_rows(df):
    return sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.words_removed, r.kept) for r in df.collect()), key=repr)


def test_verdicts_on_whole_table(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    assert as_rows(linefreq.judge(docs)) == sorted(plain_judge(rows), key=repr)


def test_verdicts_on_odd_texts_and_boilerplate(spark, make_docs, odd_texts):
    body = " ".join(f"w{i}" for i in range(60))
    rows = [(i, t, "s") for i, t in enumerate(odd_texts)]
    rows += [(100 + i, f"Shared  LINE here\n{body} {i}\nshared line here ", "h") for i in range(30)]
    rows += [(200 + i, "copied line of many copies\n" + body, "h") for i in range(40)]
    rows += [(250 + i, f"{body} {i} of a kind " + "own " * 30, "h") for i in range(900)]
    rows += [(2000 + i, ("boiler plate number one " * 9 + "\n") * 1 + f"own words {i}", "h") for i in range(20)]
    rows += [(None, body, None), (None, body, None), (7, "dup", "s"), (7, "dup", "s")]
    from pyspark.sql import functions as F

    docs = make_docs(rows, extra=True)
    for c in ("_d", "_h", "_t", "_places", "_kept", "places", "key_id", "host", "text_hash"):
        docs = docs.withColumn(c, F.lit("z"))
    want = plain_judge(rows)
    assert as_rows(linefreq.judge(docs)) == sorted(want, key=repr)
    texts = linefreq.Limits(by_text=True)
    assert as_rows(linefreq.judge(docs, texts)) == sorted(plain_judge(rows, texts), key=repr) != sorted(want, key=repr)
    assert any(x[7] and x[8] for x in want)  # a line went, the document stayed
    kept = linefreq.clean(docs)
    assert kept.columns == docs.columns
    got = kept.collect()
    assert sorted((repr(r.doc_id) for r in got)) == sorted(repr(x[0]) for x in want if x[8])
    assert all("hared" not in r.text for r in got if r.source == "h") and sum(r.doc_id is None for r in got) == 2
    assert linefreq.judge(make_docs([])).count() == 0 == linefreq.clean(make_docs([])).count()


def test_quality_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = common.table(spark, folder, "documents"), common.table(spark, folder, "labels")
    got = {r.doc_id: r for r in rulefit.score_quality(docs, labels).collect()}
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [(got[i], y) for i, y in truth.items() if zlib.crc32(str(i).encode()) % 5 == 0]
    assert held and all(r.held_out for r, _ in held)
    assert np.mean([r.predicted == y for r, y in held]) >= 0.95 and all(0 <= r.score <= 1 for r in got.values())
    assert len(got) == docs.count() and sum(r.held_out for r in got.values()) == sum(zlib.crc32(str(i).encode()) % 5 == 0 for i in got)


def test_column_scores_as_the_model_does(spark, make_docs, odd_texts):
    rng = np.random.default_rng(2)
    x = rng.random((600, len(rulefit.STATS)))
    y = ((x[:, 2] > 0.5) | (x[:, 6] < 0.2)).astype(float)
    model = rulefit.fit_rules(x, y)
    assert np.mean((model.score(x) > 0.5) == y) > 0.97 and 0 < len(model.rules) < 150
    df = spark.createDataFrame([tuple(map(float, r)) for r in x[:50]], ", ".join(f"{c} double" for c in rulefit.STATS)).select(model.column().alias("s"))
    assert np.allclose([r.s for r in df.collect()], model.score(x[:50]))
    stats = rulefit.stats(make_docs(odd_texts, extra=True)).toPandas()
    assert len(stats) == len(odd_texts) and np.isfinite(stats[list(rulefit.STATS)].to_numpy(dtype=float)).all()


def test_quality_without_labels(spark, make_docs):
    labels = spark.createDataFrame([(None, 1), (5, None)], "doc_id long, quality int")
    got = rulefit.score_quality(make_docs([(1, "a", "s"), (None, None, "s"), (1, "a", "s")], extra=True), labels).collect()
    assert len(got) == 3 and {r.score for r in got} == {0.5}
    assert rulefit.score_quality(make_docs([]), labels).count() == 0


def test_trees_cut_where_the_gain_is_greatest():
    """Each cut of a tree is the best of all that its node could make, by trying them all."""
    rng = np.random.default_rng(3)
    x = rng.random((200, 3))
    y = (x[:, 1] > 0.6).astype(float) * 0.9 + 0.05 * (x[:, 0] > 0.5) - 0.5
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, rulefit.BINS + 1)[1:-1], method="lower")) for j in range(3)]
    bins = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    hess = np.full(200, 0.25)
    rules, out = rulefit._grow(bins, cuts, y, hess, np.random.default_rng(0))

    def gain(at, j, t):
        low = at & (x[:, j] <= t)
        high = at & ~low
        if low.sum() < rulefit.LEAST_LEAF or high.sum() < rulefit.LEAST_LEAF:
            return -1.0
        return sum(y[m].sum() ** 2 / (hess[m].sum() + 1) for m in (low, high)) - y[at].sum() ** 2 / (hess[at].sum() + 1)

    tried = {j for r in rules for j, _, _ in r}
    for rule in rules:
        at = rulefit._holds(rule[:-1], x) if len(rule) > 1 else np.ones(200, dtype=bool)
        j, _, t = rule[-1]
        best = max(gain(at, k, c) for k in range(3) for c in cuts[k])
        assert abs(gain(at, j, t) - best) < 1e-9
    assert tried and np.isfinite(out).all()


def test_lasso_weights_are_optimal():
    """At the weights found no rule's gradient exceeds the penalty, and for those in use it equals it (standardised rules)."""
    rng = np.random.default_rng(5)
    x = rng.random((800, len(rulefit.STATS)))
    y = ((x[:, 2] > 0.5) ^ (rng.random(800) < 0.1)).astype(float)
    model = rulefit.fit_rules(x, y)
    p = model.score(x)
    assert abs((y - p).mean()) < 5e-3
    for rule, w in zip(model.rules, model.weights, strict=True):
        held = rulefit._holds(rule, x).astype(float)
        scale = max(held.std(), 0.05)
        slope = ((held - held.mean()) / scale) @ (y - p) / len(y)
        assert abs(slope - np.sign(w) * rulefit.PENALTY) < 1e-3
