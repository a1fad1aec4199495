import numpy as np
import pytest

from rowceil.llm import hnsw


def plain(rows, least=0.9):
    """rows: (vec_id, embedding). n_links and component by comparing all pairs."""
    n = len(rows)
    ok = [i is not None and v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for i, v in rows]
    link = np.zeros((n, n), dtype=bool)
    for a in range(n):
        for b in range(a):
            if ok[a] and ok[b] and len(rows[a][1]) == len(rows[b][1]):
                x, y = (np.array(rows[k][1], dtype=float) for k in (a, b))
                x, y = x / np.abs(x).max(), y / np.abs(y).max()
                link[a, b] = link[b, a] = x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= least
    label = [i for i, _ in rows]
    while True:
        new = [min([label[a], *(label[b] for b in np.flatnonzero(link[a]))]) if ok[a] else label[a] for a in range(n)]
        if new == label:
            return [(i, int(link[k].sum()) if i is not None else 0, label[k]) for k, (i, _) in enumerate(rows)]
        label = new


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(4)
    out = []
    for c in range(12):  # groups of several widths, some chained
        centre = rng.normal(size=16)
        out += [centre + rng.normal(size=16) * 0.15 * (1 + c % 3) for _ in range(3 + 5 * c)]
    out += list(rng.normal(size=(300, 16)))
    out += [out[0]] * 5 + [2.5 * out[1]]
    return [(int(i), [float(x) for x in np.float32(v)]) for i, v in zip(rng.permutation(len(out)), out, strict=True)]


@pytest.mark.parametrize("shard", [65_536, 90])
def test_against_brute_force(spark, vectors, monkeypatch, shard):
    monkeypatch.setattr(hnsw, "SHARD", shard)
    odd = [(10_001, None), (10_002, [0.0] * 16), (10_003, [float("nan")] + [1.0] * 15), (10_004, [float("inf")] + [1.0] * 15), (10_005, [None] + [1.0] * 15), (10_006, []), (10_007, [1.0, 2.0]), (10_008, [2.0, 4.0]), (10_009, [1e30] * 16), (10_010, [1e-30] * 16), (None, [1.0] * 16), (10_011, [1.0, 2.0]), (10_011, [1.0, 2.0])]
    rows = vectors + odd
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, node string, n int")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in hnsw.near_duplicates(df).collect()), key=repr)
    as32 = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert got == sorted(((i, n, g, i is not None and i == g) for i, n, g in plain(as32)), key=repr)


def test_recall_of_one_graph():
    rng = np.random.default_rng(9)
    base = rng.normal(size=(400, 32))
    v = hnsw.unit(np.concatenate([base + 0.2 * rng.normal(size=base.shape) for _ in range(8)]))
    g = hnsw.Graph.build(v)
    beam, recall, links = g.audit(0.9)
    assert recall >= 0.99 and links >= hnsw.AUDITED
    a, b, full = g.within(v, 0.9, beam)
    assert not len(full)
    found = set(zip(a.tolist(), b.tolist(), strict=True))
    true = set(map(tuple, np.argwhere(v @ v.T >= 0.9).tolist()))
    assert len(found & true) >= 0.99 * len(true) and found <= true | {(i, i) for i in range(len(v))}


def test_audit_measures_rare_links():
    rng = np.random.default_rng(5)
    base = rng.normal(size=(3000, 32))
    v = hnsw.unit(np.concatenate([base, base[:4] + 0.05 * rng.normal(size=(4, 32))]))
    g = hnsw.Graph.build(v)
    assert g.audit(0.9)[1:] == (1.0, 8)
    for x in g.levels:  # no way leads anywhere: all links are lost, whatever the beam
        x[:] = -1
    assert g.audit(0.9) == (0, 0.0, 8)
    assert hnsw.Graph.build(hnsw.unit(base)).audit(0.9) == (hnsw.FIRST_BEAM, 1.0, 0)


def test_audit_asks_for_vectors_of_other_shards():
    rng = np.random.default_rng(6)
    base = rng.normal(size=(2000, 32))
    g = hnsw.Graph.build(hnsw.unit(base))
    foreign = hnsw.unit(base[:40] + 0.05 * rng.normal(size=(40, 32)))
    assert g.audit(0.9)[2] == 0
    beam, recall, links = g.audit(0.9, foreign)
    assert links >= 40 and recall >= hnsw.RECALL and beam
    for x in g.levels:
        x[:] = -1
    assert g.audit(0.9, foreign)[0] == 0


def test_audits_are_told_and_whole_shards_compared(spark, vectors, monkeypatch):
    monkeypatch.setattr(hnsw, "SHARD", 90)
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    audits = []
    rows = sorted(map(tuple, hnsw.near_duplicates(df, audits=audits).collect()))
    assert len(audits) >= 4 and all(a["recall"] >= hnsw.RECALL and a["beam"] for a in audits) and any(a["links"] for a in audits)

    v = np.array([x for _, x in vectors])
    node = np.array([i for i, _ in vectors])
    counts, edges = hnsw.dense_links(v, np.arange(len(v)), node, v, node, np.ones(len(v), np.int64), 0.9)
    assert counts.tolist() == [n for _, n, _ in plain(vectors)]
    label = {i: i for i in node.tolist()}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for row, p in edges:
        a, b = sorted((root(int(node[row])), root(int(node[p]))))
        label[b] = a
    assert [root(i) for i in node.tolist()] == [g for _, _, g in plain(vectors)]
    assert len(edges) <= 2 * len(v)
    assert rows == sorted((i, n, g, i == g) for i, n, g in plain(vectors))


def test_a_dense_group_is_told_apart():
    rng = np.random.default_rng(2)
    v = hnsw.unit(np.concatenate([np.ones((900, 8)) + 0.02 * rng.normal(size=(900, 8)), rng.normal(size=(500, 8))]))
    a, _, full = hnsw.Graph.build(v).within(v[:20], 0.99, 32)
    assert full.tolist() == list(range(20)) and not len(a)


def test_no_vectors(spark):
    assert hnsw.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    one = hnsw.near_duplicates(spark.createDataFrame([(3, [1.0])], "vec_id long, embedding array<float>")).first()
    assert (one.vec_id, one.n_links, one.component_id, one.kept) == (3, 0, 3, True)
