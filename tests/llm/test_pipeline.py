import pytest

pipeline = pytest.importorskip("corpus_pipeline")

from rowceil.llm import common, linefreq, packing  # noqa: E402

from .test_linededup import plain_removed  # noqa: E402
from .test_quality import plain_judge  # noqa: E402
from .test_simhash import plain_groups, plain_print  # noqa: E402


def test_stages_against_plain_versions(spark, sf_dir, tmp_path):
    docs = common.table(spark, sf_dir, "documents")
    made = {}
    current = docs
    for name, stage in pipeline.STAGES:
        stage(spark, current, sf_dir).write.parquet(str(tmp_path / name.replace(" ", "-")))
        made[name] = spark.read.parquet(str(tmp_path / name.replace(" ", "-")))
        if name != pipeline.STAGES[-1][0]:
            assert made[name].columns == docs.columns
            current = made[name]
    assert [n for n, _ in pipeline.STAGES] == ["quality rules", "line dedup", "simhash near-dedup", "mixing", "packing"]
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    kept = {r.doc_id: r.text for r in made["quality rules"].collect()}
    assert sorted(kept) == sorted(x[0] for x in plain_judge(rows) if x[8])
    lines = {r.doc_id: r.text for r in made["line dedup"].collect()}
    assert sorted(lines) == sorted(kept)
    gone = plain_removed(list(kept.items()))
    want = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in kept.items()}
    assert sum(want[i] != lines[i] for i in want) <= 2
    prints = [(i, plain_print(t)) for i, t in sorted(lines.items())]
    single = {r.doc_id for r in made["simhash near-dedup"].collect()}
    assert single == {i for (i, _), g in zip(prints, plain_groups(prints), strict=True) if i == g}
    mixed = [r.doc_id for r in made["mixing"].collect()]
    assert set(mixed) <= single and mixed
    packed = made["packing"].collect()
    assert sum(r.start == 0 for r in packed) == len(mixed)
    assert pipeline.run(spark, sf_dir).count() == len(packed)


def test_no_documents_and_odd_ones(spark, make_docs, odd_texts):
    for docs in (make_docs([]), make_docs(odd_texts, extra=True)):
        for name, stage in pipeline.STAGES[:-1]:
            out = stage(spark, docs, "")
            assert out.columns == docs.columns, name
            out.count()
        assert packing.pack(docs).count() >= docs.count() - 1
    assert linefreq.clean(make_docs(["word " * 3])).count() == 0
