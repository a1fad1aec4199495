import functools
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rowceil.llm import common, packing, sstable, tokens


@functools.cache
def _library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def library():
    return _library()


def ids_of(library, text):
    return np.array(library.encode(text or "", add_special_tokens=False).ids + [0], dtype="<u4")


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("abzé ßÀ×÷09.,'!%$\n\t  漢ſ-"), max_size=40))
def test_parts_give_the_librarys_ids(text):
    enc = tokens.encoder("byte_bpe_50k.json")
    want = _library().encode(text, add_special_tokens=False).ids
    assert np.frombuffer(next(enc.encode([text])), dtype="<u4").tolist() == want


def test_encoder_on_real_and_odd_texts(spark, sf_dir, library, odd_texts):
    texts = [r.text for r in common.table(spark, sf_dir, "documents").select("text").collect()] + odd_texts
    for text, got in zip(texts, tokens.encoder("byte_bpe_50k.json").encode(texts), strict=True):
        assert np.frombuffer(got, dtype="<u4").tolist() == ids_of(library, text)[:-1].tolist()


def test_shards_round_trip(spark, make_docs, library, odd_texts):
    rows = [(i * 7 - 20, t, "s") for i, t in enumerate(odd_texts)] + [(None, "no id", "s"), (1, "twice", "s"), (1, "twice", "s"), (-(2**63), "least", "s"), (2**63 - 1, "most", "s")]
    docs = make_docs(rows, extra=True)
    got = sstable.tokens_on_disk(docs).collect()
    want = sorted(((i, ids_of(library, t)) for i, t, _ in rows), key=lambda x: (x[0] is not None, x[0] or 0))
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got) == sorted((i is not None, i or 0, len(x), zlib.crc32(x.tobytes())) for i, x in want)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == [i for i, _ in want]


def test_shard_lookup_and_blocks(tmp_path):
    rng = random.Random(1)
    held = {i * 3 - 5000: np.array([rng.randrange(50000) for _ in range(rng.randrange(60))] + [0], dtype="<u4") for i in range(4000)}
    with open(tmp_path / "x.sst", "wb") as f:
        w = sstable.Writer(f, 2)
        for k in sorted(held):
            w.add(sstable.key_of(k), held[k])
        w.close()
    with open(tmp_path / "x.sst", "rb") as f:
        r = sstable.Reader(f)
        assert len(r.index) > 3 and r.n_keys == 4000
        for k in [*held][::37]:
            (ids,) = r.get(k)
            assert ids.tolist() == held[k].tolist()
        assert all(r.get(k + 1) == [] for k in [*held][::41])
        assert sum(r.may_hold(sstable.key_of(k + 1)) for k in held) < 200  # false positives near one in a hundred
        assert [sstable.id_of(k) for k, _, _ in r] == sorted(held)


def test_damaged_block_is_noticed(tmp_path):
    p = tmp_path / "x.sst"
    with p.open("wb") as f:
        w = sstable.Writer(f, 4)
        w.add(sstable.key_of(1), np.arange(10, dtype="<u4"))
        w.close()
    b = bytearray(p.read_bytes())
    b[20] ^= 1
    p.write_bytes(b)
    with p.open("rb") as f, pytest.raises(ValueError):
        sstable.Reader(f).get(1)


def test_no_documents(spark, make_docs):
    assert sstable.tokens_on_disk(make_docs([])).count() == 0
    assert packing.pack(make_docs([])).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(0, 500), max_size=64))
def test_histogram_packing_places_every_piece_once(counts):
    patterns = packing.pack_histogram(counts, 64)
    placed: dict[int, int] = {}
    for p, n in patterns:
        assert n > 0 and sum(p) <= 64 and list(p) == sorted(p, reverse=True)
        for x in p:
            placed[x] = placed.get(x, 0) + n
    assert placed == {k: n for k, n in counts.items() if n}
    places = packing.Places(patterns, 64)
    seen = set()
    for length, n in placed.items():
        seq, off = places.find(np.full(n, length), np.arange(n))
        for s, o in zip(seq.tolist(), off.tolist(), strict=True):
            for i in range(o, o + length):
                assert (s, i) not in seen
                seen.add((s, i))
    fill: dict[int, int] = {}
    for s, i in seen:
        fill[s] = max(fill.get(s, 0), i + 1)
    assert len(seen) == sum(fill.values())  # gapless from 0
    assert sorted(fill) == list(range(len(fill)))


def check_packing(rows, texts, library, room=1024):
    docs = {}
    for r in rows:
        docs.setdefault(r.doc_id, []).append(r)
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for off, n in sorted(s):
            assert off == at
            at += n
        assert at <= room
    for doc_id, text in texts.items():
        ids = ids_of(library, text)
        at = 0
        for r in sorted(docs[doc_id], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    return len(seqs)


def test_packing_whole_table(spark, sf_dir, library):
    docs = common.table(spark, sf_dir, "documents")
    rows = packing.pack(docs).collect()
    n = check_packing(rows, {r.doc_id: r.text for r in docs.collect()}, library)
    total = sum(r.length for r in rows)
    assert n <= 1.03 * -(-total // 1024) + 1  # little padding


def test_packing_odd_texts(spark, make_docs, library, odd_texts):
    rows = packing.pack(make_docs(odd_texts, extra=True)).collect()
    check_packing(rows, dict(enumerate(odd_texts)), library)
    doubled = packing.pack(make_docs([(1, "a b", "s"), (1, "a b", "s"), (None, "c", "s")])).collect()
    assert len({(r.sequence_id, r.offset) for r in doubled}) == 3


def test_ranks_in_parts_and_long_documents(make_docs, library, monkeypatch):
    monkeypatch.setattr(packing, "RANKED", 7)
    texts = {i: "word " * n for i, n in enumerate([5] * 60 + [1500, 2047, 2048, 4000] * 5)}
    rows = packing.pack(make_docs(list(texts.values())), room=64).collect()
    check_packing(rows, texts, library, 64)
    ids = {r.sequence_id for r in rows}
    assert ids == set(range(len(ids)))


def test_shards_end_by_size_and_ids_must_fit(spark, make_docs, monkeypatch, tmp_path):
    docs = make_docs([(i, f"text number {i} " * 40, "s") for i in range(300)])
    want = sorted(map(tuple, sstable.tokens_on_disk(docs).drop("shard").collect()))
    monkeypatch.setattr(sstable, "BLOCK_BYTES", 512)
    real = sstable.write_shards
    shards = real(docs.coalesce(1), str(tmp_path / "a"))
    assert want == sorted(map(tuple, sstable.read_shards(spark, shards).drop("shard").collect()))
    w = sstable.Writer(open(tmp_path / "x", "wb"), 2)  # noqa: SIM115
    with pytest.raises(ValueError):
        w.add(sstable.key_of(1), np.array([70_000], dtype="<u4"))
    with pytest.raises(Exception, match="does not fit"):
        real(docs, str(tmp_path / "b"), width=1)


def test_sweep_leaves_what_is_named(tmp_path):
    for x in ("a.sst", "b.sst", "c.sst"):
        (tmp_path / x).write_bytes(b"x")
    sstable.sweep(str(tmp_path), {"b.sst"})
    assert [p.name for p in tmp_path.iterdir()] == ["b.sst"]
    sstable.sweep(str(tmp_path / "none"), set())


def test_shards_are_written_without_a_copy_of_the_ids(spark, tmp_path):
    from rowceil.llm import common, sstable

    docs = spark.createDataFrame([(k % 40 - 5, f"text {k}") for k in range(60)] + [(None, None)], "doc_id long, text string")
    before = list(common.made_paths(spark))
    shards = sstable.write_shards(docs, str(tmp_path / "shards"))
    assert list(common.made_paths(spark)) == before
    got = sstable.read_shards(spark, shards).orderBy("start").collect()
    assert len(got) == 61 and got[0].doc_id is None and [r.doc_id for r in got[1:]] == sorted(r.doc_id for r in got[1:])
