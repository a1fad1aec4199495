import zlib

import numpy as np
import pytest

from rowceil.llm import common, toxicity


@pytest.fixture(scope="module")
def costs(spark):
    return toxicity.trigram_costs(toxicity.trigram_counts(common.table(spark, "/root/testdata/sf0.01", "documents")))


def test_counts_cover_every_text(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    n = sum(len(r.text.encode()) for r in docs.collect() if r.text)
    got = toxicity.trigram_counts(docs).sum()
    assert 0 <= got - n <= docs.count() + 200  # a boundary between texts and batches


@pytest.mark.parametrize("token, word", [("5tup1d", "stupid"), ("l0s3r", "loser"), ("m0r0n", "moron"), ("tr@sh", "trash"), ("idiooooot", "idiot"), ("i.d.i.o.t", "idiot"), ("hello", "hello"), ("3.14", "3.14"), ("word,", "word"), ("(loser!!", "loser"), ("", ""), ("%%%", "")])
def test_words_are_restored(costs, token, word):
    assert toxicity.Restorer(costs).word(token) == word


def test_spaced_words_are_restored(costs):
    assert "stupid" in toxicity.Restorer(costs).spaced("you are s t u p i d ok".split())
    assert toxicity.Restorer(costs).spaced("a b".split()) == []


@pytest.mark.parametrize("token, word", [("stuupid", "stupid"), ("iddiioott", "idiot"), ("1d!07", "idiot"), ("!d!07", "idiot")])
def test_doubled_letters_and_mere_signs_are_restored(costs, token, word):
    assert toxicity.Restorer(costs).word(token) == word


@pytest.mark.parametrize("token", ["committee", "bookkeeper", "$100", "hello", "1000", "word"])
def test_plain_readings_stay(costs, token):
    assert token in toxicity.Restorer(costs).readings(token).split()


def test_long_tokens_are_restored(costs):
    restorer = toxicity.Restorer(costs)
    assert restorer.word("idi" + "o" * 5000 + "t") == "idiot"
    spelled = [*("stupididiotloser" * 6)]
    assert len(spelled) > 64 and set(restorer.spaced(spelled)) >= {"stupid", "idiot", "loser"}
    whole = restorer.decode("".join(spelled) * 200, True)
    assert whole.replace(" ", "") == "".join(spelled) * 200 and whole.split().count("idiot") > 1000


def test_viterbi_is_the_cheapest_path(costs):
    import itertools

    lattice = toxicity.lattice_of("5t0p")
    table = costs.tolist()

    def cost(path):
        a = b = 0
        total = 0.0
        for c, price in path:
            total += price
            if c and not (b == 0 and toxicity._symbol(c) == 0):  # signs beside a boundary cost the model nothing
                s = toxicity._symbol(c)
                total += table[a][b][s]
                a, b = b, s
        return total + (table[a][b][0] if b else 0.0)

    best = min(itertools.product(*lattice), key=cost)
    assert toxicity.viterbi(lattice, table) == "".join(c for c, _ in best)
    assert ("5", toxicity.STAYS) in lattice[0] and ("0", toxicity.STAYS) in lattice[2]


def test_toxicity_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = common.table(spark, folder, "documents"), common.table(spark, folder, "labels")
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, labels).collect()}
    held = [(got[r.doc_id], r.toxic) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert held and all(r.held_out for r, _ in held) and len(got) == docs.count()
    hit = sum(r.predicted and y for r, y in held)
    assert hit / sum(y for _, y in held) > 0.85 and hit / max(1, sum(r.predicted for r, _ in held)) > 0.85


def test_disguised_words_count_like_plain_ones(spark, make_docs):
    clean, rude = "the of and words here are plain and quiet today {}", "the of and you stupid moron here today {}"
    rows = [(i, (rude if i % 2 else clean).format(f"x{i}"), "s") for i in range(400)]
    rows += [(1000, "the of and you 5tup1d m0r0n here today", "s"), (1001, "the of s t u p i d and m o r o n here", "s"), (1002, None, "s"), (1003, "", "s"), (None, "quiet words", "s"), (1003, "", "s")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(make_docs(rows, extra=True), labels).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[1000].predicted == by[1001].predicted == 1 and by[1002].predicted == by[1003].predicted == 0
    assert np.isfinite([r.score for r in got]).all()
    none = toxicity.score_toxicity(make_docs(["a"]), labels.where("doc_id < 0")).collect()
    assert none[0].score == 0.5 and toxicity.score_toxicity(make_docs([]), labels).count() == 0


@pytest.mark.parametrize("token", ["mp3", "cafe80", "v2", "1234", "covid19"])
def test_numbers_in_words_stay(costs, token):
    assert token in toxicity.Restorer(costs).readings(token).split()


@pytest.mark.parametrize("token", ["id-iot", "stu.pid", "mo_ron", "st-up1d"])
def test_marks_within_words(costs, token):
    word = {"id-iot": "idiot", "stu.pid": "stupid", "mo_ron": "moron", "st-up1d": "stupid"}[token]
    table = costs.copy()
    for a, b, c in zip("  " + word, " " + word, word, strict=False):  # a model that knows the word
        table[toxicity._symbol(a), toxicity._symbol(b), toxicity._symbol(c)] = 0.01
    assert word in toxicity.Restorer(table).readings(token).split()


def test_spelled_texts_of_any_length(costs):
    restorer = toxicity.Restorer(costs)
    for n in (72, 500, 20_000):
        letters = [*("stupididiotloser" * (n // 16 + 1))][:n]
        found = restorer.spaced(letters)
        assert "stupid" in found and "".join(found) == "".join(letters)


def plain_features(model, text):
    """The features of a text, from its tokens one by one and without anything remembered."""
    restorer = toxicity.Restorer(model.costs)

    def weigh(words):
        best = 0.0
        for w in words:
            best = max(best, model.odds[w] if w in model.odds else 0.8 * max(model.odds.get("5:" + w[:5], 0.0), model.odds.get("4:" + w[:4], 0.0)))
        return best

    tokens = (text or "").lower().split()
    found = [weigh(restorer.readings(t).split()) for t in sorted(set(tokens))]
    pairs = {(x, y) for x, y in zip(tokens, tokens[1:], strict=False) if x + y in model.odds}
    found += [model.odds[x + y] for x, y in pairs if restorer.joined(x, y)]
    if sum(len(t) == 1 for t in tokens) >= 3:
        found += [weigh([w]) for w in restorer.spaced(tokens)]
    found = sorted((x for x in found if x), reverse=True)
    top = (found + [0.0] * 3)[:3]
    return [*top, np.log(1 + len(found)), len(found) / (20 + len(set(tokens)))]


def test_scores_against_a_plain_version(spark, sf_dir):
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, "/root/testdata/sf0.01", "labels")
    model = toxicity.fit_toxicity(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, labels).collect()}
    for r in docs.collect():
        z = float(np.dot(plain_features(model, r.text), model.weights[1:]) + model.weights[0])
        assert abs(got[r.doc_id] - 1 / (1 + np.exp(-z))) < 1e-9
    few = toxicity.fit_toxicity(docs, labels, weights=3)
    assert len(few.odds) <= 3 and len(toxicity.fit_toxicity(docs, labels, weights=None).odds) >= len(model.odds)


def test_a_blank_within_a_word(spark, make_docs):
    clean, rude = "the of and words here are plain and quiet today {}", "the of and you stupid moron here today {}"
    rows = [(i, (rude if i % 2 else clean).format(f"x{i}"), "s") for i in range(400)] + [(1000, "the of and you stu pid here today", "s"), (1001, "the of and words here are plain to day", "s")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, toxic int")
    by = {r.doc_id: r for r in toxicity.score_toxicity(make_docs(rows), labels).collect()}
    assert by[1000].predicted == 1 and by[1001].predicted == 0
