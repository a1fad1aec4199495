"""Toxicity through a noisy channel: disguised words are decoded under a character model before they are scored.

A token that looks disguised (digits or signs for letters, letters repeated, letters spaced or marked apart) is a
lattice: at each place the character itself, the letters it may stand for, or nothing where it repeats; a mark within a
word, or a blank between two, may be a blank or nothing. Viterbi finds the cheapest path under a trigram model of
characters, whose counts come from every text of the corpus. Words of the restored text are then weighed by log-odds
learnt from labelled documents, and a logistic model over the heaviest words of a document gives its score. A token
stands for its cheapest reading, for the cheapest in letters alone, and for itself.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .rulefit import in_fold, label_sample

#: The most labelled documents that a fit takes (those of least hash).
SAMPLE = 40_000
#: The most word and prefix weights kept unless a fit is told otherwise, those seen most in toxic documents.
WEIGHTS = 50_000
LEAST_SEEN, LEAST_ODDS = 3, 1.5
#: Words remembered by each worker; when full it starts anew.
KEPT_WORDS = 500_000

#: What signs and digits may stand for.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t"}

SYMBOLS = 28  # 0 a boundary, 1 to 26 letters, 27 another letter


def _classes() -> bytes:
    out = bytearray(256)
    for c in range(26):
        out[ord("a") + c] = out[ord("A") + c] = c + 1
    for c in range(128, 256):
        out[c] = 27
    return bytes(out)


_CLASSES = _classes()


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """Counts of character trigrams over all whole texts, SYMBOLS x SYMBOLS x SYMBOLS; null texts count nothing.

    A task sends one row for each trigram it has met, at most SYMBOLS ** 3, summed before and after the shuffle.
    """

    def count(batches):
        total = np.zeros(SYMBOLS**3, dtype=np.int64)
        for b in batches:
            texts = [x for x in b.column("text").to_pylist() if x]
            for i in range(0, len(texts), 200):
                c = np.frombuffer(("\n" + "\n".join(texts[i : i + 200]) + "\n").encode().translate(_CLASSES), dtype=np.uint8).astype(np.int32)
                total += np.bincount(c[:-2] * SYMBOLS**2 + c[1:-1] * SYMBOLS + c[2:], minlength=SYMBOLS**3)
        (at,) = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(total[at])], ["gram", "n"])

    out = np.zeros(SYMBOLS**3)
    for gram, n in docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n")).collect():
        out[gram] = n
    return out.reshape(SYMBOLS, SYMBOLS, SYMBOLS)


def trigram_costs(counts: np.ndarray) -> np.ndarray:
    """Minus log of the chance of a symbol after two others, smoothed by the chance after one and by its own."""
    one = counts.sum((0, 1)) + 1
    one = one / one.sum()
    two = counts.sum(0) + 20 * one[None, :]
    two = two / two.sum(1, keepdims=True)
    three = counts + 20 * two[None, :, :]
    return -np.log(three / three.sum(2, keepdims=True))


_ENDS = ".,;:?\"'()[]{}#%&*-_<>=~^/\\`«»“”…"
_WITHIN = re.compile(r"(?=.{3})[a-z0134578@$!|+]+(?:[.\-_*'~]+[a-z0134578@$!|+]+)*")
_RUN = re.compile(r"([a-z])\1")
_APART = re.compile(r"(?:[a-z0134578@$!|+][.\-_*]){2,}[a-z0134578@$!|+]")
_SIGNS = re.compile(r"[@$!|+]")
_NUMBER = re.compile(r"[\d.\-_*'~+]+")


def _symbol(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else 0 if ord(c) < 128 else 27


def viterbi(lattice: list[list[tuple[str, float]]], costs) -> str:
    """lattice: for each place the choices (what it emits, at most one character; what that costs in the channel).

    Digits and signs bound words, as in the counts; behind a boundary they cost the model nothing more, and blanks are
    not emitted there. One pass in time linear in the places: a state points back to the one it came from, and text is
    made at the end.
    """
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for choices in lattice:
        after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (cost, said) in states.items():
            for c, price in choices:
                if c:
                    s = _symbol(c)
                    if s == 0 and b == 0:
                        if c == " ":
                            continue
                        key, now, out = (a, b), cost + price, (said, c)
                    else:
                        key, now, out = (b, s), cost + price + costs[a][b][s], (said, c)
                else:
                    key, now, out = (a, b), cost + price, said
                if key not in after or now < after[key][0]:
                    after[key] = (now, out)
        states = after
    last = min(((cost + (costs[a][b][0] if b else 0.0), said) for (a, b), (cost, said) in states.items()), key=lambda x: x[0])[1]
    text = []
    while last is not None:
        last, c = last
        text.append(c)
    return "".join(reversed(text))


#: Prices: a sign for a letter, a sign for itself, a blank or mark left out, a blank put between single characters.
STANDS, STAYS, JOINED, PARTED = 1.0, 4.0, 2.0, 2.0
_MARKS = ".-_*'~"


def lattice_of(token: str, spaced: bool = False, plain: bool = True) -> list[list[tuple[str, float]]]:
    """The choices for each character of a lower-case token, blanks and marks within it included; with `spaced`, a word
    may end between any two; without `plain`, signs don't stand for themselves."""
    out: list[list[tuple[str, float]]] = []
    for i, c in enumerate(token):
        run = i and token[i - 1] == c
        long = run and (token[max(0, i - 2) : i] == c * 2 or token[i : i + 2] == c * 2)
        if c in LEET:
            choices = [(x, STANDS) for x in LEET[c]] + ([(c, STAYS)] if plain else []) + [("", 0.5 if long else 9.0)]
        elif c == " " or c in _MARKS:
            choices = [(" ", 0.0), ("", 0.0 if run else JOINED)]
        else:
            choices = [(c, 0.0 if not long else 1.0)] + ([("", 0.0 if long else 6.0)] if run else [])
        if spaced and i:
            out.append([("", 0.0), (" ", PARTED)])
        out.append(choices)
    return out


class Restorer:
    """costs: of trigram_costs. Word by word; what isn't disguised stays as it is, in lower case, without marks at its ends."""

    def __init__(self, costs: np.ndarray) -> None:
        self.costs = costs.tolist()

    def word(self, token: str, plain: bool = True) -> str:
        bare = token.strip(_ENDS).rstrip("!|")
        if bare.isalpha():
            return self.decode(bare) if _RUN.search(bare) else bare
        if _APART.fullmatch(bare):
            return self.decode(re.sub(r"[.\-_*]", "", bare), True, False)
        if _WITHIN.fullmatch(bare) and not _NUMBER.fullmatch(bare):
            return self.decode(bare, False, plain and not _SIGNS.search(bare))  # who writes ! for i writes 0 for o
        return bare

    def readings(self, token: str) -> str:
        """The words that a token may stand for: those restored, with signs and in letters alone, and it as it is, so that 'committee' or '$100' stays a word."""
        bare = token.strip(_ENDS).rstrip("!|")
        return " ".join(dict.fromkeys((self.word(token), self.word(token, False), bare)))

    def joined(self, *parts: str) -> bool:
        """Whether parts of a text, with blanks between them, are one word by the model."""
        return " " not in self.decode(" ".join(parts))

    def decode(self, token: str, spaced: bool = False, plain: bool = True) -> str:
        return viterbi(lattice_of(token, spaced, plain), self.costs)

    def spaced(self, tokens: list[str]) -> list[str]:
        """The words that runs of three or more single characters stand for."""
        found, run = [], []
        for x in [*tokens, "  "]:
            if len(x) == 1 and (x.isalpha() or x in LEET) and x != "|":
                run.append(x)
            else:
                if len(run) >= 3:
                    found += self.decode("".join(run), True, False).split()
                    if len(run) > 3 and run[0] in "ai":  # or a word of one letter before them
                        found += self.decode("".join(run[1:]), True, False).split()
                run = []
        return found


def words(text: str | None) -> tuple[set[str], list[str], list[str]]:
    """The distinct tokens of a text in lower case, all in order, and again if three or more are single characters."""
    tokens = (text or "").lower().split()
    return set(tokens), tokens, tokens if sum(len(x) == 1 for x in tokens) >= 3 else []


class _Kept(dict):
    def __init__(self, make) -> None:
        super().__init__()
        self.make = make

    def __missing__(self, key):
        if len(self) >= KEPT_WORDS:
            self.clear()
        self[key] = out = self.make(key)
        return out


FEATURES = 5


@dataclass
class ToxicModel:
    costs: np.ndarray
    odds: dict[str, float] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES + 1))

    def weigher(self):
        """A function from a text to its features; it remembers words."""
        restorer, odds = Restorer(self.costs), self.odds

        def weigh(restored: str) -> float:
            return max((odds.get(w) or 0.8 * max(odds.get("5:" + w[:5], 0.0), odds.get("4:" + w[:4], 0.0)) for w in restored.split()), default=0.0)

        kept = _Kept(lambda token: weigh(restorer.readings(token)))
        whole = {w for w in odds if ":" not in w}
        parted = _Kept(lambda pair: restorer.joined(*pair))

        def features(text: str | None) -> list[float]:
            distinct, tokens, ordered = words(text)
            found = [x for x in map(kept.__getitem__, distinct) if x]
            if not whole.isdisjoint(map(add, tokens, tokens[1:])):  # two tokens that may be one word, parted by a blank
                found += [odds[x + y] for x, y in set(zip(tokens, tokens[1:], strict=False)) if x + y in whole and parted[x, y]]
            if ordered:
                found += [x for x in map(weigh, restorer.spaced(ordered)) if x]
            found.sort(reverse=True)
            top = [*found[:3], 0.0, 0.0, 0.0]
            return [top[0], top[1], top[2], np.log1p(len(found)), len(found) / (20 + len(distinct))]

        return features

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x.reshape(-1, FEATURES) @ self.weights[1:] + self.weights[0], -30, 30)))


def _fit_logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Newton steps with a small ridge; without rows, or with one label, the smoothed base rate alone."""
    rate = (y.sum() + 0.5) / (len(y) + 1)
    w = np.zeros(x.shape[1] + 1)
    w[0] = np.log(rate / (1 - rate))
    if len(y) < 20 or y.min() == y.max():
        return w
    m = np.hstack([np.ones((len(x), 1)), x])
    ridge = np.diag([1e-6, *[0.05] * x.shape[1]]) * 10
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(m @ w, -30, 30)))
        step = np.linalg.solve((m * (p * (1 - p))[:, None]).T @ m + ridge, m.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 4, fold: int = 2, rows: int = SAMPLE, weights: int | None = WEIGHTS) -> ToxicModel:
    """rows: the most labelled documents taken; weights: the most words and prefixes that get a weight, None for all of theirs."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = ToxicModel(trigram_costs(trigram_counts(docs)))
    sample = label_sample(labels, "toxic", in_fold(F.col("doc_id"), folds, fold), rows)
    chosen = stored(docs.join(F.broadcast(sample.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(4)))), "doc_id"), "labelled")
    costs = model.costs

    def seen(batches):
        restorer = Restorer(costs)
        kept = _Kept(restorer.readings)
        for b in batches:
            names, labels = [], []
            for text, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist(), strict=True):
                distinct, _, ordered = words(text)
                own = {w for x in distinct for w in kept[x].split()}.union(restorer.spaced(ordered) if ordered else ())
                own = own | {"5:" + w[:5] for w in own if len(w) > 5} | {"4:" + w[:4] for w in own if len(w) > 4}
                names += own
                labels += [y] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(labels, pa.int64())], ["name", "y"])

    made = chosen.where("part < 3").select("text", F.col("y").cast("long").alias("y")).mapInArrow(seen, "name string, y long")
    sizes = {r["y"]: r["count"] for r in chosen.where("part < 3").groupBy("y").count().collect()}
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    odds = F.log((F.col("t") + 0.5) / (bad + 1)) - F.log((F.col("n") + 0.5) / (good + 1))
    table = made.groupBy("name").agg(F.sum("y").alias("t"), F.sum(1 - F.col("y")).alias("n")).where(F.col("t") >= LEAST_SEEN).withColumn("odds", odds)
    table = table.where(F.col("odds") >= LEAST_ODDS)
    if weights is not None:
        table = table.orderBy(F.desc("t"), "name").limit(weights)
    model.odds = {r["name"]: float(r["odds"]) for r in table.collect()}
    half = model

    def weigh(batches):
        features = half.weigher()
        for b in batches:
            x = np.array([features(t) for t in b.column("text").to_pylist()], dtype=np.float64).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([*(pa.array(x[:, j]) for j in range(FEATURES)), b.column("y"), b.column("doc_id")], [*(f"x{j}" for j in range(FEATURES)), "y", "doc_id"])

    schema = ", ".join(f"x{j} double" for j in range(FEATURES)) + ", y long, doc_id long"
    got = chosen.where("part = 3").select("text", F.col("y").cast("long").alias("y"), "doc_id").mapInArrow(weigh, schema).toPandas().sort_values(["doc_id", *(f"x{j}" for j in range(FEATURES))])
    model.weights = _fit_logistic(got[[f"x{j}" for j in range(FEATURES)]].to_numpy(np.float64), got["y"].to_numpy(np.float64))
    return model


def score_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 4, fold: int = 2, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of docs (doc_id, text), learnt from labels (doc_id, toxic).

    Labels of the held-out fold are not read. Null text is empty: no word weighs anything, and the score is low.
    Null doc_ids are scored and count as not held out; repeated rows are scored each; other columns are ignored.
    With no usable labels every score is 0.5.
    """
    model = fit_toxicity(docs, labels, folds, fold)

    def run(batches):
        features = model.weigher()
        for b in batches:
            x = np.array([features(t) for t in b.column("text").to_pylist()], dtype=np.float64).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.score(x))], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", in_fold(F.col("doc_id"), folds, fold).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
