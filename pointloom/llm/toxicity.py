"""Toxicity by class-conditional Kneser-Ney models over the letters of words.

Two letter n-gram models, of toxic and of ordinary documents, share all their lower orders: only the longest
contexts are counted by class, and what they have not seen is taken from continuation counts over all documents
(interpolated Kneser-Ney). A rare expression therefore gets the same probability from either model unless
its class has evidence of its own, and new forms of a known stem inherit the stem's. The lowest order is the
frequency of letters in the whole corpus.

A toxic document is not toxic throughout: its words come from the ordinary model but for a small share, which comes from
the toxic one. A document's log-likelihoods under this and under the ordinary model, both normalised by its length, are
compared in two forms: with every word's likelihood mixed of the two models, and with every word given by the likelier
of them (the toxic one at a price). A logistic curve fitted on out-of-fold differences turns them into a probability.
"""

from __future__ import annotations

import math
import operator
import re
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import Stage, held_out, labelled_sample, whole

#: Learning rows taken of either class at most (the bound of what the model is fitted on).
PER_CLASS = 8000
#: Letters of the longest n-gram, of which the last is predicted.
ORDER = 5
#: Parts of the learning rows; each is scored by a model of the others, and the curve is fitted on these scores.
FOLDS = 4
#: Discounts of the class counts and of the pooled continuation counts.
CLASS_DISCOUNT, POOLED_DISCOUNT = 2.0, 0.75
#: Share of a toxic document's words that the toxic model gives.
SHARE = 0.01
#: What a word costs (in nats) if it is given by the toxic model rather than by the ordinary one.
PRICE = 1.0
#: Words of which a worker remembers the likelihoods, in either half of its memory.
CACHE_WORDS = 300_000
#: Letters that count as one word where a run of letters is longer (scripts without spaces); its n-grams are all kept.
WORD_LETTERS = 64

_WORD = re.compile(r"[^\W\d_]+")
_START, _END = "\x02", "\x03"


def words(text: str) -> list[str]:
    """Runs of letters, lower-cased."""
    return _WORD.findall(text.lower())


def ngrams(word: str, order: int = ORDER) -> list[str]:
    s = _START * (order - 1) + word + _END
    return [s[i : i + order] for i in range(len(word) + 1)]


class KneserNey:
    """Ratios of a pair of class models. counts: n-gram -> (ordinary, toxic); letters: corpus frequencies.

    shared: by length, the continuation counts of the shorter n-grams; without it, those of counts.
    """

    def __init__(self, counts: dict[str, tuple[float, float]], letters: dict[str, float], order: int = ORDER, class_discount: float = CLASS_DISCOUNT, pooled_discount: float = POOLED_DISCOUNT, shared: list[dict[str, int]] | None = None):
        self.counts, self.order, self.class_discount, self.pooled_discount = counts, order, class_discount, pooled_discount
        self.total = [Counter(), Counter()]  # by context: count, and mass that the discount takes
        self.freed = [Counter(), Counter()]
        for g, pair in counts.items():
            for y in (0, 1):
                if pair[y]:
                    self.total[y][g[:-1]] += pair[y]
                    self.freed[y][g[:-1]] += min(pair[y], class_discount)
        # continuation counts, pooled: in how many longer n-grams each shorter one ends
        if shared is None:
            shared = [{} for _ in range(order)]
            longer: Iterable[str] = counts
            for n in range(order - 1, 0, -1):
                shared[n] = Counter(g[1:] for g in longer)
                longer = shared[n]
        self.shared = shared
        self.shared_total = [Counter() for _ in range(order)]
        self.shared_kinds = [Counter() for _ in range(order)]
        for n in range(1, order):
            for g, k in self.shared[n].items():
                self.shared_total[n][g[:-1]] += k
                self.shared_kinds[n][g[:-1]] += 1
        size = sum(letters.values())
        self.base = {c: (k + 1) / (size + len(letters) + 1) for c, k in letters.items()}
        self.unseen = 1 / (size + len(letters) + 1)
        self._ratio: dict[str, float] = {}
        self._words: dict[str, float] = {}
        self._older: dict[str, float] = {}

    def _pooled(self, gram: str) -> float:
        p, d = self.base.get(gram[-1], self.unseen), self.pooled_discount
        for n in range(1, self.order):
            g = gram[-n:]
            if total := self.shared_total[n].get(g[:-1]):
                p = (max(self.shared[n].get(g, 0) - d, 0) + d * self.shared_kinds[n][g[:-1]] * p) / total
        return p

    def ratio(self, gram: str) -> float:
        """ln P_toxic - ln P_ordinary of the n-gram's last letter after the others."""
        if gram in self._ratio:
            return self._ratio[gram]
        context = gram[:-1]
        if context not in self.total[0] and context not in self.total[1]:
            return 0.0
        pooled, pair, logs = self._pooled(gram), self.counts.get(gram, (0, 0)), []
        for y in (0, 1):
            total = self.total[y].get(context)
            p = (max(pair[y] - self.class_discount, 0) + self.freed[y][context] * pooled) / total if total else pooled
            logs.append(math.log(max(p, 1e-300)))
        if len(self._ratio) > 4 * CACHE_WORDS:
            self._ratio.clear()
        self._ratio[gram] = logs[1] - logs[0]
        return self._ratio[gram]

    def gain(self, word: str) -> tuple[float, float, int]:
        """ln likelihood as part of a toxic document less that as part of an ordinary one (mixed; by the likelier model),
        and how many words it counts as."""
        got = self._words.get(word)
        if got is None:
            got = self._older.get(word)
            if got is None:
                ratios = list(map(self.ratio, ngrams(word, self.order)))
                parts = [math.fsum(ratios[i : i + WORD_LETTERS]) for i in range(0, len(ratios), WORD_LETTERS)]
                got = math.fsum(map(_mixed, parts)), math.fsum(max(r - PRICE, 0.0) for r in parts), len(parts)
            if len(self._words) >= CACHE_WORDS:
                self._older, self._words = self._words, {}
            self._words[word] = got
        return got

    def differences(self, text: str) -> tuple[float, float]:
        """The log-likelihood as a toxic document less that as an ordinary one: mixed, over the number of words; by the
        likelier model, over its root. 0 without words."""
        gains = [self.gain(w) for w in words(text)]
        n = sum(g[2] for g in gains)
        return (math.fsum(g[0] for g in gains) / n, math.fsum(g[1] for g in gains) / math.sqrt(n)) if n else (0.0, 0.0)

    def features(self, text: str) -> tuple[float, float]:
        """The differences on logarithmic scales, the mixed one in hundredths of nats and to both sides."""
        mixed, likelier = self.differences(text)
        return math.copysign(math.log1p(100 * abs(mixed)), mixed), math.log1p(likelier)


def _mixed(ratio: float) -> float:
    """ln((1 - SHARE) + SHARE * e^ratio)."""
    high = math.log(SHARE) + ratio
    low = math.log1p(-SHARE)
    return max(high, low) + math.log1p(math.exp(-abs(high - low)))


def count_ngrams(sample: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, y, fold, n): in how many of a fold's learning documents an n-gram occurs. A text counts once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            keys = list(seen)
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys], pa.int32()), pa.array([seen[k] for k in keys], pa.int64())], ["gram", "y", "fold", "n"])

        for b in batches:
            for text, y, fold in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                seen.update((g, y, fold) for g in {g for w in set(words(text)) for g in ngrams(w, order)})
                if len(seen) > 500_000:
                    yield out()
                    seen.clear()
        yield out()

    once = sample.groupBy("text").agg(F.min("y").alias("y"), F.min("fold").alias("fold"))
    return once.mapInArrow(count, "gram string, y int, fold int, n bigint").groupBy("gram", "y", "fold").agg(F.sum("n").alias("n"))


def corpus_counts(docs: DataFrame, stage: Stage, order: int = ORDER) -> DataFrame:
    """(g, n), staged: all documents' different n-grams of the longest order (n = 0), and letters with their frequencies.

    One pass over the texts. A worker looks at a word once in a while and sends on each n-gram of it once; shuffles make
    them distinct.
    """

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[str] = set()
        grams: set[str] = set()
        letters: Counter = Counter()

        def out() -> pa.RecordBatch:
            rows = [(g, 0) for g in grams]
            grams.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], ["g", "n"])

        for b in batches:
            for t in b.column(0):
                text = t.as_py().lower()
                letters.update(text)
                for w in set(_WORD.findall(text)) - known:
                    grams.update(ngrams(w, order))
                    known.add(w)
                if len(known) > CACHE_WORDS:
                    known.clear()
                if len(grams) > CACHE_WORDS:
                    yield out()
        yield out()
        some = [(c, n) for c, n in letters.items() if c.isalpha()]
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in some], pa.string()), pa.array([n for _, n in some], pa.int64())], ["g", "n"])

    found = docs.select(whole("text").alias("t")).mapInArrow(gather, "g string, n bigint")
    return stage.table(found.groupBy("g").agg(F.sum("n").alias("n")), "corpus")


def shared_counts(corpus: DataFrame, counted: DataFrame, stage: Stage, order: int = ORDER) -> list[dict[str, int]]:
    """By length, in how many longer n-grams of all documents each shorter one ends.

    Only the n-grams whose context ends one of ``counted`` (column gram) come back, as no other is asked for: at most
    the learning rows' contexts times the letters.
    """
    longer = corpus.where(F.length("g") == order)
    shared: list[dict[str, int]] = [{} for _ in range(order)]
    for n in range(order - 1, 0, -1):
        level = stage.table(longer.groupBy(F.substring("g", 2, n).alias("g")).agg(F.count(F.lit(1)).alias("k")), f"shared{n}")
        asked = counted.select(F.substring("gram", order - n + 1, n - 1).alias("c")).distinct()
        rows = level.withColumn("c", F.substring("g", 1, n - 1)).join(asked, "c", "left_semi").select("g", "k").collect()
        shared[n] = {r["g"]: r["k"] for r in rows}
        longer = level
    return shared


def letter_counts(corpus: DataFrame) -> dict[str, int]:
    """How often each letter occurs in all texts, lower-cased (one row for each different letter)."""
    return {r["g"]: r["n"] for r in corpus.where(F.length("g") == 1).collect()}


def fit_logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, steps: int = 60, hold: float = 1e-3) -> list[float]:
    """Slopes and, last, the offset of a weighted logistic curve by damped Newton steps; ``hold`` pulls slopes to 0."""
    a = np.c_[x, np.ones(len(x))]
    pull = np.append(np.full(x.shape[1], hold), 1e-9)
    at = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ at, -40, 40)))
        slope = a.T @ (w * (p - y)) + pull * at
        bend = (a * (w * p * (1 - p))[:, None]).T @ a + np.diag(pull + 1e-6)
        step = np.linalg.solve(bend, slope)
        at -= step * min(1.0, 4.0 / (np.abs(step).sum() + 1e-12))
        if np.abs(step).sum() < 1e-8:
            break
    return at.tolist()


def sigmoid(z: float) -> float:
    return 1 / (1 + math.exp(-z)) if z >= 0 else math.exp(z) / (1 + math.exp(z))


def fit(docs: DataFrame, labels: DataFrame, label: str, stage: Stage, per_class: int = PER_CLASS) -> tuple[dict, list, dict, list[float]] | None:
    """(n-gram counts, shared continuation counts, letter counts, the curve), or None if there are no rows to learn from."""
    sample = labelled_sample(docs, labels, label, per_class)
    sample = stage.table(sample.select("text", "y", F.pmod(F.xxhash64(F.lit(3), "text"), F.lit(FOLDS)).cast("int").alias("fold")), "sample")
    sizes = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if set(sizes) != {0, 1}:
        return None
    # weights undo the sample's balance, so that scores are probabilities in the labelled population
    learn = labels.where(F.col(label).isin(0, 1) & ~held_out("doc_id")).groupBy(F.col(label).alias("y")).count().collect()
    weight = {int(r["y"]): r["count"] / sizes[int(r["y"])] for r in learn}
    by = lambda y, f: F.sum(F.when((F.col("y") == y) & (F.col("fold") == f), F.col("n")).otherwise(0))
    table = count_ngrams(sample).groupBy("gram").agg(F.array(*(by(y, f) for y in (0, 1) for f in range(FOLDS))).alias("c"))
    table = stage.table(table, "counts")
    top = {r["gram"]: r["c"] for r in table.collect()}  # the n-grams of 2 * PER_CLASS rows at most
    corpus = corpus_counts(docs, stage)
    shared, letters = shared_counts(corpus, table, stage), letter_counts(corpus)
    sent = docs.sparkSession.sparkContext.broadcast((top, shared, letters))  # the n-grams of 2 * PER_CLASS rows at most

    def out_of_fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, model, at = sent.value[0], None, None
        for b in batches:
            rows = list(zip(*(b.column(i).to_pylist() for i in range(3)), strict=True))
            x = []
            for text, _, fold in rows:  # sorted by fold, so a task builds a model seldom and holds one
                if fold != at:
                    model, at = KneserNey(_without(counts, fold), sent.value[2], shared=sent.value[1]), fold
                x.append(model.features(text))
            yield pa.RecordBatch.from_arrays([pa.array([v[0] for v in x], pa.float64()), pa.array([v[1] for v in x], pa.float64()), pa.array([r[1] for r in rows], pa.int32())], ["x1", "x2", "y"])

    # 2 * PER_CLASS rows at most; in one order, so that the fit is the same on every run
    by_fold = sample.select("text", "y", "fold").repartitionByRange(FOLDS, "fold").sortWithinPartitions("fold")
    seen = np.array(sorted(tuple(r) for r in by_fold.mapInArrow(out_of_fold, "x1 double, x2 double, y int").collect()))
    curve = fit_logistic(seen[:, :2], seen[:, 2], np.array([weight[int(y)] for y in seen[:, 2]]))
    sent.destroy()
    return _without(top, None), shared, letters, curve


def _without(counts: dict[str, list[int]], fold: int | None) -> dict[str, tuple[int, int]]:
    """(ordinary, toxic) counts of the folds but one."""
    out = {}
    for g, c in counts.items():
        pair = tuple(sum(k for f, k in enumerate(c[y * FOLDS : (y + 1) * FOLDS]) if f != fold) for y in (0, 1))
        if any(pair):
            out[g] = pair
    return out


def score_documents(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", per_class: int = PER_CLASS, threshold: float = 0.5) -> DataFrame:
    """One row for each document: doc_id, held_out, score (0 to 1, higher: more likely toxic), predicted.

    The model learns from labelled rows that are not held out, at most per_class of either label; the letters'
    frequencies and the continuation counts of shorter n-grams come from all documents. Null and empty texts, and texts
    without letters, get the score of a document to which both models give the same likelihood. Without learning rows of both labels every score is 0.5
    times the share of the label found (0 without labels). Repeated rows give repeated rows; an id labelled
    twice with different labels is not learned from. Other columns are ignored.
    """
    ship(docs.sparkSession)
    stage = Stage(docs.sparkSession, "toxicity")
    kind = docs.schema["doc_id"].dataType.simpleString()
    model = fit(docs, labels, label, stage, per_class)
    rows = docs.select("doc_id", whole("text").alias("_text"))
    if model is None:
        share = labels.where(~held_out("doc_id")).agg(F.avg(F.col(label).cast("double"))).first()[0] or 0.0
        scored = rows.select("doc_id", F.lit(0.5 * share).alias("score"))
    else:
        sent, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex  # bounded by per_class

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts, shared, letters, curve = sent.value
            m = _model(key, counts, shared, letters)
            for b in batches:
                x = [sigmoid(sum(map(operator.mul, curve, (*m.features(t.as_py()), 1.0)))) for t in b.column(1)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.float64())], ["doc_id", "score"])

        scored = rows.mapInArrow(score, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


_MODELS: dict[str, KneserNey] = {}


def _model(key: str, counts: dict, shared: list, letters: dict) -> KneserNey:
    """A worker builds a model once and keeps one."""
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = KneserNey(counts, letters, shared=shared)
    return _MODELS[key]
