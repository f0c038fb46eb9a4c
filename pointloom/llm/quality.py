"""Text quality by a generalised additive model with pairwise interactions.

Each feature of a text is binned; the model is an intercept, a lookup table for every feature and one for each
chosen pair of features. The tables are learned by cyclic boosting: features take turns, and a shallow tree over
one feature's bins (or over the bins of a pair) adds a small correction to its table. A score is a sum of table
entries at a text's bins, added up for a batch of texts at once, under a logistic link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import held_out, labelled_sample, whole

#: Learning rows taken of either label at most.
PER_CLASS = 10_000
BINS = 32
#: Bins of a feature inside a pair's table.
PAIR_BINS = 8
PAIRS = 6
ROUNDS, PAIR_ROUNDS, RATE = 120, 60, 0.15
#: Cuts of a tree over one feature.
CUTS = 3

FEATURES = ("bytes", "upper", "digit", "mark", "symbol", "bar", "stop", "space", "newline", "high", "word_length", "distinct", "bigrams", "same_lines", "alpha_words", "ends")


def features(text: str) -> list[float]:
    """The features of a whole text, in the order of FEATURES."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n = len(raw)
    h = np.bincount(raw, minlength=256)
    at = lambda chars: float(h[list(chars.encode())].sum())
    upper, lower = float(h[65:91].sum()), float(h[97:123].sum())
    size = max(n, 1)
    ws = text.split()
    k = max(len(ws), 1)
    lines = text.split("\n")
    ends = sum(line.rstrip()[-1:] in (".", "!", "?", '"', ")") for line in lines) / len(lines)
    return [
        float(np.log1p(n)),
        upper / max(upper + lower, 1.0),
        float(h[48:58].sum()) / size,
        at("!?") / size,
        at("#$%&*+=<>@^_~\\/{}[]") / size,
        at("|") / size,
        at(".,;:") / size,
        at(" \t") / size,
        float(h[10]) / size,
        float(h[128:].sum()) / size,
        n / k,
        len(set(ws)) / k**0.9,
        len(set(zip(ws, ws[1:], strict=False))) / max(k - 1, 1),
        len(set(lines)) / len(lines),
        sum(w[:-1].isalpha() or w.isalpha() for w in ws) / k,
        ends,
    ]


class Tables:
    """The learned model: edges of the bins, a table for each feature, and tables of pairs."""

    def __init__(self, edges: list[np.ndarray], coarse: list[np.ndarray]):
        self.edges, self.coarse = edges, coarse
        self.offset = 0.0
        self.single = [np.zeros(len(e) + 1) for e in edges]
        self.pairs: list[tuple[int, int, np.ndarray]] = []

    def bins(self, x: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        fine = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)]
        return fine, [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.coarse)]

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Sums of table entries: one vectorised look-up and addition for each table."""
        fine, coarse = self.bins(x)
        z = np.full(len(x), self.offset)
        for t, b in zip(self.single, fine, strict=True):
            z += t[b]
        for i, j, t in self.pairs:
            z += t[coarse[i], coarse[j]]
        return z

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def _leaf(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return np.clip(-g / (h + 1.0), -2.0, 2.0)


def _tree(g: np.ndarray, h: np.ndarray, cuts: int = CUTS) -> np.ndarray:
    """A shallow tree over ordered bins: the best cut, then the best cut of what it leaves; a value for each bin."""
    parts = [(0, len(g))]
    for _ in range(cuts):
        best = None
        for a, b in parts:
            if b - a < 2:
                continue
            cg, ch = np.cumsum(g[a:b]), np.cumsum(h[a:b])
            left = cg[:-1] ** 2 / (ch[:-1] + 1.0) + (cg[-1] - cg[:-1]) ** 2 / (ch[-1] - ch[:-1] + 1.0) - cg[-1] ** 2 / (ch[-1] + 1.0)
            k = int(np.argmax(left))
            if left[k] > 1e-9 and (best is None or left[k] > best[0]):
                best = (left[k], a, b, a + k + 1)
        if best is None:
            break
        _, a, b, c = best
        parts.remove((a, b))
        parts += [(a, c), (c, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = _leaf(g[a:b].sum(), h[a:b].sum())
    return out


def _grid(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """A tree of one cut on either axis: its gain, and a value for each cell."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    best, where = 0.0, None
    for a in range(g.shape[0] - 1):
        for b in range(g.shape[1] - 1):
            q = [(cg[a, b], ch[a, b]), (cg[a, -1] - cg[a, b], ch[a, -1] - ch[a, b]), (cg[-1, b] - cg[a, b], ch[-1, b] - ch[a, b])]
            q.append((cg[-1, -1] - sum(x for x, _ in q), ch[-1, -1] - sum(x for _, x in q)))
            gain = sum(x * x / (y + 1.0) for x, y in q) - cg[-1, -1] ** 2 / (ch[-1, -1] + 1.0)
            if gain > best:
                best, where = gain, (a + 1, b + 1)
    out = np.zeros_like(g)
    if where:
        for rows in (slice(0, where[0]), slice(where[0], None)):
            for cols in (slice(0, where[1]), slice(where[1], None)):
                out[rows, cols] = _leaf(g[rows, cols].sum(), h[rows, cols].sum())
    return best, out


def learn(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> Tables:
    """Cyclic boosting of the tables on rows x with labels y (0 or 1) and weights w."""
    m = Tables([_edges(x[:, j], BINS) for j in range(x.shape[1])], [_edges(x[:, j], PAIR_BINS) for j in range(x.shape[1])])
    fine, coarse = m.bins(x)
    rate = float(np.clip((w * y).sum() / w.sum(), 1e-4, 1 - 1e-4))
    m.offset = float(np.log(rate / (1 - rate)))
    z = np.full(len(y), m.offset)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return w * (p - y), w * np.maximum(p * (1 - p), 1e-6)

    for _ in range(ROUNDS):
        for j, b in enumerate(fine):
            g, h = slopes()
            k = len(m.single[j])
            step = RATE * _tree(np.bincount(b, g, k), np.bincount(b, h, k))
            m.single[j] += step
            z += step[b]
    shape = lambda i, j: (len(m.coarse[i]) + 1, len(m.coarse[j]) + 1)

    def sums(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        g, h = slopes()
        cell, s = coarse[i] * shape(i, j)[1] + coarse[j], shape(i, j)
        return np.bincount(cell, g, s[0] * s[1]).reshape(s), np.bincount(cell, h, s[0] * s[1]).reshape(s)

    gains = sorted(((_grid(*sums(i, j))[0], i, j) for i in range(x.shape[1]) for j in range(i)), reverse=True)
    m.pairs = [(i, j, np.zeros(shape(i, j))) for gain, i, j in gains[:PAIRS] if gain > 1e-6]
    for _ in range(PAIR_ROUNDS):
        for i, j, table in m.pairs:
            step = RATE * _grid(*sums(i, j))[1]
            table += step
            z += step[coarse[i], coarse[j]]
    return m


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS) -> Tables | float:
    """The model, or the share of 1 among the learning labels if only one label occurs."""
    ship(docs.sparkSession)
    learn_labels = labels.where(F.col(label).isin(0, 1) & ~held_out("doc_id"))
    totals = {int(r["y"]): r["n"] for r in learn_labels.groupBy(F.col(label).alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()}
    sample = labelled_sample(docs, labels, label, per_class)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = [features(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(f, pa.list_(pa.float64()))], ["doc_id", "y", "f"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = sample.mapInArrow(measure, f"doc_id {kind}, y int, f array<double>").collect()  # 2 * per_class rows of numbers at most
    sizes = [sum(r["y"] == y for r in rows) for y in (0, 1)]
    if not all(sizes):
        return totals.get(1, 0) / max(sum(totals.values()), 1)
    rows.sort(key=lambda r: (r["doc_id"], r["f"]))
    y = np.array([r["y"] for r in rows], dtype=float)
    w = np.array([totals[r["y"]] / sizes[r["y"]] for r in rows])
    return learn(np.array([r["f"] for r in rows]), y, w / w.mean())


def score_documents(docs: DataFrame, labels: DataFrame, *, label: str = "quality", per_class: int = PER_CLASS, threshold: float = 0.3) -> DataFrame:
    """One row for each document: doc_id, held_out, score (0 to 1, higher: better), predicted.

    The model learns from labelled rows that are not held out, at most per_class of either label, weighted back
    to the labels' shares. Null and empty texts are scored by the features of an empty text. If the learning
    rows lack a label, every score is the share of 1 among them (0 without any). Repeated rows give repeated
    rows; an id labelled twice with different labels is not learned from. Other columns are ignored.
    """
    model = fit(docs, labels, label, per_class)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", whole("text").alias("_text"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if isinstance(model, float) or not len(b):
                s = np.full(len(b), model if isinstance(model, float) else 0.0)
            else:
                s = model.score(np.array([features(t.as_py()) for t in b.column(1)]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], ["doc_id", "score"])

    scored = rows.mapInArrow(score, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, *, label: str = "quality", per_class: int = PER_CLASS, threshold: float = 0.3) -> DataFrame:
    """The rows of docs whose text scores at least the threshold, with all their columns, in one pass over them."""
    model = fit(docs, labels, label, per_class)
    names = docs.columns
    at = names.index("text")

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if isinstance(model, float) or not len(b):
                good = np.full(len(b), isinstance(model, float) and model >= threshold)
            else:
                good = model.score(np.array([features(t.as_py() or "") for t in b.column(at)])) >= threshold
            yield b.filter(pa.array(good))

    return docs.mapInArrow(choose, docs.schema)
