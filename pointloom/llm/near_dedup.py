"""Near-duplicate classes by Order MinHash, verified by banded alignment.

A text is its sequence of words; its k-mers are the five-word shingles. Order MinHash labels each shingle with its
occurrence number, takes under each of several permutations the few labelled shingles with the least values, and
keeps them in the order in which they stand in the text; two texts agree in such a sketch with a probability that
follows their edit similarity, not just their common content. Texts that agree in a sketch are candidates. They are
compared by an alignment of their words inside a band of diagonals, 1 - distance / longer length, and linked from
0.8 on. Classes are the connected components of the links.

Equal texts are one node from the start, named by a digest, so neither copies nor repeated ids meet in buckets. Within
a bucket every member is first paired with two centres, the least and the greatest digest: the same texts are centres of
most buckets that they are in. Buckets whose members are not in one component after that are finished exactly: they
are cut into blocks of bounded size, and inside each pair of blocks one matrix product gives how many words any two
texts share, which bounds their similarity; what may reach 0.8 and is not in one component yet is aligned. So every
two texts that meet in a bucket are compared or are in one component anyway, while no list of a bucket's pairs is ever
made, and no bucket is gathered in one task.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import Stage, whole

WORDS = 5
SIMILARITY = 0.8
#: Permutations, and labelled shingles kept under each.
SKETCHES, KEPT = 24, 2
#: Words and members that a block of an unfinished bucket holds, about.
BLOCK_WORDS, BLOCK_MEMBERS = 1 << 18, 512
#: Different words whose counts are multiplied at once inside a pair of blocks.
_COLUMNS = 4096
#: Shingles hashed under all permutations at once; longer texts go piece by piece.
_PIECE = 32_768

_U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20_240_607))
_FACTORS = _RNG.integers(0, 2**63, SKETCHES, dtype=np.int64).astype(_U) * _U(2) + _U(1)
_OFFSETS = _RNG.integers(0, 2**63, SKETCHES, dtype=np.int64).astype(_U)
_BASE = _U(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0x7FB5D329728EA185)
    x = (x ^ (x >> _U(27))) * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of a text's words (lower-cased; runs of bytes above the space), all at once.

    A word's hash is the difference of prefix sums of byte * base^position, scaled back by its start.
    """
    raw = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)
    inside = np.concatenate(([False], raw > 32, [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, _U)
    powers, inverse = _powers(len(raw) + 1)
    sums = np.concatenate((np.zeros(1, _U), np.cumsum(_mix(raw.astype(_U) + _U(1)) * powers[:-1], dtype=_U)))
    return _mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(_U))


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64; kept, and grown by doubling."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        back = _U(pow(int(_BASE), -1, 2**64))
        _POWERS[:] = [np.cumprod(np.concatenate((np.ones(1, _U), np.full(size - 1, b, _U))), dtype=_U) for b in (_BASE, back)]
    return _POWERS[0][:n], _POWERS[1][:n]


def shingles(w: np.ndarray, words: int = WORDS) -> np.ndarray:
    """Hashes of the runs of five words; a shorter text is one shingle, a text without words none."""
    if not len(w):
        return w
    k = min(words, len(w))
    out = np.zeros(len(w) - k + 1, _U)
    for i in range(k):
        out = (out ^ w[i : len(w) - k + 1 + i]) * _U(0xD6E8FEB86659FD93)
        out ^= out >> _U(32)
    return _mix(out + _U(k))


def _occurrences(s: np.ndarray) -> np.ndarray:
    """For each shingle, how many equal ones stand before it."""
    order = np.argsort(s, kind="stable")
    r = s[order]
    first = np.concatenate(([True], r[1:] != r[:-1]))
    at = np.arange(len(s))
    out = np.empty(len(s), np.int64)
    out[order] = at - np.maximum.accumulate(np.where(first, at, 0))
    return out


def sketch(s: np.ndarray) -> np.ndarray:
    """The bucket of the text under each permutation."""
    if not len(s):
        return np.arange(1, SKETCHES + 1).astype(_U)
    labelled = s
    if len(np.unique(s)) < len(s):
        n = _occurrences(s).astype(_U)
        labelled = np.where(n > 0, _mix(s + n * _BASE), s)  # first occurrences keep their hash
    rows = np.arange(SKETCHES)
    value = np.full((SKETCHES, KEPT), 2**64 - 1, _U)
    place = np.full((SKETCHES, KEPT), -1, np.int64)
    for a in range(0, len(s), _PIECE):
        v = labelled[None, a : a + _PIECE] * _FACTORS[:, None] + _OFFSETS[:, None]
        for _ in range(min(KEPT, v.shape[1])):
            at = v.argmin(1)
            low = v[rows, at]
            worst = value.argmax(1)
            better = (low < value[rows, worst]) | (place[rows, worst] < 0)
            value[rows[better], worst[better]] = low[better]
            place[rows[better], worst[better]] = at[better] + a
            v[rows, at] = _U(2**64 - 1)
    place.sort(1)  # text order; absent ones (-1) come first
    out = rows.astype(_U) + _U(1)
    for i in range(KEPT):
        part = np.where(place[:, i] >= 0, s[place[:, i]], _U(0))
        out = _mix((out ^ part) * _BASE + _U(i))
    return out


def distance(a: list[int], b: list[int], limit: int) -> int | None:
    """Edit distance of two sequences if it is at most limit, else None; bit-parallel inside a growing band."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > limit:
        return None
    lo = 0
    while lo < len(b) and a[lo] == b[lo]:
        lo += 1
    end_a, end_b = len(a), len(b)
    while end_b > lo and a[end_a - 1] == b[end_b - 1]:
        end_a, end_b = end_a - 1, end_b - 1
    a, b = a[lo:end_a], b[lo:end_b]
    if not b:
        return len(a) if len(a) <= limit else None
    have, want = Counter(a), Counter(b)
    if len(a) - sum((have & want).values()) > limit:  # items of the longer one without a partner
        return None
    rows: dict[int, int] = {}
    for r, x in enumerate(a, 1):
        rows[x] = rows.get(x, 0) | 1 << r
    band = min(limit, len(a) - len(b) + 16)
    while True:
        d = _band(rows, len(a), b, band)
        if d is not None and d <= band:
            return d
        if band >= limit:
            return None
        band = min(limit, 2 * band)


def _band(rows: dict[int, int], n: int, b: list[int], k: int) -> int | None:
    """Distance along diagonals -k..k (an upper bound if it exceeds k). rows: item -> bits of its places in a.

    Bit i of a column j stands for row j - k + i: the window moves down by one row with each column. p and m mark
    steps of +1 and -1 from the row above. Rows up to 0 are all equal to j, which is the first row's rule.
    """
    full = (1 << (2 * k + 1)) - 1
    top = 1 << (2 * k)
    p, m = full ^ ((1 << (k + 1)) - 1), 0
    follow = k + n - len(b)  # the diagonal that ends in the last cell
    d = n - len(b)
    for j, x in enumerate(b, 1):
        p, m = p >> 1 | top, m >> 1
        eq = rows.get(x, 0)
        eq = (eq >> (j - k) if j >= k else eq << (k - j)) & full
        same = ((((eq & p) + p) ^ p) | eq | m) & full
        d += 1 - (same >> follow & 1)
        if d > k:
            return None
        right = m | full ^ (same | p) & full
        left = same & p
        right = (right << 1 | 1) & full
        p = (left << 1 | full ^ (same | right)) & full
        m = same & right
    return d


def most_edits(longer: int, least: float = SIMILARITY) -> int:
    """Edits that leave two sequences similar enough."""
    return int((1 - least) * longer + 1e-9)


def similar(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> bool:
    """Whether 1 - distance / longer length is at least ``least``; two empty sequences are alike."""
    longer = max(len(a), len(b))
    return not longer or distance(a.tolist(), b.tolist(), most_edits(longer, least)) is not None


def _sketched(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, node, size, buckets): node is half of the text's SHA-256, size its words."""
    kind = docs.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, sizes, buckets = [], [], []
            for t in b.column(1):
                text = t.as_py()
                w = word_hashes(text)
                nodes.append(hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()[:16])
                sizes.append(len(w))
                buckets.append(sketch(shingles(w)).astype(np.int64))
            flat = pa.array(np.concatenate(buckets) if buckets else np.zeros(0, np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(buckets) + 1, dtype=np.int32) * SKETCHES), flat)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int32()), lists], ["doc_id", "node", "size", "buckets"])

    rows = docs.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("_text"))
    return rows.mapInArrow(work, f"doc_id {kind}, node binary, size int, buckets array<bigint>")


def node_of(text: Column) -> Column:
    """The name of a text's node."""
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def _within(a: str, b: str, least: float) -> Column:
    """Whether the lengths leave two sequences a chance to be similar (as in ``distance``)."""
    return F.abs(F.col(a) - F.col(b)) <= F.floor(F.lit(1 - least) * F.greatest(a, b) + F.lit(1e-9))


def members(nodes: DataFrame, stage: Stage) -> DataFrame:
    """(h, node, size, n, low, high): nodes in the buckets that hold n > 1, each with the bucket's two centres."""
    member = nodes.select("node", "size", F.explode("buckets").alias("h"))
    me = F.struct("node", "size")
    buckets = member.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min(me).alias("low"), F.max(me).alias("high")).where("n > 1")
    buckets = stage.table(buckets, "buckets")
    return stage.table(member.join(buckets.hint("merge"), "h"), "members")


def candidates(met: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """Pairs (a, b), a < b, of nodes that meet in a bucket: each with the bucket's two centres."""
    pairs = met.select("node", "size", F.explode(F.array("low", "high")).alias("c")).where(F.expr("node <> c.node"))
    pairs = pairs.select("node", "size", F.col("c.node").alias("c"), F.col("c.size").alias("cs")).where(_within("size", "cs", least))
    return pairs.select(F.least("node", "c").alias("a"), F.greatest("node", "c").alias("b")).distinct()


def sequences(docs: DataFrame, nodes: DataFrame, met: DataFrame, *, text_col: str) -> DataFrame:
    """(node, s, buckets): the word hashes of the nodes in ``met``, and the buckets that they are in."""
    needed = met.select("node").distinct().join(nodes.select("node", "buckets"), "node")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = [word_hashes(t.as_py()).tobytes() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.binary()), b.column(2)], ["node", "s", "buckets"])

    texts = docs.select(whole(text_col).alias("_text")).select(node_of(F.col("_text")).alias("node"), "_text")
    # copies go before the shuffle meets them; no text travels that no bucket asks for
    own = texts.join(needed.hint("merge"), "node", "left_semi").groupBy("node").agg(F.first("_text").alias("_text"))
    return own.join(needed.hint("merge"), "node").select("node", "_text", "buckets").mapInArrow(work, "node binary, s binary, buckets array<bigint>")


def verified(pairs: DataFrame, seq: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The pairs whose texts' words are similar enough."""
    side = lambda c: seq.select(F.col("node").alias(c), F.col("s").alias(f"s{c}")).hint("merge")
    both = pairs.join(side("b"), "b").join(side("a"), "a")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = lambda i: (np.frombuffer(x.as_py(), _U) for x in b.column(i))
            good = [similar(x, y, least) for x, y in zip(at(2), at(3), strict=True)]
            yield b.select([0, 1]).filter(pa.array(good, pa.bool_()))

    return both.select("a", "b", "sa", "sb").mapInArrow(align, "a binary, b binary")


def unfinished(met: DataFrame, labels: DataFrame, stage: Stage) -> DataFrame:
    """(h, node, label, part, parts) of the buckets of more than three members that hold several components.

    Up to three members are paired by the two centres alone. parts is how many blocks the bucket is cut into, part
    the member's own.
    """
    label = F.coalesce("label", "node").alias("label")
    m = stage.table(met.where("n > 3").select("h", "node", "size").join(labels.hint("merge"), "node", "left").select("h", "node", "size", label), "labelled")
    kinds = m.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words"), F.min("label").alias("l1"), F.max("label").alias("l2")).where("l1 <> l2")
    parts = F.greatest(F.ceil(F.col("words") / BLOCK_WORDS), F.ceil(F.col("n") / BLOCK_MEMBERS)).cast("int")
    kinds = stage.table(kinds.select("h", parts.alias("parts")), "unfinished")
    left = m.select("h", "node", "label").join(kinds.hint("merge"), "h")
    return left.select("h", "node", "label", F.pmod(F.xxhash64("node"), "parts").cast("int").alias("part"), "parts")


def shared_words(texts: list[np.ndarray]) -> np.ndarray:
    """How many words (with multiplicity) any two texts share: a product of their 0-1 rows of occurrence-labelled words."""
    out = np.zeros((len(texts), len(texts)), np.float32)
    sizes = [len(t) for t in texts]
    if not sum(sizes):
        return out
    labelled = np.concatenate([_mix(t + _occurrences(t).astype(_U) * _BASE) if len(t) else t for t in texts])
    owner = np.repeat(np.arange(len(texts)), sizes)
    _, word, count = np.unique(labelled, return_inverse=True, return_counts=True)
    order = np.flatnonzero(count > 1)  # a word of one text alone is shared by none
    column = np.full(len(count), -1, np.int64)
    column[order] = np.arange(len(order))
    column = column[word]
    by = np.argsort(column, kind="stable")
    by = by[np.searchsorted(column[by], 0) :]
    for a in range(0, len(order), _COLUMNS):
        some = by[np.searchsorted(column[by], a) : np.searchsorted(column[by], a + _COLUMNS)]
        rows = np.zeros((len(texts), min(_COLUMNS, len(order) - a)), np.float32)
        rows[owner[some], column[some] - a] = 1.0
        out += rows @ rows.T
    return out


def block_links(h: int, nodes: list[bytes], labels: list[bytes], part: np.ndarray, buckets: np.ndarray, texts: list[np.ndarray], least: float = SIMILARITY) -> list[tuple[bytes, bytes]]:
    """Pairs of labels to be joined: similar texts of a block, or of two different blocks where there are two.

    A pair is looked at in the first bucket that both texts are in, and only while its labels are not joined.
    """
    sizes = np.array([len(t) for t in texts])
    names = {x: i for i, x in enumerate(dict.fromkeys(labels))}
    own = np.array([names[x] for x in labels])
    if len(names) < 2:
        return []
    shared = shared_words(texts)
    up = list(range(len(names)))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    two, out, labels_of = len(np.unique(part)) > 1, [], list(names)
    for i in range(len(nodes)):
        rest = slice(i + 1, None)
        longer = np.maximum(sizes[rest], sizes[i])
        able = (own[rest] != own[i]) & (shared[i, rest] >= longer - np.floor((1 - least) * longer + 1e-9))
        if two:
            able &= part[rest] != part[i]
        for j in np.flatnonzero(able) + i + 1:
            a, b = root(own[i]), root(own[j])
            same = buckets[i] == buckets[j]
            if a != b and buckets[i][same.argmax()] == h and similar(texts[i], texts[j], least):
                up[max(a, b)] = min(a, b)
                out.append((labels_of[own[i]], labels_of[own[j]]))
    return out


def finished(rest: DataFrame, seq: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """Pairs (a, b) of labels that the remaining pairs of the unfinished buckets join."""
    with_all = rest.join(seq.hint("merge"), "node").withColumn("x", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    blocks = with_all.select("h", F.least("part", "x").alias("lo"), F.greatest("part", "x").alias("hi"), "node", "label", "part", "buckets", "s")

    def work(key: tuple, table: pa.Table) -> pa.Table:
        cell = lambda c: table.column(c).to_pylist()
        texts = [np.frombuffer(x, _U) for x in cell("s")]
        joined = block_links(key[0].as_py(), cell("node"), cell("label"), np.array(cell("part")), np.array(cell("buckets"), np.int64), texts, least)
        return pa.table({"a": pa.array([x[0] for x in joined], pa.binary()), "b": pa.array([x[1] for x in joined], pa.binary())})

    return blocks.groupBy("h", "lo", "hi").applyInArrow(work, "a binary, b binary").distinct()


def components(links: DataFrame, stage: Stage) -> DataFrame:
    """(node, label) for every linked node: label is the least node that it is connected with.

    In each round every node points to its least neighbour, or to itself if it is less; pointers are followed to their
    ends, and the links between the ends, without loops and repeats, are the next round's. At least half of
    the nodes go with each round.
    """
    pair = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    edges, labels = stage.table(links.select(*pair).where("a <> b").distinct(), "edges"), None
    while True:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = stage.table(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("label")), "pointers")
        while True:
            beyond = up.where("label <> node").select(F.col("node").alias("label"), F.col("label").alias("further")).hint("merge")
            next_up = stage.table(up.join(beyond, "label", "left").select("node", F.coalesce("further", "label").alias("label"), F.col("further").isNotNull().alias("moved")), "pointers")
            up = next_up.select("node", "label")
            if next_up.where("moved").isEmpty():
                break
        if labels is None:
            labels = up
        else:
            step = up.select(F.col("node").alias("label"), F.col("label").alias("further")).hint("merge")
            labels = stage.table(labels.join(step, "label", "left").select("node", F.coalesce("further", "label").alias("label")), "labels")
        end = lambda c: up.select(F.col("node").alias(c), F.col("label").alias(f"{c}2")).hint("merge")
        moved = edges.join(end("a"), "a").join(end("b"), "b").select(F.col("a2").alias("a"), F.col("b2").alias("b"))
        edges = stage.table(moved.where("a <> b").select(*pair).distinct(), "edges")
        if edges.isEmpty():
            return labels


def linked(met: DataFrame, seq: DataFrame, stage: Stage, least: float = SIMILARITY) -> DataFrame:
    """(node, label) of the components that all similar pairs of a bucket make."""
    labels = components(stage.table(verified(candidates(met, least), seq, least), "links"), stage)
    more = stage.table(finished(unfinished(met, labels, stage), seq, least), "more")
    if more.isEmpty():
        return labels
    up = components(more, stage).select(F.col("node").alias("was"), F.col("label").alias("now"))
    moved = labels.join(up.hint("merge"), labels["label"] == up["was"], "left").select("node", F.coalesce("now", "label").alias("label"))
    # what had no link before is its own label
    fresh = up.join(labels.select(F.col("node").alias("was")).hint("merge"), "was", "left_anti").select(F.col("was").alias("node"), F.col("now").alias("label"))
    return stage.table(moved.unionByName(fresh), "labels")


def _classes(docs: DataFrame, id_col: str, text_col: str, least: float, stage: Stage) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows: doc_id, node), (classes: label, class_size, first), (nodes: node, class_size, first).

    first is (has no id, id, node) of the row that represents the class.
    """
    ship(docs.sparkSession)
    rows = stage.table(_sketched(docs, id_col, text_col), "sketches")
    least_id = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id"))
    # one node for each text, so copies never meet in buckets; the sketch is the same for all of them
    nodes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n"), least_id.alias("id"), F.first("size").alias("size"), F.first("buckets").alias("buckets"))
    nodes = stage.table(nodes, "nodes")
    met = members(nodes, stage)
    seq = stage.table(sequences(docs, nodes, met, text_col=text_col), "sequences")
    labels = linked(met, seq, stage, least)
    first = F.struct(F.col("id.none").alias("none"), F.col("id.doc_id").alias("doc_id"), "node").alias("first")
    named = nodes.select("node", "n", first).join(labels.hint("merge"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    named = stage.table(named, "named")
    classes = named.groupBy("label").agg(F.sum("n").alias("class_size"), F.min("first").alias("first"))
    classes = stage.table(classes, "classes")
    of = stage.table(named.select("node", "label").join(classes.hint("merge"), "label").select("node", "class_size", "first"), "of")
    return rows.select("doc_id", "node"), classes, of


def near_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """One row for each row: doc_id, class_id (the least id of its class), class_size (rows), representative.

    Null and empty texts count as texts without words, which are alike. Texts of fewer than five words are one
    shingle, so they meet only if their words are the same. Ids may be of any type that has an order; rows of one id
    with different texts are classed each by its own text. A row without an id is classed like any other; a class
    without any id has class_id null. The row of the least id represents its class, and of that id's different texts in
    one class one does; if that row is repeated, all its copies are marked. Other columns are ignored, whatever their
    names; an empty table gives no rows.
    """
    stage = Stage(docs.sparkSession, "near")
    rows, _, of = _classes(docs, id_col, text_col, least, stage)
    member = rows.join(of.hint("merge"), "node")
    me = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("node"))
    return member.select("doc_id", F.col("first.doc_id").alias("class_id"), "class_size", me.eqNullSafe(F.col("first")).alias("representative"))


def keep_one(docs: DataFrame, *, least: float = SIMILARITY) -> DataFrame:
    """One row of docs for each class of near-duplicates, the one of the least id; all columns stay as they are.

    Of repeated representatives (same id and text) one row stays. Nulls, empty and short texts are classed as in
    ``near_classes``. docs needs the columns doc_id and text; an empty table stays empty.
    """
    _, classes, _ = _classes(docs, "doc_id", "text", least, Stage(docs.sparkSession, "near"))
    keep = classes.select(F.col("first.doc_id").alias("_id"), F.col("first.node").alias("_node"))
    # the row travels as one column, so no name of the input can clash
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), node_of(whole("text")).alias("node"))
    kept = rows.join(keep.hint("merge"), (F.col("node") == F.col("_node")) & F.col("id").eqNullSafe(F.col("_id")), "left_semi")
    return kept.dropDuplicates(["node", "id"]).select("row.*")
