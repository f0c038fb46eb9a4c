"""Personal data and secrets: exact base rules, and candidates judged by gradient boosting.

The base rules find e-mail addresses, IP addresses, card numbers and telephone numbers, leftmost and without
overlaps within a kind. Beside them, generators of high recall propose further spans, which may overlap: address
forms with a written-out or spaced at sign, dotted groups of digits, long runs of digits with separators, and long runs
of letters and digits that may be secrets. Every proposal is described by its format and its context; boosted trees give
it a probability, and a threshold calibrated on held-out proposals selects what is redacted in addition. Base spans
always stay.

The trees learn from signs that they are not shown. Whether a digit check or a range check holds, a plus sign, and the
words and prefixes that give a secret away (``password=``, ``AKIA...``) decide what a learning proposal counts as, and
none of them is a feature; confirmed proposals also count in forms that the rules miss. So what is learned is the look
of such spans, and it carries over to ones without the sign.

Finding, describing and scoring are Spark expressions over the text; the trees become nested conditions. Only
the fitting of the trees happens in the driver, on counts of all described proposals by their binned features.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stage, whole

KINDS = ("email", "ip", "card", "phone")
#: Kinds of spans, in the order in which equal starts are listed; the base rules have no secrets.
ALL_KINDS = (*KINDS, "secret")
SECRET = ALL_KINDS.index("secret")
#: The base patterns, written so that Java's matcher never backtracks over a run: a run is entered at its first
#: character, or where the last match ended (\G), and quantifiers are possessive where nothing after them overlaps.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must contain for a pattern to be tried.
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
VALID_IP = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"

#: Generators: (kind of what they propose, pattern, a cheap test of the text).
GENERATORS = (
    ("email", r"[A-Za-z0-9._%+-]++(?:\x20?[\[(](?:at|AT)[\])]\x20?|\x20?@\x20?)[A-Za-z0-9-]++(?:(?:\x20?[\[(](?:dot|DOT)[\])]\x20?|\.)[A-Za-z0-9-]++)++", r"@|[\[(](?:at|AT)[\])]"),
    ("ip", r"(?<![0-9A-Za-z.])[0-9]++(?:\.[0-9]++){2,}+(?![0-9A-Za-z])", r"[0-9]\.[0-9]"),
    ("card", r"(?<![0-9A-Za-z])[0-9]{4}[\x20._/-][0-9]{4,6}[\x20._/-][0-9]{4,5}(?:[\x20._/-][0-9]{1,7})?(?![0-9A-Za-z])", r"[0-9]{4}[\x20._/-][0-9]{4}"),
    ("phone", r"(?<![0-9A-Za-z])[+(]?[0-9](?:[\x20().-]{0,2}[0-9]){6,}+(?![0-9A-Za-z])", r"[0-9]"),
    ("secret", r"(?<![A-Za-z0-9_+/-])(?=[0-9_+/-]*+[A-Za-z])[A-Za-z0-9_+/-]{16,}+", r"[A-Za-z0-9_+/-]{16}"),
)
CUES = r"(?i)\b(?:call|tel|phone|fax|mobile|mail|e-mail|contact|write|reach|address|ip|host|server|card|visa|account|iban|ssn|passport)\b"
#: What gives a secret away to the labels (never a feature): words ahead of it, and known prefixes.
SECRET_WORDS = r"(?i)(?:passw(?:or)?d|pwd|token|secret|api[_-]?key|bearer)[\x20:=\"']{1,5}$"
SECRET_PREFIXES = r"^(?:A(?:KIA|SIA)[0-9A-Z]{16}$|gh[pousr]_|sk_|xox[abp]-|AIza)"
SPANS = "array<struct<s:int,k:int,e:int>>"
#: Rows of counts by binned features that the driver fits trees on, at most.
MOST_ROWS = 300_000
TREES, DEPTH, RATE = 30, 4, 0.4
#: Learning proposals that a leaf holds at least, and what a cut must gain: more than one wrong label can give.
LEAF_ROWS, LEAST_GAIN = 8, 1.0
#: Share of right selections wanted among held-out proposals.
PRECISION = 0.99
FEATURES = ("length", "digits", "letters", "upper", "dots", "separators", "groups", "distinct", "runs", "at", "left_word", "right_word", "assigned", "cue", "kind")
#: Features with many values, whose bins may be joined; the others have six values at most.
COUNTED = FEATURES[:9]
_FINE = 33
#: The largest number in each bin: the least whole numbers one by one, then eight bins to a doubling, the last without an end.
TOPS = (*range(_FINE), *(round(32 * 2 ** (i / 8)) for i in range(1, 31)), math.inf)
#: Joinings after which COUNTED features have a single bin.
COARSEST = 6
#: Matches whose places are summed up in one piece; the pieces are summed in turn.
_PIECE = 256


def _bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def find(text: Column, pattern: str, ready: Column) -> Column:
    """All matches as array<struct<s, e, m>>: start and end in code points, and the match.

    Places are running sums of the gaps and matches, taken piece by piece, so a text of very many matches costs little more
    than in proportion.
    """
    kind = "array<struct<s:int,e:int,m:string>>"
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    both = _bound(hits, lambda h: F.zip_with(F.slice(gaps, 1, F.size(h)), h, lambda g, m: F.struct(F.length(g).alias("g"), m.alias("m"))))

    def add(acc: Column, x: Column) -> Column:
        s = acc["at"] + x["g"]
        e = s + F.length(x["m"])
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e"), x["m"].alias("m")))).alias("out"))

    def ahead(acc: Column, x: Column) -> Column:
        return F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

    def placed(pieces: Column) -> Column:
        starts = F.aggregate(pieces, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), ahead, lambda acc: acc["out"])
        return F.flatten(F.zip_with(pieces, starts, lambda p, b: F.transform(p["out"], lambda x: F.struct((x["s"] + b).alias("s"), (x["e"] + b).alias("e"), x["m"].alias("m")))))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))
    pieces = _bound(both, lambda x: F.transform(F.sequence(F.lit(0), F.floor(F.size(x) / _PIECE).cast("int")), lambda i: F.aggregate(F.slice(x, i * _PIECE + 1, F.lit(_PIECE)), start, add)))
    return F.when(ready, _bound(pieces, placed)).otherwise(F.array().cast(kind))


def digits_of(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(m: Column) -> Column:
    """Whether the digits pass the Luhn check (at most 19 of them are looked at, more never pass)."""
    d = F.reverse(F.substring(digits_of(m), 1, 20))
    twice = lambda c: F.when(c > 4, 2 * c - 9).otherwise(2 * c)
    total = F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(d), F.lit(1))), F.lit(0), lambda acc, i: acc + F.coalesce(F.when(i % 2 == 1, _digit(d, i)).otherwise(twice(_digit(d, i))), F.lit(0)))
    return F.length(d).between(1, 19) & (total % 10 == 0)


def _digit(d: Column, i: Column) -> Column:
    return F.ascii(F.substring(d, i, F.lit(1))) - 48


def _valid(kind: str, m: Column) -> Column:
    n = F.length(digits_of(m))
    return {
        "email": lambda: F.lit(True),
        "ip": lambda: m.rlike(VALID_IP),
        "card": lambda: n.between(14, 19) & luhn(m),
        "phone": lambda: n.between(10, 15),
    }[kind]()


def _has_digit(text: Column) -> Column:
    return text.rlike("[0-9]")


def base_spans(text: Column, kind: str) -> Column:
    """Spans of one kind that pass its check: array<struct<s, k, e, m>>, k the kind's place in KINDS."""
    ready = F.contains(text, F.lit("@")) if kind == "email" else _has_digit(text) & F.contains(text, F.lit(NEEDS[kind]))
    found = F.filter(find(text, BASE[kind], ready), lambda x: _valid(kind, x["m"]))
    return F.transform(found, lambda x: F.struct(x["s"].alias("s"), F.lit(KINDS.index(kind)).alias("k"), x["e"].alias("e"))).cast(SPANS)


def proposals(text: Column) -> Column:
    """What all generators propose, with their context: array<struct<s, e, m, k, l, r>>."""
    def placed(k: int) -> Callable[[Column], Column]:
        return lambda x: F.struct(
            x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m"), F.lit(k).alias("k"),
            F.substring(text, F.greatest(x["s"] - 23, F.lit(1)), F.least(x["s"], F.lit(24))).alias("l"), F.substring(text, x["e"] + 1, F.lit(1)).alias("r"),
        )

    kind_of = "array<struct<s:int,e:int,m:string,k:int,l:string,r:string>>"
    return F.concat(*(F.transform(find(text, pattern, text.rlike(test)), placed(ALL_KINDS.index(kind))).cast(kind_of) for kind, pattern, test in GENERATORS))


def described(x: Column) -> list[Column]:
    """FEATURES of a proposal, as doubles."""
    m = x["m"]
    count = lambda cls: F.length(F.regexp_replace(m, f"[^{cls}]", ""))
    runs = F.regexp_replace(F.regexp_replace(m, "[0-9]+", "9"), "[A-Za-z]+", "a")
    values = [
        F.length(m), count("0-9"), count("A-Za-z"), count("A-Z"), count("."), count(r"\x20()_/+\-"), F.size(F.split(m, "[^0-9A-Za-z]+", -1)),
        F.size(F.array_distinct(F.split(m, ""))), F.length(runs), F.contains(m, F.lit("@")).cast("int"),
        x["l"].rlike("[0-9A-Za-z]$").cast("int"), x["r"].rlike("^[0-9A-Za-z]").cast("int"), x["l"].rlike("[=:][\\x20\"']*$").cast("int"), x["l"].rlike(CUES).cast("int"), x["k"],
    ]
    return [v.cast("double") for v in values]


def confirmed(x: Column, base: Column) -> Column:
    """What a learning proposal counts as: a span of the base rules, or a secret that its surroundings give away."""
    secret = (x["k"] == SECRET) & (x["m"].rlike("[0-9]") & x["l"].rlike(SECRET_WORDS) | x["m"].rlike(SECRET_PREFIXES))
    return secret | F.exists(base, lambda b: (b["s"] == x["s"]) & (b["e"] == x["e"]))


def binned(v: Column) -> Column:
    """The place in TOPS of the least number that v does not pass."""
    return F.when(v < _FINE, v).otherwise(_FINE - 1 + F.size(F.filter(F.array(*map(F.lit, TOPS[_FINE - 1 : -1])), lambda t: t < v))).cast("tinyint")


class Boosted:
    """Regression trees on log-odds, a calibration line and a threshold.

    x: different rows of bins; n: how many proposals of each are learned from (refuted, confirmed) and held out (refuted,
    confirmed). shift: by how much the bins of COUNTED features are coarser than TOPS.
    """

    def __init__(self, x: np.ndarray, n: np.ndarray, shift: int = 0):
        self.shift, self.rows, self.trees = shift, int(n.sum()), []
        self.kinds = sorted({int(k) for k in x[n[:, 1] + n[:, 3] > 0, FEATURES.index("kind")]})  # nothing is known of the look of others
        learned, right = n[:, 0] + n[:, 1], n[:, 1]
        rate = float(np.clip(right.sum() / learned.sum() if learned.sum() else 0.5, 1e-3, 1 - 1e-3))
        self.offset = math.log(rate / (1 - rate))
        z, use = np.full(len(x), self.offset), learned > 0
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-z))
            tree = _grow(x[use], (p * learned - right)[use], (np.maximum(p * (1 - p), 1e-6) * learned)[use], learned[use], DEPTH)
            self.trees.append(tree)
            z += _values(tree, x)
        # calibrated on the held-out part: the least margin from which on the share of right ones is as wanted
        held = n[:, 2] + n[:, 3]
        order = np.flatnonzero(held)[np.argsort(-z[held > 0], kind="stable")]
        share = np.cumsum(n[order, 3]) / np.cumsum(held[order])
        zs = z[order]
        ends = np.append(zs[1:] != zs[:-1], True) if len(zs) else np.zeros(0, bool)
        good = np.flatnonzero((share >= PRECISION) & ends)
        if len(good):  # half-way to the next margin below, but never under even odds
            after = float(zs[good[-1] + 1]) if good[-1] + 1 < len(zs) else float(zs[good[-1]])
            self.threshold = max(0.0, (float(zs[good[-1]]) + after) / 2)
        else:
            self.threshold = math.inf

    def margin(self, f: Callable[[int], Column]) -> Column:
        z = F.lit(self.offset)
        for t in self.trees:
            z = z + _expression(t, f, self.shift)
        return z


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, n: np.ndarray, depth: int):
    """A tree: a number, or (feature, last bin below, below-or-equal, above). g, h and n are sums over a row's proposals."""
    every, c, d = n.sum(), g.sum(), h.sum()
    leaf = float(np.clip(-RATE * c / (d + 1.0), -2, 2))
    if depth == 0 or every < 2 * LEAF_ROWS:
        return leaf
    best = (LEAST_GAIN, None)
    for j in range(x.shape[1]):
        rows, sums, curves = (np.bincount(x[:, j], w, len(TOPS)) for w in (n, g, h))
        full = np.flatnonzero(rows)
        low, a, b = (np.cumsum(v[full])[:-1] for v in (rows, sums, curves))
        gain = a * a / (b + 1) + (c - a) ** 2 / (d - b + 1) - c * c / (d + 1)
        gain[np.minimum(low, every - low) < LEAF_ROWS] = -math.inf  # labels are not perfect: no leaf for a single proposal
        if len(gain) and gain.max() > best[0]:
            i = int(gain.argmax())
            best = (float(gain[i]), (j, int(full[i] + full[i + 1]) // 2))
    if best[1] is None:
        return leaf
    j, cut = best[1]
    low = x[:, j] <= cut
    return (j, cut, _grow(x[low], g[low], h[low], n[low], depth - 1), _grow(x[~low], g[~low], h[~low], n[~low], depth - 1))


def _values(tree, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, float):
        return np.full(len(x), tree)
    j, cut, a, b = tree
    return np.where(x[:, j] <= cut, _values(a, x), _values(b, x))


def _expression(tree, f: Callable[[int], Column], shift: int) -> Column:
    if isinstance(tree, float):
        return F.lit(tree)
    j, cut, a, b = tree
    top = TOPS[((cut + 1) << shift) - 1] if FEATURES[j] in COUNTED else cut
    return F.when(f(j) <= float(top), _expression(a, f, shift)).otherwise(_expression(b, f, shift))


def fit(docs: DataFrame, text_col: str = "text") -> Boosted | None:
    """Trees learned from all different proposals, three in four of them, and calibrated on the others.

    Equal proposals with equal surroundings count once. Confirmed proposals also count in forms that the rules
    themselves miss, so that these can be selected. Proposals are counted by their binned features, and the driver gets
    these counts: MOST_ROWS rows at most, for whose sake bins are joined two by two, while every proposal counts.
    """
    text = F.col("_text")
    rows = docs.select(whole(text_col).alias("_text")).where(text.rlike("[0-9@]|[\\[(](?:at|AT)[\\])]|[A-Za-z0-9_+/-]{16}"))
    spans = F.concat(*(base_spans(text, k) for k in KINDS))
    each = rows.select(spans.alias("b"), F.explode(proposals(text)).alias("x"))
    judged = each.select(confirmed(F.col("x"), F.col("b")).cast("int").alias("y"), F.xxhash64("x.m", "x.l", "x.r", "x.k").alias("h"), "x").groupBy("h").agg(F.max("y").alias("y"), F.first("x").alias("x"))
    stage = Stage(docs.sparkSession, "proposals")
    judged = stage.table(judged, "judged")
    # confirmed spans in forms that the base rules miss: a written-out at sign, no plus sign, dots in a card
    m = F.col("x.m")
    other = F.when(F.contains(m, F.lit("@")), F.regexp_replace(m, "@", " (at) ")).when(F.startswith(m, F.lit("+")), F.substring(m, F.lit(2), F.length(m))).when((F.col("x.k") == KINDS.index("card")) & m.rlike("[\x20-]"), F.regexp_replace(m, "[\x20-]", "."))
    varied = judged.where(f"y = 1 AND x.k <> {SECRET}").withColumn("m2", other).where("m2 is not null").withColumn("x", F.col("x").withField("m", F.col("m2"))).drop("m2").withColumn("h", F.xxhash64("h", F.lit(1)))
    group = F.col("y") + F.when(F.pmod("h", F.lit(4)) == 0, 2).otherwise(0)
    table = judged.unionByName(varied).select(group.alias("g"), *(binned(v).alias(n) for n, v in zip(FEATURES, described(F.col("x")), strict=True)))
    counts = [f"n{i}" for i in range(4)]
    counted = stage.table(table.groupBy(*FEATURES).agg(*(F.count_if(F.col("g") == i).alias(c) for i, c in enumerate(counts))), "counted")
    shift = 0
    while counted.count() > MOST_ROWS and shift < COARSEST:
        shift += 1
        counted = stage.table(counted.groupBy(*((F.shiftright(n, 1).cast("tinyint") if n in COUNTED else F.col(n)).alias(n) for n in FEATURES)).agg(*(F.sum(c).alias(c) for c in counts)), f"coarser{shift}")
    got = counted.toArrow()
    x = np.stack([got[n].to_numpy() for n in FEATURES], axis=1).astype(np.int64)
    n = np.stack([got[c].to_numpy() for c in counts], axis=1).astype(float)
    if not (n[:, 0] + n[:, 2]).any() or not (n[:, 1] + n[:, 3]).any():
        return None
    order = np.lexsort(x.T)
    return Boosted(x[order].astype(np.uint8), n[order], shift)


def added_spans(text: Column, base: Column, model: Boosted | None) -> Column:
    """Proposals above the threshold that touch no base span nor one another: array<struct<s, k, e>>."""
    none = F.array().cast(SPANS)
    if model is None or model.threshold == math.inf:
        return none
    about = F.transform(proposals(text), lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), F.array(*described(x)).alias("f")))
    free = F.filter(about, lambda x: ~F.exists(base, lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))
    good = F.filter(free, lambda x: x["k"].isin(model.kinds) & (model.margin(lambda j: F.element_at(x["f"], j + 1)) >= model.threshold))
    ordered = F.array_sort(F.transform(good, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"))))
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))
    step = lambda acc, x: F.when(x["s"] >= acc["at"], F.struct(x["e"].alias("at"), F.concat(acc["out"], F.array(x)).alias("out"))).otherwise(acc)
    return F.aggregate(ordered, start, step, lambda acc: acc["out"])


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, ALL_KINDS)), x["k"] + 1), x["s"], x["e"])), ",")


def find_personal_data(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, n_email, n_ip, n_card, n_phone, base, spans (written spans), n_added, n_spans.

    Positions count code points from 0, ends are exclusive; spans are ordered by start, then kind. Null and empty
    texts have none. Counts and base are those of the base rules; spans holds these and what the trees select.
    If no proposal is confirmed, or none refuted, nothing is added. Repeated rows give repeated rows; other
    columns are ignored.
    """
    model = fit(docs, text_col)
    text = F.col("_text")
    rows = docs.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("_text"))
    found = rows.select("doc_id", "_text", *(base_spans(text, k).alias(f"_{k}") for k in KINDS))
    base = found.withColumn("_base", F.array_sort(F.concat(*(f"_{k}" for k in KINDS))))
    both = base.withColumn("_added", added_spans(text, F.col("_base"), model))
    return both.select(
        "doc_id", *(F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS), written(F.col("_base")).alias("base"),
        written(F.array_sort(F.concat("_base", "_added"))).alias("spans"), F.size("_added").cast("long").alias("n_added"), (F.size("_base") + F.size("_added")).cast("long").alias("n_spans"),
    )
