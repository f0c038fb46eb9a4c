"""URL verdicts by a weighted vocabulary, with host rules that override it.

The vocabulary is data: terms with weights, from a table or any sequence. An Aho-Corasick automaton finds every term in
the lower-cased url; a hit counts only where it is not part of a longer word (no letter or digit on either side), and
each term counts once. A term of weight 1 or more is strict: one of them blocks. The others are soft: two or more
different ones block if their weights reach 1 together. A rule that fits the host and path decides instead.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = str.maketrans(UPPER, LOWER)


@dataclass(frozen=True)
class Rule:
    """host and all its subdomains, with a path that starts with path."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Term:
    """A lower-case term; its weight is what it adds to a url's, and a strict one's is 1 at least."""

    text: str
    weight: float

    @property
    def strict(self) -> bool:
        return self.weight >= 1.0


def _terms(strict: str, soft: dict[float, str]) -> tuple[Term, ...]:
    return tuple(Term(t, 1.0) for t in strict.split()) + tuple(Term(t, w) for w, some in soft.items() for t in some.split())


#: The vocabulary where none is given.
DEFAULT_TERMS = _terms(
    "casino porn xxx pills viagra escort betting ads-track malware warez",
    {0.75: "adult lottery bets", 0.5: "free cheap win bonus deal promo track click ads loan sale coupon"},
)
#: Terms that an automaton is built of at most (about 100 bytes each on every worker).
MOST_TERMS = 2_000_000


def read_terms(table: DataFrame, term_col: str = "term", weight_col: str = "weight") -> tuple[Term, ...]:
    """The vocabulary from a table: null and empty terms go, the largest weight of a repeated term counts.

    Its size is checked ahead of sending it out: more than MOST_TERMS raise ValueError.
    """
    text = F.translate(F.col(term_col), UPPER, LOWER)
    once = table.select(text.alias("t"), F.col(weight_col).cast("double").alias("w")).where("t <> '' AND w IS NOT NULL").groupBy("t").agg(F.max("w").alias("w"))
    rows = once.limit(MOST_TERMS + 1).collect()
    if len(rows) > MOST_TERMS:
        raise ValueError(f"a vocabulary of more than {MOST_TERMS} terms")
    return tuple(sorted((Term(r["t"], r["w"]) for r in rows), key=lambda t: t.text))


class Vocabulary:
    """Finds the different terms of a url."""

    def __init__(self, terms: Sequence[Term]):
        self.automaton = ahocorasick.Automaton()
        for t in sorted(terms, key=lambda t: t.weight):  # of a repeated term the largest weight counts
            self.automaton.add_word(t.text, t)
        self.automaton.make_automaton()

    def hits(self, url: str) -> tuple[int, int, float]:
        """(different strict terms, different soft terms, weight of the soft ones), with a boundary on both sides."""
        found = set()
        for end, term in self.automaton.iter(url) if len(self.automaton) else ():
            start = end - len(term.text) + 1
            if not (start > 0 and _word(url[start - 1])) and not (end + 1 < len(url) and _word(url[end + 1])):
                found.add(term)
        soft = [t.weight for t in found if not t.strict]
        return len(found) - len(soft), len(soft), math.fsum(soft)


def _word(c: str) -> bool:
    return "a" <= c <= "z" or "0" <= c <= "9"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(F.coalesce(url, F.lit("")), "://")
    return F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise(F.lit(""))


def best_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule that fits, as struct(name, verdict), else null."""
    pick = F.lit(None).cast("struct<name:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):  # later ones, the longer, win
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        pick = F.when(fits, F.struct(F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"))).otherwise(pick)
    return pick


def judge_urls(pages: DataFrame, rules: Sequence[Rule] = (), terms: Sequence[Term] = DEFAULT_TERMS, *, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row for each row: page_id, host, path, rule, verdict, n_strict, n_soft, soft_weight (rounded to 6 digits).

    A null url, or one without ``://``, has an empty host and path and fits no rule; the vocabulary still
    reads whatever text there is (null: none, so allow), however long. Without terms the rules alone decide. Repeated
    rows give repeated rows; an empty table gives none. Only the id and url columns are scanned, whatever others are
    called, and nothing is shuffled.
    """
    spark = pages.sparkSession
    ship(spark)
    id_kind = pages.schema[id_col].dataType.simpleString()
    u = F.col("_url")
    cut = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("_url")).withColumns({"host": host_of(u), "path": path_of(u)})
    sent, key = spark.sparkContext.broadcast(tuple(terms)), uuid.uuid4().hex  # MOST_TERMS at most

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(key, sent.value)
        for b in batches:
            hits = [vocabulary.hits((x.as_py() or "").translate(_FOLD)) for x in b.column(1)]
            found = [pa.array([h[i] for h in hits], kind) for i, kind in enumerate((pa.int32(), pa.int32(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), *found], ["page_id", "host", "path", "n_strict", "n_soft", "soft_weight"])

    counted = cut.mapInArrow(count, f"page_id {id_kind}, host string, path string, n_strict int, n_soft int, soft_weight double")
    weight = F.round("soft_weight", 6)
    bad = (F.col("n_strict") >= 1) | ((F.col("n_soft") >= 2) & (weight >= 1))
    return counted.withColumn("_rule", best_rule(F.col("host"), F.col("path"), rules)).select(
        "page_id", "host", "path", F.col("_rule.name").alias("rule"),
        F.coalesce(F.col("_rule.verdict"), F.when(bad, "block").otherwise("allow")).alias("verdict"), "n_strict", "n_soft", weight.alias("soft_weight"),
    )


_BUILT: dict[str, Vocabulary] = {}


def _vocabulary(key: str, terms: Sequence[Term]) -> Vocabulary:
    """A worker builds an automaton once and keeps one."""
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Vocabulary(terms)
    return _BUILT[key]


def judge_sql(rules: Sequence[Rule], terms: Sequence[Term] = DEFAULT_TERMS) -> str:
    """The same in DuckDB SQL over the view ``pages``."""
    has = lambda t: f"regexp_matches(u, '(^|[^a-z0-9]){t.text}($|[^a-z0-9])')::INT"
    strict, soft = [t for t in terms if t.strict], [t for t in terms if not t.strict]
    fit = lambda r: f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')"
    longest = sorted(rules, key=lambda r: (len(r.name), r.name), reverse=True)
    rule = "CASE " + " ".join(f"WHEN {fit(r)} THEN '{r.name}'" for r in longest) + " END" if rules else "NULL::VARCHAR"
    verdict = "CASE " + " ".join(f"WHEN {fit(r)} THEN '{r.verdict}'" for r in longest) + " WHEN n_strict >= 1 OR (n_soft >= 2 AND soft_weight >= 1) THEN 'block' ELSE 'allow' END"
    return f"""
WITH a AS (
  SELECT page_id, translate(coalesce(url, ''), '{UPPER}', '{LOWER}') AS u,
    CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
    CAST({" + ".join(map(has, strict))} AS INT) AS n_strict, CAST({" + ".join(map(has, soft))} AS INT) AS n_soft,
    round({" + ".join(f"{t.weight}::DOUBLE * {has(t)}" for t in soft)}, 6) AS soft_weight FROM a)
SELECT page_id, host, path, {rule} AS rule, {verdict} AS verdict, n_strict, n_soft, soft_weight FROM b"""
