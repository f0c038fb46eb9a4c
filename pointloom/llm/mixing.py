"""Mixing sources to target weights by temperature.

A source's share of tokens p becomes a weight proportional to p ** a. The exponent a in [0, 1] is found by
bisection: the largest a whose weights reach the target entropy, raised where that would repeat some source
more often than allowed. The budget is the smallest at which every source is used up at least once, so no
document is lost: the largest source is taken once and the others in whole rounds plus a part of one more.

A source's documents are laid out as a permutation: they are dealt by a hash of id and text over blocks, the blocks
follow one another, and inside a block the hash orders them. Rows that are equal in all of this change places freely, so
they are counted before anything else and take part as one row with a weight; rows that share an id but not the text
lie in different blocks. What a source's budget leaves after its whole rounds is spent
along that order, document by document, until the tokens run out. Blocks are of bounded size whatever the
source's, so running sums are taken within blocks and over block totals, never over a source as a whole.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Stage, whole

WORD = r"[^ \t\n\x0B\f\r]+"
#: Documents a block has on average.
BLOCK_DOCS = 2048
#: Blocks whose totals are summed in one task; sums of these are summed in turn.
SUPER_BITS = 10
#: The interval of the exponent is halved this many times.
HALVINGS = 30
#: Seed of the permutations.
SEED = 11
#: Exponents tried in one pass over the shares: HALVINGS is a multiple of its logarithm.
_AT_ONCE = 32


def tokens_of(text: Column) -> Column:
    """Words: runs of anything but ASCII white space."""
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def order_key(doc_id: Column, text: Column, seed: int) -> Column:
    """A document's place in its source's permutation: 60 bits of a digest of seed, id and text."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(text))), 1, 15), 16, 10).cast("long")


def _sums(shares: DataFrame, exponents: list[float]) -> list[tuple[float, float, float]]:
    """For each exponent a: sum of p^a, of p^a ln p^a, and the largest p^a / p. One partial aggregation."""
    p = F.col("p")
    cols = []
    for i, a in enumerate(exponents):
        w = F.pow(p, F.lit(a))
        cols += [F.sum(w).alias(f"s{i}"), F.sum(w * F.log(p) * a).alias(f"e{i}"), F.max(w / p).alias(f"r{i}")]
    row = shares.agg(*cols).first()
    return [(row[f"s{i}"], row[f"e{i}"], row[f"r{i}"]) for i in range(len(exponents))]


def _entropy(s: float, e: float) -> float:
    return math.log(s) - e / s


def find_exponent(shares: DataFrame, target_entropy: float, max_rounds: float) -> float:
    """The largest a in [0, 1] with entropy >= target_entropy * ln(sources), or the smallest with no more than max_rounds.

    Entropy falls and rounds fall as a grows, so both are bisected on one interval: _AT_ONCE exponents
    are tried in each pass, which narrows the interval as five halvings do.
    """
    top = shares.agg(F.max("p").alias("p"), F.count(F.lit(1)).alias("n")).first()
    if not top["n"] or top["n"] < 2:
        return 1.0
    goal = target_entropy * math.log(top["n"])

    def bisect(good, lo: float, hi: float) -> float:
        """good holds up to some exponent and not beyond; the largest tried one for which it holds, else lo."""
        for _ in range(HALVINGS // int(math.log2(_AT_ONCE))):
            grid = [lo + (hi - lo) * i / _AT_ONCE for i in range(_AT_ONCE + 1)]
            held = [good(a, x) for a, x in zip(grid, _sums(shares, grid), strict=True)]
            k = max((i for i, h in enumerate(held) if h), default=0)
            if k == _AT_ONCE:
                return hi
            lo, hi = grid[k], grid[k + 1]
        return lo

    by_entropy = bisect(lambda a, x: _entropy(x[0], x[1]) >= goal - 1e-12, 0.0, 1.0)
    over = lambda a, x: x[2] * top["p"] ** (1 - a) > max_rounds + 1e-9  # noqa: E731  max(w/p) over the largest source's w/p
    by_rounds = bisect(over, 0.0, 1.0)
    by_rounds = 0.0 if by_rounds == 0.0 and not over(0.0, _sums(shares, [0.0])[0]) else by_rounds + 2.0**-HALVINGS
    return min(1.0, max(by_entropy, by_rounds))


def plan_mix(docs: DataFrame, stage: Stage, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", target_entropy: float = 0.9, max_rounds: float = 4.0, seed: int = SEED, block_docs: int = BLOCK_DOCS, with_key: bool = False) -> DataFrame:
    """One row for each document: doc_id, source, n_tokens, weight_ppm, block, before, copies.

    copies (1 or more) is how often the document is taken; block and before (tokens of the source's order
    ahead of it) are its place in the source's permutation; weight_ppm is the source's weight in millionths.
    Null sources form a source of their own. Null and empty texts have 0 tokens and are taken as their place
    in the order says. A source without tokens is taken once. Repeated rows are separate documents that lie
    next to each other; rows without an id are placed by their texts. Other columns are ignored. An empty table gives
    no rows.
    """
    rows = stage.table(
        docs.select(
            F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), tokens_of(whole(text_col)).alias("n_tokens"),
            order_key(F.col(id_col), whole(text_col), seed).alias("_h"),
        ).groupBy("doc_id", "source", "n_tokens", "_h").agg(F.count(F.lit(1)).alias("_m")),
        "tokens",
    )
    sources = stage.table(rows.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("_m")).alias("tokens"), F.sum("_m").alias("docs")), "sources")
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    shares = sources.where("tokens > 0").select("source", "tokens", "docs", (F.col("tokens") / F.lit(float(max(total, 1)))).alias("p"))
    a = find_exponent(shares, target_entropy, max_rounds)
    scale, largest = _sums(shares, [a])[0][0], shares.agg(F.max("p")).first()[0]
    # budget of a source in tokens: its weight times the least total that uses the largest source up once
    p = F.col("tokens") / F.lit(float(max(total, 1)))
    some = F.col("tokens") > 0
    plan = sources.select(
        F.col("source").alias("_source"), "tokens", F.greatest(F.ceil(F.col("docs") / block_docs).cast("long"), F.lit(1)).alias("blocks"),
        F.when(some, F.round(F.pow(p, F.lit(a)) / F.lit(scale or 1.0) * 1e6)).otherwise(0).cast("long").alias("weight_ppm"),
        F.when(some, F.floor(F.col("tokens") * F.pow(p / F.lit(largest or 1.0), F.lit(a - 1.0)) + F.lit(0.5))).otherwise(0).cast("long").alias("_budget"),
    )
    whole_rounds, rest = F.when(some, F.expr("_budget div tokens")).otherwise(1), F.when(some, F.expr("_budget % tokens")).otherwise(0)
    plan = stage.table(plan.select("_source", "weight_ppm", "blocks", whole_rounds.alias("whole"), rest.alias("rest")), "plan")
    # the plan has a row for each source: sent to all if that is small, else joined by source
    dealt = rows.join(_sized(plan), rows["source"].eqNullSafe(plan["_source"])).withColumn("block", F.pmod(F.col("_h"), F.col("blocks"))).drop("_source")
    inside = Window.partitionBy("source", "block").orderBy("_h", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    ranked = dealt.withColumn("_in", F.coalesce(F.sum(F.col("n_tokens") * F.col("_m")).over(inside), F.lit(0)))
    # starts of the blocks: running totals inside groups of blocks, and over the groups' totals
    blocks = stage.table(dealt.groupBy("source", "block").agg(F.sum(F.col("n_tokens") * F.col("_m")).alias("_n")).withColumn("_g", F.shiftright("block", SUPER_BITS)), "blocks")
    ahead = lambda keys, by: F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = blocks.groupBy("source", "_g").agg(F.sum("_n").alias("_n")).select(F.col("source").alias("_gs"), F.col("_g").alias("_gg"), ahead(["source"], "_g").alias("_base"))
    inner = blocks.select(F.col("source").alias("_s"), F.col("block").alias("_k"), "_g", ahead(["source", "_g"], "block").alias("_off"))
    starts = stage.table(inner.join(groups, F.col("_s").eqNullSafe(F.col("_gs")) & (F.col("_g") == F.col("_gg"))).select("_s", "_k", (F.col("_base") + F.col("_off")).alias("_start")), "starts")
    placed = ranked.join(_sized(starts), ranked["source"].eqNullSafe(starts["_s"]) & (ranked["block"] == starts["_k"]))
    # equal rows follow one another
    each = placed.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_m") - 1))).withColumn("before", F.col("_start") + F.col("_in") + F.col("_i") * F.col("n_tokens"))
    out = each.select("doc_id", "source", "n_tokens", "weight_ppm", "block", "before", (F.col("whole") + (F.col("before") < F.col("rest")).cast("long")).alias("copies"), "_h")
    return out if with_key else out.drop("_h")


def _sized(table: DataFrame, most: int = 50_000) -> DataFrame:
    """A staged table is sent to all executors only if it has few rows (names of sources are short)."""
    return F.broadcast(table) if table.count() <= most else table


def mix(docs: DataFrame, stage: Stage, **options) -> DataFrame:
    """The mixture itself: the input's rows, each as often as its plan says. Columns are those of docs.

    Every row stays at least once, those without id, source or text too. Rows that are equal in id, source and text are
    all taken as often as the most often taken of them. Other columns stay, whatever their names; an empty table stays empty.
    """
    id_col, source_col, text_col = (options.get(f"{c}_col", d) for c, d in (("id", "doc_id"), ("source", "source"), ("text", "text")))
    plan = plan_mix(docs, stage, **options, with_key=True)
    more = plan.where("copies > 1").groupBy(F.col("_h").alias("_k"), F.col("doc_id").alias("_i"), F.col("source").alias("_s")).agg(F.max("copies").alias("_copies"))
    # the row travels as one column, so no name of the input can clash
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("s"), order_key(F.col(id_col), whole(text_col), options.get("seed", SEED)).alias("k"))
    joined = rows.join(stage.table(more, "more").hint("merge"), (F.col("k") == F.col("_k")) & F.col("id").eqNullSafe(F.col("_i")) & F.col("s").eqNullSafe(F.col("_s")), "left")
    return joined.select("row", F.explode(F.sequence(F.lit(1), F.coalesce("_copies", F.lit(1)).cast("int")))).select("row.*")


def mix_sql(target_entropy: float = 0.9, max_rounds: float = 4.0, seed: int = SEED, block_docs: int = BLOCK_DOCS) -> str:
    """The plan in DuckDB SQL over the view ``documents``."""
    return f"""
WITH RECURSIVE t AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS n_tokens,
    CAST('0x' || substr(md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS h FROM documents),
s AS (SELECT source, sum(n_tokens)::BIGINT AS tokens, count(*) AS docs FROM t GROUP BY source),
p AS (SELECT list(tokens / (SELECT sum(tokens) FROM s)::DOUBLE ORDER BY source) AS ps FROM s WHERE tokens > 0),
q AS (SELECT ps, list_max(ps) AS top, len(ps) AS n, {target_entropy} * ln(len(ps)) - 1e-12 AS goal FROM p),
f AS (SELECT 0 AS i, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi, 0.0::DOUBLE AS lo2, 1.0::DOUBLE AS hi2
  UNION ALL
  SELECT i + 1, CASE WHEN good THEN mid ELSE lo END, CASE WHEN good THEN hi ELSE mid END, CASE WHEN over THEN mid2 ELSE lo2 END, CASE WHEN over THEN hi2 ELSE mid2 END
  FROM (SELECT *, ln(list_sum(list_transform(ps, lambda x: pow(x, mid)))) - list_sum(list_transform(ps, lambda x: pow(x, mid) * ln(x) * mid)) / list_sum(list_transform(ps, lambda x: pow(x, mid))) >= goal AS good,
      list_max(list_transform(ps, lambda x: pow(x, mid2) / x)) * pow(top, 1 - mid2) > {max_rounds} + 1e-9 AS over
    FROM (SELECT *, (lo + hi) / 2 AS mid, (lo2 + hi2) / 2 AS mid2 FROM f, q WHERE i < {HALVINGS}))),
a AS (SELECT CASE WHEN n < 2 THEN 1.0 ELSE least(1.0, greatest(
    CASE WHEN -list_sum(list_transform(ps, lambda x: x * ln(x))) >= goal THEN 1.0 ELSE lo END,
    CASE WHEN list_max(list_transform(ps, lambda x: 1 / x)) * top > {max_rounds} + 1e-9 THEN lo2 + pow(2.0, -{HALVINGS}) ELSE 0.0 END)) END AS a, ps, top FROM f, q WHERE i = {HALVINGS}),
w AS (SELECT source, tokens, greatest(CAST(ceil(docs / {block_docs}) AS BIGINT), 1) AS blocks,
    CASE WHEN tokens > 0 THEN pow(tokens / (SELECT sum(tokens) FROM s)::DOUBLE, a) / list_sum(list_transform(ps, lambda x: pow(x, a))) ELSE 0 END AS weight,
    CASE WHEN tokens > 0 THEN CAST(floor(tokens * pow(tokens / (SELECT sum(tokens) FROM s)::DOUBLE / top, a - 1) + 0.5) AS BIGINT) ELSE 0 END AS budget FROM s, a),
o AS (SELECT t.doc_id, t.source, n_tokens::BIGINT AS n_tokens, weight, budget, tokens, h % blocks AS block,
    coalesce(sum(n_tokens) OVER (PARTITION BY t.source ORDER BY h % blocks, h, t.doc_id, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM t JOIN w ON t.source IS NOT DISTINCT FROM w.source)
SELECT doc_id, source, n_tokens, CAST(round(weight * 1e6) AS BIGINT) AS weight_ppm, block, before,
  CASE WHEN tokens > 0 THEN budget // tokens + CASE WHEN before < budget % tokens THEN 1 ELSE 0 END ELSE 1 END AS copies FROM o"""
