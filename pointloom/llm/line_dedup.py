"""Line deduplication across documents, answered by per-document keep bitmaps.

Every document is split into lines; the keys of its long lines are hashed to 128 bits and laid out by a
range partitioning of the hashes with a secondary sort by document and position, where one streaming pass
meets the occurrences of a key in order and takes the first of them. A key that very many documents hold
is dealt over several ranges by a slice of the document id, and the slices' first occurrences and counts
(one row each) are merged afterwards, so no task ever holds all occurrences of a key; what is known of a key goes back
to its occurrences slice by slice too. What comes back for a document is a run-length compressed bitmap of its lines,
not its text, and the text that is kept is cut out of the document by that bitmap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, Stage, whole

STRIP = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Ranges that the occurrences of one key are dealt over at most.
SLICES = 256


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z lower-cased (no other letters)."""
    cut = F.btrim(line, F.lit(STRIP))
    return F.when(F.octet_length(cut) == F.length(cut), F.lower(cut)).otherwise(F.translate(cut, UPPER, LOWER))


def lines_of(text: Column) -> Column:
    """The text split at line feeds; an empty text has one empty line."""
    return F.split(text, "\n", -1)


#: The bitmap as it is stored: the runs of dropped lines, in order; all other lines are kept.
BITMAP = "array<struct<at:int,len:int>>"


def shared_lines(docs: DataFrame, stage: Stage, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5, slices: int = SLICES) -> DataFrame:
    """The bitmaps (doc_id, t, gone) of the documents that lose lines: gone is a BITMAP, positions count from 0.

    t is a hash of the text, so that rows of one id with different texts lose each its own lines. A key of at least
    min_chars code points that at least min_docs documents hold stays in the largest id alone. Rows without an id
    neither count nor lose lines.
    """
    line = F.col("_line")
    long_lines = (
        docs.where(F.col(id_col).isNotNull())
        .select(F.col(id_col).alias("doc_id"), F.xxhash64(whole(text_col)).alias("t"), F.posexplode(lines_of(whole(text_col))).alias("pos", "_line"))
        .where(F.length(line) >= min_chars)
        .withColumn("_line", F.btrim(line, F.lit(STRIP)))
        .where(F.length(line) >= min_chars)
        .withColumn("_line", line_key(line))
        .select(F.xxhash64("_line").alias("h1"), F.xxhash64(F.lit(7), "_line").alias("h2"), "doc_id", "t", "pos")
    )
    occurrences = stage.table(long_lines, "occurrences")
    # ranges of hashes, each key cut further by a slice of its documents; sorted by document and position
    dealt = occurrences.withColumn("slice", F.pmod(F.xxhash64("doc_id"), F.lit(slices)))
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = dealt.repartitionByRange(parts, "h1", "h2", "slice")
    stream = Window.partitionBy("h1", "h2", "slice").orderBy(F.desc("doc_id"), F.asc("pos"))
    before = F.lag("doc_id").over(stream)
    met = ranged.select("h1", "h2", "slice", "doc_id", (before.isNull() | (before != F.col("doc_id"))).cast("int").alias("new"))
    # of every slice: how many documents passed by, and the first of them (the largest id)
    firsts = met.groupBy("h1", "h2", "slice").agg(F.sum("new").alias("n"), F.max("doc_id").alias("keep"))
    keys = firsts.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max("keep").alias("keep"), F.collect_set("slice").alias("in")).where(F.col("n") >= min_docs)
    frequent = stage.table(keys.select("h1", "h2", "keep", "in"), "frequent")  # in: ``slices`` numbers at most
    if frequent.count() <= BROADCAST_ROWS:
        met = occurrences.join(F.broadcast(frequent.select("h1", "h2", "keep")), ["h1", "h2"])  # 24 bytes a row
    else:
        met = dealt.join(frequent.withColumn("slice", F.explode("in")).drop("in").hint("merge"), ["h1", "h2", "slice"])
    going = met.where(F.col("doc_id") != F.col("keep")).groupBy("doc_id", "t").agg(F.array_sort(F.collect_set("pos")).alias("drop"))  # a document's own lines
    return stage.table(going.select("doc_id", "t", bitmap(F.col("drop")).alias("gone")), "going")


def bitmap(drop: Column) -> Column:
    """Sorted dropped positions as a BITMAP; two passes over them."""
    starts = F.filter(drop, lambda p, i: (i == 0) | (F.get(drop, i - 1) != p - 1))
    ends = F.filter(drop, lambda p, i: F.coalesce(F.get(drop, i + 1) != p + 1, F.lit(True)))
    return F.zip_with(starts, ends, lambda a, e: F.struct(a.alias("at"), (e - a + 1).alias("len"))).cast(BITMAP)


def _end(gone: Column, i: Column) -> Column:
    """Where the i-th dropped run ends; 0 ahead of the first."""
    run = F.get(gone, i)
    return F.coalesce(run["at"] + run["len"], F.lit(0))


def runs(gone: Column, n_lines: Column) -> Column:
    """The bitmap as alternating run lengths that sum to n_lines: kept, dropped, kept, ..."""
    pairs = F.transform(gone, lambda r, i: F.array(r["at"] - _end(gone, i - 1), r["len"]))
    return F.concat(F.flatten(pairs), F.array(n_lines.cast("int") - _end(gone, F.size(gone) - 1)))


def dropped(gone: Column) -> Column:
    return F.aggregate(gone, F.lit(0).cast("long"), lambda n, r: n + r["len"])


def kept_text(text: Column, gone: Column) -> Column:
    """The text without the lines that the bitmap drops: its kept runs, cut out of the array of lines."""

    def cut(lines: Column) -> Column:
        ahead = F.transform(gone, lambda r, i: F.slice(lines, _end(gone, i - 1) + 1, r["at"] - _end(gone, i - 1)))
        last = _end(gone, F.size(gone) - 1)
        return F.array_join(F.concat(F.flatten(ahead), F.slice(lines, last + 1, F.size(lines) - last)), "\n")

    # bound as a lambda's argument, so the text is split once
    return F.when(F.size(gone) == 0, text).otherwise(F.get(F.transform(F.array(lines_of(text)), cut), F.lit(0)))


def line_bitmaps(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5, slices: int = SLICES, with_text: bool = False) -> DataFrame:
    """One row for each document: doc_id, n_lines, n_dropped, keep_runs; with_text adds kept_text.

    keep_runs is the compressed bitmap: lengths of alternating runs of kept and dropped lines, kept first
    (so [0, 2, 5] drops the first two of seven lines, and [7] drops none); kept_text is what it leaves. Null and empty
    texts are one empty line, which stays. A document that holds a line twice counts once, and the document that keeps the line
    keeps each occurrence. Repeated rows of one id are one document when documents are counted, and
    each is answered. A row whose id is null keeps all its lines. Other columns
    are ignored; an empty table gives no rows.
    """
    going = shared_lines(docs, Stage(docs.sparkSession, "lines"), id_col=id_col, text_col=text_col, min_chars=min_chars, min_docs=min_docs, slices=slices)
    texts = docs.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("_text")).withColumn("t", F.xxhash64("_text"))
    # merged by id at every size: the table of bitmaps grows with the input, so it is never sent out whole
    both = texts.join(going.hint("merge"), ["doc_id", "t"], "left").select("doc_id", "_text", F.coalesce("gone", F.array().cast(BITMAP)).alias("gone"))
    out = both.select("doc_id", F.size(lines_of(F.col("_text"))).cast("long").alias("n_lines"), "gone", "_text")
    kept = [kept_text(F.col("_text"), F.col("gone")).alias("kept_text")] if with_text else []
    return out.select("doc_id", "n_lines", dropped(F.col("gone")).alias("n_dropped"), runs(F.col("gone"), F.col("n_lines")).alias("keep_runs"), *kept)


LINES_SQL = f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM l),
f AS (SELECT key, max(doc_id) AS keep FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.doc_id, i, line, f.keep IS NOT NULL AND f.keep <> k.doc_id AS gone FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id"""


def drop_lines(docs: DataFrame, *, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """The rows of docs with the lines gone that line_bitmaps would drop; n_chars, if there, follows the text.

    Every row stays, even one that loses all its lines (its text is then empty). A row without an id, a null text and
    an empty one stay as they are; repeated rows lose the same lines. All columns stay, whatever their names; docs
    needs doc_id and text. An empty table stays empty.
    """
    going = shared_lines(docs, Stage(docs.sparkSession, "lines"), min_chars=min_chars, min_docs=min_docs)
    # the row travels as one column, so no name of the input can clash
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    joined = rows.join(going.hint("merge"), (F.col("row.doc_id") == going["doc_id"]) & (F.xxhash64(whole("row.text")) == going["t"]), "left")
    gone = F.col("gone").isNotNull()
    row = F.col("row").withField("text", F.when(gone, kept_text(whole("row.text"), F.col("gone"))).otherwise(F.col("row.text")))
    out = joined.select(row.alias("row"), gone.alias("gone"))
    if "n_chars" in docs.columns:
        n = F.when(F.col("gone"), F.length("row.text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
        out = out.select(F.col("row").withField("n_chars", n).alias("row"))
    return out.select("row.*")
