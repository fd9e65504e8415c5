"""Line dedup: a suffix array over line-ID sequences finds repeated runs of lines; later copies go.

A document is a sequence of lines that hold a word, each known by a 96-bit
digest. Prefix doubling sorts the suffixes: order-preserving names for blocks
of 1, 2, 4, ... lines, each made from the names of two half blocks. Equal
names are neighbours in the suffix array, so the positions under one name are the
interval whose common prefix has at least that many lines. Positions alone
under their name share no longer prefix and leave at once, which keeps the rounds small.

Doubling ends at the largest power of two within ``min_lines``; two overlapping
blocks then name every window of ``min_lines``. The union of all windows that
are not the first of their interval is exactly the union of the later copies of all
maximal repeated runs of ``min_lines`` or more, since each window of a later copy
has an earlier equal and each such window lies in a maximal run. Longer prefixes
cannot change which lines go, so none are sorted. A single line of ``min_words``
or more counts as a run of its own.

Order is doc_id, then the text's hash, then the line's place. Names come from a range-
partitioned sort of the distinct blocks, never from one task per block.

Defined cases: a null text stays null and an empty one empty; lines without a
word belong to no run and are kept; lines are compared without white space around
them; a null id comes first; rows with the same id and text are treated alike (neither
is a copy of the other); texts whose lines all go become empty; an empty table gives no rows;
other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spoor.llm.common import WHITESPACE, materialize, words

MIN_LINES = 3
MIN_WORDS = 8
_NULL_ID = -(1 << 63)


def _keys(id_col: str, text: str) -> tuple[Column, Column]:
    return F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(_NULL_ID)), F.xxhash64(F.col(f"`{text}`"))


def line_table(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, h, ord, pos, a, b, n``: every line with a word, its place among those and among all, digest and word count."""
    key, h = _keys(id_col, text)
    lines = F.transform(F.split(F.col(f"`{text}`"), "\n"), lambda x, i: F.struct(F.trim(x, F.lit(WHITESPACE)).alias("x"), i.alias("pos")))
    each = docs.select(key.alias("id"), h.alias("h"), F.posexplode(F.filter(lines, lambda s: s["x"] != "")).alias("ord", "line"))
    x = F.col("line.x")
    return each.select("id", "h", "ord", F.col("line.pos").alias("pos"), F.xxhash64(x).alias("a"), F.hash(x).alias("b"), F.size(words(x)).alias("n"))


def _named(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Names for the keys met twice or more, increasing with the keys, and the first place of each."""
    groups = rows.groupBy(*keys).agg(F.count("*").alias("times"), F.min(F.struct("id", "h", "ord")).alias("first")).where("times > 1")
    return materialize(groups.orderBy(*keys).select(*keys, F.monotonically_increasing_id().alias("name"), "first"))


def later_lines(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, h, gone``: per document the places (array of int, from 0, in order) of the lines in later copies."""
    lines = materialize(line_table(docs, id_col, text))
    rank = lines.join(_named(lines, ["a", "b"]), ["a", "b"]).select("id", "h", "ord", "pos", "n", F.col("name").alias("r"), "first")
    repeated = materialize(rank)  # only lines that occur twice or more
    place = F.struct("id", "h", "ord")
    by_doc = Window.partitionBy("id", "h").orderBy("ord")

    def ahead(df: DataFrame, s: int) -> DataFrame:
        return df.withColumn("r2", F.first("r").over(by_doc.rangeBetween(s, s))).where("r2 is not null")

    level, step = repeated.select("id", "h", "ord", "r"), 1
    while step * 2 <= min_lines:
        pairs = ahead(level, step)
        level = materialize(pairs.join(_named(pairs, ["r", "r2"]), ["r", "r2"]).select("id", "h", "ord", F.col("name").alias("r")))
        step *= 2
    windows = ahead(level, min_lines - step)
    starts = windows.join(_named(windows, ["r", "r2"]), ["r", "r2"]).where(place > F.col("first")).select("id", "h", "ord").distinct()
    marked = repeated.join(starts.withColumn("starts", F.lit(1)), ["id", "h", "ord"], "left")
    in_run = F.max("starts").over(by_doc.rangeBetween(1 - min_lines, 0)).isNotNull()
    alone = (F.col("n") >= min_words) & (place > F.col("first"))
    gone = marked.select("id", "h", "pos", (in_run | alone).alias("gone")).where("gone")
    return gone.groupBy("id", "h").agg(F.sort_array(F.collect_set("pos")).alias("gone"))


def dedup_lines(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the later copies cut from ``text``, and ``removed_lines`` (array of int): their places in the old text."""
    docs = docs.drop("removed_lines")  # columns of these names are replaced
    key, h = _keys(id_col, text)
    gone = later_lines(docs, min_lines, min_words, id_col, text).select(F.col("id").alias("_id"), F.col("h").alias("_h"), F.col("gone").alias("_gone"))
    joined = docs.join(gone, (key == F.col("_id")) & (h == F.col("_h")), "left")
    old = F.split(F.col(f"`{text}`"), "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(old) - 1), F.col("_gone"))
    cut = F.array_join(F.transform(F.array(old), lambda a: F.transform(left, lambda i: F.get(a, i)))[0], "\n")
    new = F.when(F.col("_gone").isNull(), F.col(f"`{text}`")).otherwise(cut)
    removed = F.coalesce("_gone", F.array().cast("array<int>"))
    return joined.withColumns({text: new, "removed_lines": removed}).drop("_id", "_h", "_gone")


SQL = """
WITH split_lines AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos
  FROM documents
),
kept_lines AS (
  SELECT doc_id, pos, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS x FROM split_lines
  WHERE trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> ''
),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS ord,
         len(list_filter(regexp_split_to_array(x, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')) AS n
  FROM kept_lines
),
runs AS (
  SELECT doc_id, ord, list(x) OVER w AS run, count(*) OVER w AS k, pos, n, x FROM numbered
  WINDOW w AS (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN CURRENT ROW AND {more} FOLLOWING)
),
later AS (
  SELECT *, k = {lines} AND row_number() OVER (PARTITION BY run ORDER BY doc_id, ord) > 1 AS starts,
         n >= {words} AND row_number() OVER (PARTITION BY x ORDER BY doc_id, ord) > 1 AS alone
  FROM runs
),
marked AS (
  SELECT doc_id, pos, alone OR bool_or(starts) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN {more} PRECEDING AND CURRENT ROW) AS gone
  FROM later
),
removed AS (SELECT doc_id, list(pos ORDER BY pos) AS gone FROM marked WHERE gone GROUP BY doc_id),
rebuilt AS (
  SELECT s.doc_id, coalesce(string_agg(s.line, chr(10) ORDER BY s.pos) FILTER (WHERE m.gone IS NOT TRUE), '') AS text
  FROM split_lines s LEFT JOIN marked m USING (doc_id, pos) GROUP BY s.doc_id
)
SELECT d.doc_id, b.text, coalesce(len(r.gone), 0)::BIGINT AS n_removed, coalesce(list_sum(r.gone), 0)::BIGINT AS removed_sum
FROM documents d LEFT JOIN removed r USING (doc_id) LEFT JOIN rebuilt b USING (doc_id)
"""


def oracle(min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> str:
    return SQL.format(lines=min_lines, more=min_lines - 1, words=min_words)
