"""Quality rules with thresholds learned from mergeable quantile sketches.

Every document gets counts, each with what it is counted among: symbols and capitals among the characters of
words, characters of words per word, repeated lines among lines, words in repeated windows among
words. Rates are put on a fixed grid, so that the number of documents per grid cell is a quantile
sketch of bounded size which merges by addition, in any order, to the same
result. Sketches are kept per language and source, and merged into languages and the whole
corpus. Quantiles of a group are drawn towards those of its language, and these towards those of the
corpus, as if ``PRIOR`` documents more had the coarser quantile, so small groups change by degrees.

Fences come from the spread of the group alone: three interquartile ranges beyond the quartiles or, for
repetition, of which most documents have none and many clean ones some, three times the distance of the 99th from the
90th percentile beyond the 99th. The only tolerance is that of counting: a document whose rate is just at the fence
would have a count of ``m``, give or take, so it is out if its count is over ``m + 3 sqrt(m) + 3`` (below: under
``m - 3 sqrt(m) - 3``). A document is kept if it passes the base rule and none of its counts is out.

Defined cases: a null text counts as an empty one (no words, base_failed); null
language or source forms a group of its own with the empty name; repeated rows
are judged one by one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spoor.llm.common import UPPER, WHITESPACE, bind, count_chars, materialize, total, without, words

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
PRIOR = 50
WIDTH = 3
MAX_BROADCAST_GROUPS = 10_000
#: statistic -> (count, counted among, grid cells per unit, by its tail, fence below too)
METRICS = {
    "symbols": ("n_symbols", "word_chars", 1000, False, False),
    "upper": ("n_upper", "word_chars", 1000, False, False),
    "word_length": ("word_chars", "n_words", 100, False, True),
    "dup_lines": ("n_dup_lines", "n_lines", 1000, True, False),
    "repeats": ("n_repeat_words", "n_words", 1000, True, False),
}
QUANTILES = {"q25": 25, "q75": 75, "q90": 90, "q99": 99}
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeat_words(w: Column, size: int = 3) -> Column:
    """Word positions covered by windows of ``size`` words that occur twice or more in ``w``."""

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            same = F.filter(s, lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]))
            return F.sort_array(F.transform(same, lambda x: x["i"]))

        def cover(r: Column) -> Column:
            return total(F.transform(r, lambda x, k: F.least(F.lit(size), F.coalesce(F.get(r, k + 1), x + size) - x)))

        return bind(bind(pairs, starts), cover)

    def windows(a: Column) -> Column:
        return F.transform(
            F.slice(a, 1, F.greatest(F.size(a) - (size - 1), F.lit(0))),
            lambda x, i: F.xxhash64(x, *[F.get(a, i + k) for k in range(1, size)]),
        )

    def counted(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h))

    return bind(bind(w, windows), counted)


def statistics(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``docs`` with ``stats``, one struct of the base counts, the gridded statistics and the group."""
    docs = docs.drop("stats", "kept")  # columns of these names are replaced
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.trim(x, F.lit(WHITESPACE)) != "")
    dup = bind(lines, lambda a: F.struct(F.size(a).alias("n"), (F.size(a) - F.size(F.array_distinct(a))).alias("dup")))
    of_words = bind(words(t), lambda w: F.struct(F.size(w).alias("n"), repeat_words(w).alias("repeat")))
    raw = F.struct(
        of_words.alias("w"),
        dup.alias("l"),
        F.length(without(t, WHITESPACE)).cast("long").alias("word_chars"),
        count_chars(t, SYMBOLS).cast("long").alias("n_symbols"),
        count_chars(t, UPPER).cast("long").alias("n_upper"),
        F.coalesce(F.col(f"`{lang}`"), F.lit("")).alias("lang"),
        F.coalesce(F.col(f"`{source}`"), F.lit("")).alias("source"),
    )

    def named(s: Column) -> Column:
        n, rep = s["w"]["n"].cast("long"), s["w"]["repeat"]
        return F.struct(
            n.alias("n_words"),
            s["word_chars"].alias("word_chars"),
            s["n_symbols"].alias("n_symbols"),
            s["l"]["dup"].cast("long").alias("n_dup_lines"),
            rep.alias("n_repeat_words"),
            ((n < MIN_WORDS) | (100 * rep > MAX_REPEAT_PERCENT * n)).alias("base_failed"),
            s["n_upper"].alias("n_upper"),
            s["l"]["n"].cast("long").alias("n_lines"),
            s["lang"].alias("lang"),
            s["source"].alias("source"),
        )

    # bound, so that the optimiser cannot copy the work into every use of a field
    return docs.withColumn("stats", bind(raw, named))


def sketches(stats: DataFrame) -> DataFrame:
    """Counts per language, source, statistic and grid cell of the documents that pass the base rule."""
    s = F.col("stats")
    cell = lambda c, d, scale: F.floor(s[c] * scale / F.greatest(s[d], F.lit(1))).cast("long")
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), cell(*how[:3]).alias("cell")) for m, how in METRICS.items()])
    # an empty array rather than a filter, which would work the statistics out once more
    passed = F.explode(F.when(s["base_failed"], F.slice(cells, 1, 0)).otherwise(cells))
    return (
        stats.select(s["lang"].alias("lang"), s["source"].alias("source"), passed.alias("c"))
        .groupBy("lang", "source", "c.metric", "c.cell")
        .agg(F.count("*").alias("n"))
    )


def quantiles(sketch: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    """The sketches merged per group of ``keys``, their quantiles read off, and their number of documents."""
    merged = sketch.groupBy(*keys, "metric", "cell").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*keys, "metric")
    ranked = merged.withColumn("upto", F.sum("n").over(w.orderBy("cell"))).withColumn("all", F.sum("n").over(w))
    read = [F.min(F.when(F.col("upto") * 100 >= F.col("all") * q, F.col("cell"))).alias(prefix + name) for name, q in QUANTILES.items()]
    return ranked.groupBy(*keys, "metric").agg(*read, F.max("all").alias(prefix + "docs"))


def fences(sketch: DataFrame) -> DataFrame:
    """``lang, source, metric, low, high``: the fences of every group, as grid cells."""
    found = quantiles(sketch, ["lang", "source"], "g_").join(quantiles(sketch, ["lang"], "l_"), ["lang", "metric"]).join(quantiles(sketch, [], "a_"), ["metric"])

    def drawn(own: str, docs: str, coarser: Column) -> Column:
        return F.floor((F.col(own) * F.col(docs) + coarser * PRIOR) / (F.col(docs) + PRIOR)).cast("long")

    q = {name: drawn(f"g_{name}", "g_docs", drawn(f"l_{name}", "l_docs", F.col(f"a_{name}"))) for name in QUANTILES}
    tails, below = ([m for m, how in METRICS.items() if how[k]] for k in (3, 4))
    tail = F.col("metric").isin(tails)
    high = F.when(tail, q["q99"] + WIDTH * (q["q99"] - q["q90"])).otherwise(q["q75"] + WIDTH * (q["q75"] - q["q25"]))
    low = F.when(F.col("metric").isin(below), q["q25"] - WIDTH * (q["q75"] - q["q25"]))
    return found.select("lang", "source", "metric", low.alias("low"), high.alias("high"))


def judge(stats: DataFrame, sketch: DataFrame) -> DataFrame:
    """``stats`` with ``kept``. The fences, one row per group, are broadcast if they are few; else they join by key."""
    each = fences(materialize(sketch))
    groups = each.groupBy(F.col("lang").alias("_lang"), F.col("source").alias("_source")).agg(
        F.map_from_entries(F.collect_list(F.struct("metric", F.struct("low", "high")))).alias("_fences")
    )
    groups = materialize(groups)
    groups = F.broadcast(groups) if groups.count() <= MAX_BROADCAST_GROUPS else groups
    s = F.col("stats")
    within = F.lit(True)
    for m, (c, d, scale, _, below) in METRICS.items():
        fence = F.element_at(F.col("_fences"), F.lit(m))
        most = (fence["high"] + 1) * F.greatest(s[d], F.lit(1)) / F.lit(float(scale))  # the upper edge of the cell
        within = within & (s[c] <= most + 3 * F.sqrt(most) + 3)
        if below:
            least = F.greatest(fence["low"], F.lit(0)) * s[d] / F.lit(float(scale))
            within = within & (s[c] >= least - 3 * F.sqrt(least) - 3)
    joined = stats.join(groups, (s["lang"] == F.col("_lang")) & (s["source"] == F.col("_source")), "left")
    return joined.withColumn("kept", F.when(s["base_failed"], F.lit(False)).otherwise(F.coalesce(within, F.lit(False)))).drop("_lang", "_source", "_fences")


_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _quantile_sql(name: str, keys: list[str]) -> str:
    by = "".join(f"{k}, " for k in keys)
    part = f"PARTITION BY {by}metric"
    read = ", ".join(f"min(cell) FILTER (WHERE upto * 100 >= total * {q}) AS {name}" for name, q in QUANTILES.items())
    return f"""{name} AS (
  SELECT {by}metric, {read}, max(total) AS docs FROM (
    SELECT {by}metric, cell, sum(n) OVER ({part} ORDER BY cell)::BIGINT AS upto, sum(n) OVER ({part})::BIGINT AS total
    FROM (SELECT {by}metric, cell, count(*) AS n FROM cells GROUP BY ALL)) GROUP BY {by}metric)"""


def oracle() -> str:
    """The same rows as SQL for DuckDB; ids are taken to be unique."""
    counts = ", ".join(f"{{'metric': '{m}', 'c': {c}, 'd': {'greatest(n_lines, 1)' if d == 'n_lines' else d}, 'scale': {scale}}}" for m, (c, d, scale, _, _) in METRICS.items())
    drawn = ", ".join(
        f"(g.{q} * g.docs + ((l.{q} * l.docs + a.{q} * {PRIOR}) // (l.docs + {PRIOR})) * {PRIOR}) // (g.docs + {PRIOR}) AS {q}" for q in QUANTILES
    )
    tails, below = (", ".join(f"'{m}'" for m, how in METRICS.items() if how[k]) for k in (3, 4))
    return f"""
WITH given AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents),
parts AS (
  SELECT *, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(t, chr(10)), lambda x: trim(x, {_WS}) <> '') AS l FROM given
),
grams AS (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM parts WHERE len(w) > 2)),
again AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS k FROM grams),
covered AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM again, generate_series(0, 2) AS s(j) WHERE k > 1 GROUP BY doc_id),
counts AS (
  SELECT p.doc_id, lang, source, len(w)::BIGINT AS n_words, length(translate(t, {_WS}, ''))::BIGINT AS word_chars,
         (length(t) - length(translate(t, '{SYMBOLS}', '')))::BIGINT AS n_symbols, (length(t) - length(translate(t, '{UPPER}', '')))::BIGINT AS n_upper,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, len(l)::BIGINT AS n_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM parts p LEFT JOIN covered c USING (doc_id)
),
judged AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM counts),
each AS (SELECT doc_id, lang, source, x.metric AS metric, x.c AS c, greatest(x.d, 1) AS d, x.scale AS scale FROM (SELECT doc_id, lang, source, unnest([{counts}]) AS x FROM judged WHERE NOT base_failed)),
cells AS (SELECT lang, source, metric, c * scale // d AS cell FROM each),
{_quantile_sql("by_source", ["lang", "source"])},
{_quantile_sql("by_lang", ["lang"])},
{_quantile_sql("overall", [])},
drawn AS (SELECT g.lang, g.source, g.metric, {drawn} FROM by_source g JOIN by_lang l USING (lang, metric) JOIN overall a USING (metric)),
fences AS (
  SELECT lang, source, metric, CASE WHEN metric IN ({tails}) THEN q99 + {WIDTH} * (q99 - q90) ELSE q75 + {WIDTH} * (q75 - q25) END AS high,
         CASE WHEN metric IN ({below}) THEN greatest(q25 - {WIDTH} * (q75 - q25), 0) END AS low FROM drawn
),
bounds AS (SELECT doc_id, c, (high + 1) * d / scale::DOUBLE AS most, low * d / scale::DOUBLE AS least FROM each JOIN fences USING (lang, source, metric)),
outside AS (SELECT DISTINCT doc_id FROM bounds WHERE c > most + 3 * sqrt(most) + 3 OR c < least - 3 * sqrt(least) - 3)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND o.doc_id IS NULL AS kept
FROM judged LEFT JOIN outside o USING (doc_id)
"""
