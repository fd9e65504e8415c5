"""An n-gram scorer with stupid backoff, from counts of benign sequences per process."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spoor.operators.order import cut, lagged, small

ALPHA, BACKOFF = 1.0, 0.4
_MISSING = "None"  # a missing token is a token


@dataclass
class NgramModel:
    """Counts of one, two and three tokens; two and three carry the totals of their prefix."""

    one: DataFrame
    two: DataFrame
    three: DataFrame
    n: int
    v: int
    alpha: float = ALPHA
    backoff: float = BACKOFF

    def save(self, path: str) -> None:
        for name in ("one", "two", "three"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")
        spark = self.one.sparkSession
        row = [(self.n, self.v, self.alpha, self.backoff)]
        spark.createDataFrame(row, "n bigint, v bigint, alpha double, backoff double").write.mode("overwrite").parquet(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> NgramModel:
        m = spark.read.parquet(f"{path}/meta").head()
        return cls(*[spark.read.parquet(f"{path}/{name}") for name in ("one", "two", "three")], m["n"], m["v"], m["alpha"], m["backoff"])


def sequences(df: DataFrame, key: str = "proc_exec_id", order: tuple[str, ...] = ("event_time", "row_idx"), token: str = "token") -> DataFrame:
    """``df`` with ``w`` and the two tokens before it in its process, ``prev1`` and ``prev2``."""
    return lagged(df.withColumn("w", F.coalesce(F.col(token).cast("string"), F.lit(_MISSING))), key, list(order), "w", 2)


def fit(df: DataFrame, label: str = "is_attack", **kw) -> NgramModel:
    """Counts over benign rows; attack rows are taken out before sequences are formed."""
    seq = cut(sequences(df.where(~F.col(label)), **kw).select("w", "prev1", "prev2"))
    one = cut(seq.groupBy("w").agg(F.count("*").alias("n_w")))
    two = seq.where("prev1 is not null").groupBy("prev1", "w").agg(F.count("*").alias("n_pw"))
    three = seq.where("prev2 is not null").groupBy("prev2", "prev1", "w").agg(F.count("*").alias("n_ppw"))
    sizes = one.agg(F.coalesce(F.sum("n_w"), F.lit(0)).alias("n"), F.count("*").alias("v")).head()
    return NgramModel(one, cut(two), cut(three), sizes["n"], sizes["v"])


def probability(model: NgramModel, prev2: Column, prev1: Column, counts: dict[str, Column]) -> tuple[Column, Column]:
    """P and the level it comes from: three tokens if their prefix is known, else two, else one."""
    a, b, v = model.alpha, model.backoff, model.v
    zero = lambda c: F.coalesce(c, F.lit(0))
    three = (zero(counts["ppw"]) + a) / (counts["pp"] + a * v)
    two = b * (zero(counts["pw"]) + a) / (counts["p"] + a * v)
    factor = F.when(prev1.isNull() & prev2.isNull(), 1.0).when(prev1.isNull(), b).otherwise(b * b)
    one = factor * (zero(counts["w"]) + a) / F.lit(model.n + a * max(v, 1))
    t, d = F.coalesce(counts["pp"] > 0, F.lit(False)), F.coalesce(counts["p"] > 0, F.lit(False))
    return F.when(t, three).when(d, two).otherwise(one), F.when(t, F.lit("trigram")).when(d, F.lit("bigram")).otherwise(F.lit("unigram"))


def score(df: DataFrame, model: NgramModel, **kw) -> DataFrame:
    """``df`` with ``score`` = -log P of each event after those before it in its process, and its ``level``.

    Counts join by equality, broadcast where they are few, as a few tokens hold most events; prefix totals are sums of counts, joined as tables of their own."""
    seq = sequences(df, **kw)
    three = model.three.select(F.col("prev2").alias("_a"), F.col("prev1").alias("_b"), F.col("w").alias("_c"), "n_ppw")
    pp = model.three.groupBy(F.col("prev2").alias("_d"), F.col("prev1").alias("_e")).agg(F.sum("n_ppw").alias("n_pp"))
    two = model.two.select(F.col("prev1").alias("_f"), F.col("w").alias("_g"), "n_pw")
    p = model.two.groupBy(F.col("prev1").alias("_h")).agg(F.sum("n_pw").alias("n_p"))
    one = model.one.select(F.col("w").alias("_i"), "n_w")
    w, p1, p2 = F.col("w"), F.col("prev1"), F.col("prev2")
    joined = (
        seq.join(small(three), (p2 == F.col("_a")) & (p1 == F.col("_b")) & (w == F.col("_c")), "left")
        .join(small(pp), (p2 == F.col("_d")) & (p1 == F.col("_e")), "left")
        .join(small(two), (p1 == F.col("_f")) & (w == F.col("_g")), "left")
        .join(small(p), p1 == F.col("_h"), "left")
        .join(small(one), w == F.col("_i"), "left")
    )
    counts = {"ppw": F.col("n_ppw"), "pp": F.col("n_pp"), "pw": F.col("n_pw"), "p": F.col("n_p"), "w": F.col("n_w")}
    prob, level = probability(model, p2, p1, counts)
    out = joined.withColumns({"score": (-F.log(prob)).cast("float"), "nll": -F.log(prob), "level": level})
    return out.drop("w", "prev1", "prev2", *[f"_{x}" for x in "abcdefghi"], "n_ppw", "n_pp", "n_pw", "n_p", "n_w")


def diagnostics(scored: DataFrame) -> DataFrame:
    """``n, perplexity`` and the share of events per level."""
    share = lambda x: F.avg((F.col("level") == x).cast("double"))
    return scored.agg(
        F.count("*").alias("n"), F.exp(F.avg("nll")).alias("perplexity"), share("trigram").alias("trigram_rate"),
        share("bigram").alias("bigram_rate"), share("unigram").alias("unigram_rate"),
    )
