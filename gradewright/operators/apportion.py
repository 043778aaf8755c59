"""Seats by largest remainder, and weighted sampling without replacement, as one window each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradewright import config as C
from gradewright.functions.learning import hashed_uniform


def largest_remainder(df: DataFrame, group: list[str], weight: str, total: int, tie: str, name: str = "seats") -> DataFrame:
    """df with whole seats that sum to ``total`` in every group (Hamilton's method).

    Weights of zero or below, or null, share nothing unless all of the group do: then shares are equal. Equal remainders go by ``tie``.
    """
    w = F.greatest(F.lit(0.0), F.coalesce(F.col(weight).cast("double"), F.lit(0.0)))
    own = Window.partitionBy(*group)
    share = F.when(F.col("_s") > 0, F.col("_w") / F.col("_s") * total).otherwise(F.lit(float(total)) / F.count("*").over(own))
    base = df.withColumn("_w", w).withColumn("_s", F.sum("_w").over(own)).withColumn("_q", share).withColumn("_f", F.floor("_q"))
    rest = total - F.sum("_f").over(own)
    place = F.row_number().over(own.orderBy(F.desc(F.round(F.col("_q") - F.col("_f"), 9)), tie))
    return base.withColumn(name, (F.col("_f") + F.when(place <= rest, 1).otherwise(0)).cast("long")).drop("_w", "_s", "_q", "_f")


def softmax_sample(df: DataFrame, group: list[str], score: str, k: int, parts: list[Column], temperature: float = C.SOFTMAX_T) -> DataFrame:
    """k rows a group, drawn without replacement with softmax probabilities of the score.

    Adding Gumbel noise to score / temperature and taking the k largest is the same draw, without a loop. The noise
    hangs on ``parts`` alone, so a draw can be repeated. Groups of fewer rows are taken whole.
    """
    noisy = F.col(score) / temperature - F.log(-F.log(hashed_uniform(*parts)))
    place = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("_g"), *parts))
    return df.withColumn("_g", noisy).withColumn("slot", place.cast("long")).filter(F.col("slot") <= k).drop("_g")
