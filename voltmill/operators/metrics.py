"""Evaluation metrics as aggregates; a metric without its evidence is null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .relational import numbered


def per_label(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """precision, recall and F1 of each label that was seen or predicted, from one count per pair of labels."""
    pairs = df.groupBy(F.col(actual).alias("y"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    sides = F.array(F.struct(F.col("y").alias("label"), F.lit(1).alias("is_actual")), F.struct(F.col("p").alias("label"), F.lit(0).alias("is_actual")))
    x = pairs.select("y", "p", "n", F.inline(sides))
    hit = F.col("y") == F.col("p")
    tp = F.sum(F.when(hit & (F.col("is_actual") == 1), F.col("n")).otherwise(0))
    fp = F.sum(F.when(~hit & (F.col("is_actual") == 0), F.col("n")).otherwise(0))
    fn = F.sum(F.when(~hit & (F.col("is_actual") == 1), F.col("n")).otherwise(0))
    zero = lambda num, den: F.round(F.coalesce(num / F.nullif(den, F.lit(0)), F.lit(0.0)), 9)
    return x.groupBy("label").agg(zero(tp, tp + fp).alias("precision"), zero(tp, tp + fn).alias("recall"), zero(2 * tp, 2 * tp + fp + fn).alias("f1"))


def classification(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """accuracy and macro F1 in one row."""
    acc = df.agg(F.avg((F.col(actual) == F.col(predicted)).cast("double")).alias("accuracy"))
    return acc.crossJoin(per_label(df, actual, predicted).agg(F.avg("f1").alias("macro_f1")))


def regression(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """mae, rmse, median_ae and mape (null if any actual is zero) in one row."""
    y, e = F.col(actual), F.abs(F.col(actual) - F.col(predicted))
    mape = F.when(~F.bool_or(y == 0), F.avg(F.try_divide(e, F.abs(y))) * 100)
    return df.agg(F.avg(e).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.median(e).alias("median_ae"), mape.alias("mape"))


def mase(series: DataFrame, order: str, value: str, season: int, training: Column) -> DataFrame:
    """Error of the seasonal-naive forecast after the training rows over that within them; null without a scale."""
    x = numbered(series.select(order, value, training.alias("__train")), [F.col(order)], "__i")
    past = x.select((F.col("__i") + season).alias("__i"), F.col(value).alias("__naive"))
    e = x.join(past, "__i", "left").withColumn("e", F.abs(F.col(value) - F.col("__naive")))
    return e.agg((F.avg(F.when(~F.col("__train"), F.col("e"))) / F.nullif(F.avg(F.when(F.col("__train"), F.col("e"))), F.lit(0.0))).alias("mase"))


def against_baseline(model: Column, baseline: Column, higher_is_better: bool = False) -> Column:
    """beats, does not beat, or undetermined where a metric is missing."""
    d = model - baseline
    wins = d > 0 if higher_is_better else d < 0
    return F.when(d.isNull(), "undetermined").when(wins, "beats").otherwise("does not beat")
