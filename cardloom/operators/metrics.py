"""Quality measures of labelled rows."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def classification_report(rows: DataFrame, truth: str, pred: str) -> DataFrame:
    """kind, precision, recall, f1, support of every class and of accuracy, macro avg and weighted avg.

    Null truths and predictions are a class '-'; a share of nothing is 0. One pass over the rows gives the counts of
    pairs, and all else is computed from these.
    """
    pairs = rows.groupBy(F.coalesce(F.col(truth), F.lit("-")).alias("t"), F.coalesce(F.col(pred), F.lit("-")).alias("p")).agg(F.count("*").alias("n"))
    cells = pairs.select(F.explode(F.array(F.struct(F.col("t").alias("kind"), F.col("n").alias("support"), F.lit(0).cast("long").alias("named"), F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("hit")), F.struct(F.col("p").alias("kind"), F.lit(0).cast("long").alias("support"), F.col("n").alias("named"), F.lit(0).cast("long").alias("hit")))).alias("x")).select("x.*")
    per = cells.groupBy("kind").agg(F.sum("support").alias("support"), F.sum("named").alias("named"), F.sum("hit").alias("hit"))
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    per = per.withColumn("precision", share(F.col("hit"), F.col("named"))).withColumn("recall", share(F.col("hit"), F.col("support")))
    per = per.withColumn("f1", share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    r = lambda c: F.round(c, 6)
    classes = per.select("kind", r("precision").alias("precision"), r("recall").alias("recall"), r("f1").alias("f1"), "support")
    total = F.sum("support")
    accuracy = r(F.sum("hit") / total)
    summary = [per.agg(F.lit("accuracy").alias("kind"), accuracy.alias("precision"), accuracy.alias("recall"), accuracy.alias("f1"), total.alias("support"))]
    summary.append(per.agg(F.lit("macro avg").alias("kind"), *[r(F.avg(c)).alias(c) for c in ("precision", "recall", "f1")], total.alias("support")))
    summary.append(per.agg(F.lit("weighted avg").alias("kind"), *[r(F.sum(F.col(c) * F.col("support")) / total).alias(c) for c in ("precision", "recall", "f1")], total.alias("support")))
    return reduce(DataFrame.unionByName, [x.where("support > 0") for x in summary], classes)


def masked_accuracy(rows: DataFrame, truth: Column, pred: Column, batch: Column) -> DataFrame:
    """accuracy, the mean of the batches' shares of right rows, and n; rows with truth -100 don't count."""
    kept = rows.select(batch.alias("b"), (truth == pred).cast("double").alias("ok"), truth.alias("t")).where("t != -100")
    per = kept.groupBy("b").agg(F.avg("ok").alias("share"), F.count("*").alias("n"))
    return per.agg(F.round(F.avg("share"), 6).alias("accuracy"), F.sum("n").alias("n"))


def length_histogram(rows: DataFrame, length: Column, width: int = 50, top: int = 800, above: int = 230) -> DataFrame:
    """bin, n, n_above of lengths from 0 to top by width, the last bin closed; others are left out. n_above: how many of
    the bin are above a limit."""
    kept = rows.select(length.cast("long").alias("x")).where((F.col("x") >= 0) & (F.col("x") <= top))
    b = F.least(F.floor(F.col("x") / width), F.lit(top // width - 1)).cast("int")
    return kept.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.count_if(F.col("x") > above).alias("n_above"))


def length_density(rows: DataFrame, length: Column, at: tuple[int, ...] = tuple(range(0, 801, 50))) -> DataFrame:
    """x, density: a Gaussian kernel density of the lengths at the given places, with the bandwidth s * n ** (-1 / 5).

    Lengths are counted by value first, so what meets the places is a row a value, not a row a text.
    """
    counts = rows.select(length.cast("long").alias("v")).where("v is not null").groupBy("v").agg(F.count("*").alias("n"))
    mean = F.sum(F.col("v") * F.col("n")) / F.sum("n")
    square = F.sum(F.col("v") * F.col("v") * F.col("n"))
    stats = counts.agg(F.sum("n").alias("total"), F.sqrt((square - mean * mean * F.sum("n")) / (F.sum("n") - 1)).alias("s"))  # one row
    width = stats.select("total", (F.col("s") * F.pow("total", F.lit(-0.2))).alias("h"))
    each = counts.join(F.broadcast(width)).withColumn("x", F.explode(F.array(*map(F.lit, at))))
    z = (F.col("x") - F.col("v")) / F.col("h")
    kernel = F.col("n") * F.exp(-z * z / 2) / (F.col("total") * F.col("h") * F.sqrt(F.lit(2 * math.pi)))
    return each.groupBy("x").agg(F.round(F.sum(kernel), 9).alias("density"))


def softmax_confidence(values: Column) -> Column:
    """The largest share of a softmax."""
    top = F.array_max(values)
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + F.exp((x - top).cast("double")))
    return 1.0 / total


def argmax(values: Column) -> Column:
    """0-based place of the first largest value."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")
