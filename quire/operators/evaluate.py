"""Evaluation: confusion, precision and recall, calibration grids, percentile roll-ups, partitions against partitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.operators import sequence


def confusion_matrix(rows: DataFrame, actual: Column, predicted: Column, labels: Sequence[str]) -> DataFrame:
    """``actual, predicted, n`` over the complete grid of ``labels``; other values are left out."""
    held = F.array(*[F.lit(x) for x in labels])
    spark = rows.sparkSession
    grid = spark.range(1).select(F.explode(held).alias("actual")).select("actual", F.explode(held).alias("predicted"))
    counts = rows.groupBy(actual.alias("a"), predicted.alias("p")).agg(F.count("*").alias("c"))
    return grid.join(counts, (F.col("actual") == F.col("a")) & (F.col("predicted") == F.col("p")), "left").select("actual", "predicted", F.coalesce("c", F.lit(0)).alias("n"))


def binary_counts(actual: Column, predicted: Column) -> list[Column]:
    """Aggregates tp, fp, fn."""
    return [F.count_if(actual & predicted).alias("tp"), F.count_if(~actual & predicted).alias("fp"), F.count_if(actual & ~predicted).alias("fn")]


def with_metrics(counts: DataFrame) -> DataFrame:
    """precision, recall and iou beside tp, fp, fn; null where the denominator is 0."""
    tp = F.col("tp").cast("double")
    parts = {"precision": F.col("tp") + F.col("fp"), "recall": F.col("tp") + F.col("fn"), "iou": F.col("tp") + F.col("fp") + F.col("fn")}
    return counts.withColumns({n: F.round(F.try_divide(tp, whole.cast("double")), 6) for n, whole in parts.items()})


def calibrate(examples: DataFrame, score: str, positive: str, thresholds: Sequence[float]) -> DataFrame:
    """``threshold, tp, fp, fn`` and metrics of every threshold, in one pass over the examples.

    Scores are counted by the number of thresholds they reach, so the examples are never multiplied by the grid.
    """
    grid = sorted(set(thresholds))
    reached = sum((F.col(score) >= t).cast("int") for t in grid)
    per = examples.where(F.col(score).isNotNull()).groupBy(reached.alias("reached")).agg(F.count_if(F.col(positive)).alias("pos"), F.count_if(~F.col(positive)).alias("neg"))
    hit = F.col("reached") > F.col("i")
    joined = per.select("reached", "pos", "neg", F.posexplode(F.array(*[F.lit(float(t)) for t in grid])).alias("i", "threshold"))  # at most a row more than there are thresholds, times these
    sums = joined.groupBy("threshold").agg(F.sum(F.when(hit, F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(hit, F.col("neg")).otherwise(0)).alias("fp"), F.sum(F.when(~hit, F.col("pos")).otherwise(0)).alias("fn"))
    return with_metrics(sums)


def partition_overlaps(expected: DataFrame, actual: DataFrame, item: str, group: str) -> DataFrame:
    """``expected_group, actual_group, n_shared`` of two partitions of items; items in one of them only have a null group."""
    a = expected.select(F.col(item).alias("a_item"), F.col(group).alias("expected_group")).distinct()
    b = actual.select(F.col(item).alias("b_item"), F.col(group).alias("actual_group")).distinct()
    return a.join(b, F.col("a_item") == F.col("b_item"), "full_outer").groupBy("expected_group", "actual_group").agg(F.count("*").alias("n_shared"))


def judge_groups(overlaps: DataFrame) -> DataFrame:
    """Each expected group as hit (one actual group of the same members), split, merge, split_merge or miss."""
    known = overlaps.where(F.col("expected_group").isNotNull())
    met = known.groupBy("expected_group").agg(F.sum("n_shared").alias("n_members"), F.count("actual_group").alias("n_actual"))
    merged = overlaps.where(F.col("actual_group").isNotNull()).groupBy(F.col("actual_group").alias("g")).agg(F.count("*").alias("n_sources"))
    shared = known.where(F.col("actual_group").isNotNull()).join(merged, F.col("actual_group") == F.col("g")).groupBy(F.col("expected_group").alias("e")).agg(F.max("n_sources").alias("n_sources"))
    joined = met.join(shared, F.col("expected_group") == F.col("e"), "left")
    split, merge = F.col("n_actual") > 1, F.coalesce(F.col("n_sources"), F.lit(0)) > 1
    outcome = F.when(F.col("n_actual") == 0, "miss").when(split & merge, "split_merge").when(split, "split").when(merge, "merge").otherwise("hit")
    return joined.select("expected_group", "n_members", "n_actual", outcome.alias("outcome"))


def otsu_threshold(rows: DataFrame, bin_of: Column, keys: Sequence[str] = ()) -> DataFrame:
    """The bin after which splitting a histogram of integer bins gives the largest variance between classes; ties: the lowest bin."""
    bins = rows.groupBy(*keys, bin_of.alias("bin")).agg(F.count("*").alias("n"))
    upto = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)  # a row a bin
    whole = Window.partitionBy(*keys)
    mass = F.col("bin") * F.col("n")
    sums = bins.select(*keys, "bin", F.sum("n").over(upto).alias("w0"), F.sum(mass).over(upto).alias("s0"), F.sum("n").over(whole).alias("w"), F.sum(mass).over(whole).alias("s"))
    cross = F.col("s").cast("double") * F.col("w0") - F.col("s0").cast("double") * F.col("w")
    between = F.try_divide(cross * cross, F.col("w0").cast("double") * (F.col("w") - F.col("w0")))
    best = sums.where(F.col("w0") < F.col("w")).select(*keys, "bin", between.alias("between"))
    return best.groupBy(*keys).agg(F.max_by("bin", F.struct("between", -F.col("bin"))).alias("threshold_bin"))


def value_ranks(rows: DataFrame, keys: Sequence[str], value: str, hot_values: int = sequence.HOT_ROWS) -> DataFrame:
    """``keys, value, n, upto, total``: each distinct value of a key with its rows, those up to it and all of the key.

    Equal values combine before they are shuffled, so what is ranked grows with the distinct values; keys with more than
    ``hot_values`` of them are ranked in chunks that follow each other, never in one task. Null and nan values are left out.
    """
    held = rows.where(F.col(value).isNotNull())
    if dict(held.dtypes)[value] in ("float", "double"):
        held = held.where(~F.isnan(value))
    counts = held.groupBy(*keys, F.col(value).alias("value")).agg(F.count("*").alias("n"))
    many = held.groupBy(*keys).agg(F.count("*").alias("q_n")).where(F.col("q_n") > hot_values).limit(1).count()  # few rows have few values
    one = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}) if keys else F.lit("")
    named = counts.withColumn("key_text", one)
    hot = sequence.hot_keys(named, "key_text", hot_values) if many else None
    if hot is None:
        whole = Window.partitionBy(*keys)
        upto = whole.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
        return counts.select(*keys, "value", "n", F.sum("n").over(upto).alias("upto"), F.sum("n").over(whole).alias("total"))
    ranks = sequence.running_sum(named, "key_text", ["value"], F.col("n"), "upto", hot)
    totals = named.groupBy(F.col("key_text").alias("of")).agg(F.sum("n").alias("total"))
    return ranks.join(totals, F.col("key_text") == F.col("of")).select(*keys, "value", "n", "upto", "total")


def _at_ranks(ranks: DataFrame, keys: Sequence[str], wanted: dict[str, Column]) -> DataFrame:
    """``keys`` and for each name the value at a rank that the number of rows ``total`` gives."""
    return ranks.groupBy(*keys).agg(*[F.min(F.when(F.col("upto") >= rank, F.col("value"))).alias(name) for name, rank in wanted.items()])


def exact_percentiles(rows: DataFrame, keys: Sequence[str], value: str, shares: dict[str, float], hot_values: int = sequence.HOT_ROWS) -> DataFrame:
    """``keys`` and for each name in ``shares`` the value of rank ceil(share * n), the first for share 0. Keys without a value give no row."""
    wanted = {name: F.greatest(F.lit(1), F.ceil(F.lit(share) * F.col("total"))) for name, share in shares.items()}
    return _at_ranks(value_ranks(rows, keys, value, hot_values), keys, wanted)


def exact_medians(rows: DataFrame, keys: Sequence[str], value: str, hot_values: int = sequence.HOT_ROWS) -> DataFrame:
    """``keys, median``: the middle value, of an even number of rows the mean of the two middle ones."""
    half = F.col("total") / 2
    both = _at_ranks(value_ranks(rows, keys, value, hot_values), keys, {"low": F.ceil(half), "high": F.floor(half) + 1})
    return both.select(*keys, ((F.col("low") + F.col("high")) / 2).alias("median"))
