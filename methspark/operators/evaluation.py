"""Labels from truth tables, and classification metrics of scored samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TRUTH_DEPTH = 10


def truth_labels(sites: DataFrame, depth: int = TRUTH_DEPTH) -> DataFrame:
    """``label`` 0 of sites never methylated, 1 of those always, at sufficient depth; the rest go."""
    kept = sites.filter((F.col("pcov") + F.col("ncov") >= depth) & ((F.col("pcov") == 0) | (F.col("ncov") == 0)))
    return kept.withColumn("label", F.when(F.col("pcov") == 0, 0).otherwise(1))


def labelled(obs: DataFrame, labels: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Observations at labelled sites; unknown sites drop out."""
    return obs.join(labels.select(*keys, "label"), list(keys))


def _share(part: Column, whole: Column) -> Column:
    """0 on an empty whole."""
    return F.when(whole == 0, 0.0).otherwise(F.try_divide(part, whole))


def confusion(samples: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Counts and accuracy, precision, recall, F1 and specificity (0 unless both labels or predictions are seen) by group."""
    cell = lambda label, predict: F.count_if((F.col("label") == label) & (F.col("predict") == predict))
    counts = samples.groupBy(*keys).agg(cell(1, 1).alias("tp"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(0, 0).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    classes = (tp + fn + fp > 0) & (tn + fp + fn > 0)
    return counts.select(
        *keys, "tp", "fp", "fn", "tn", n.alias("n_samples"),
        _share(tp + tn, n).alias("accuracy"), _share(tp, tp + fp).alias("precision"), _share(tp, tp + fn).alias("recall"),
        _share(2 * tp, 2 * tp + fp + fn).alias("f1"), F.when(classes, _share(tn, tn + fp)).otherwise(0.0).alias("specificity"),
    )


def ranking(samples: DataFrame, keys: tuple[str, ...] = (), prob: str = "scaled_prob") -> DataFrame:
    """``auc, average_precision`` by group, exactly: scores are quantised, so counts by score (at most 256 a group) suffice.

    Null if a group has one label only.
    """
    by = samples.groupBy(*keys, prob).agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("q"))
    down = Window.partitionBy(*keys).orderBy(F.desc(prob)).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    run = by.select(*keys, "p", "q", F.sum("p").over(down).alias("tp"), F.sum("q").over(down).alias("fp"), F.sum("p").over(whole).alias("np"), F.sum("q").over(whole).alias("nq"))
    trapezoid = F.col("q") * (2 * F.col("tp") - F.col("p")) / F.lit(2.0)
    step = F.col("p") * F.try_divide(F.col("tp"), F.col("tp") + F.col("fp"))
    total = run.groupBy(*keys, "np", "nq").agg(F.sum(trapezoid).alias("area"), F.sum(step).alias("steps"))
    both = (F.col("np") > 0) & (F.col("nq") > 0)
    return total.select(*keys, F.when(both, F.try_divide(F.col("area"), F.col("np") * F.col("nq"))).alias("auc"), F.when(both, F.try_divide(F.col("steps"), F.col("np"))).alias("average_precision"))


def across_replicates(metrics: DataFrame, columns: tuple[str, ...], keys: tuple[str, ...] = ()) -> DataFrame:
    """Mean and population variance over replicates of metrics rounded to four decimals."""
    rounded = [F.round(c, 4) for c in columns]
    return metrics.groupBy(*keys).agg(*[f(r).alias(f"{c}_{name}") for c, r in zip(columns, rounded, strict=True) for name, f in (("mean", F.avg), ("var", F.var_pop))])
