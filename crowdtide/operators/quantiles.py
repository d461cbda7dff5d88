"""Exact quantiles that hold for groups of any size.

A built-in exact percentile keeps all distinct values of a group in one task.  Here
values first fall into monotone bins that do not depend on the data; bin counts
combine before the shuffle and are few per group.  The counts tell which bins hold
the wanted ranks, and only rows of those bins are then shuffled and ordered.  Equal
values are counted rather than listed, so a value shared by a third of the rows is
one row.  A wanted bin that still holds more rows than a task should order is divided
again, evenly between its smallest and largest value, and so on; so values that hardly
differ are no worse than others.  The values are written once, and each division reads
only the rows of the bins it divides.  The list of wanted bins is written as well; the
planner then knows its size and broadcasts it if it is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crowdtide.session import cut_lineage

_FINEST = 1e-4      # below this size values share the two innermost bins
_PER_E_FOLD = 400   # bins per factor e of size
BIN_ROWS = 250_000  # rows of a wanted bin that one task may order
FAN = 1024          # parts of a bin that holds more


def _bin(value: Column) -> Column:
    steps = F.floor(F.log1p(F.abs(value) / _FINEST) * _PER_E_FOLD).cast("int")
    return F.when(value < 0, -steps - 1).otherwise(steps)


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def _same_bin(keys: list[str]) -> Column:
    same = F.col("_bin") == F.col("_k_bin")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))  # keeps groups whose key is NULL
    return same


def _over_bins(keys: list[str]):
    return Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))


def _bin_keys(keys: list[str]) -> list[Column]:
    return [*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_bin").alias("_k_bin")]


def _range() -> list[Column]:
    return [F.count("*").alias("_bin_n"), F.min("_x").alias("_low"), F.max("_x").alias("_high")]


def _too_large(chosen: DataFrame, limit: int) -> bool:
    return not chosen.filter((F.col("_bin_n") > limit) & (F.col("_low") < F.col("_high"))).isEmpty()


def _divided(rows: DataFrame, keys: list[str], chosen: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of the chosen bins; ``_bin`` is now the part within the bin, in value order over all chosen bins."""
    share = F.when(F.col("_low") < F.col("_high"), (F.col("_x") - F.col("_low")) / (F.col("_high") - F.col("_low"))).otherwise(0.0)
    part = F.least(F.lit(FAN - 1), F.floor(share * FAN)).cast("long")
    inside = rows.join(chosen, _same_bin(keys)).withColumn("_bin", F.col("_ordinal") * FAN + part)
    return cut_lineage(inside.select(*keys, "_x", *columns, "_bin"))


def _chosen(bins: DataFrame, keys: list[str], wanted: Column, marks: list[Column]) -> DataFrame:
    """The wanted bins of each group, numbered in order; a few per group, written."""
    ordinal = F.row_number().over(_over_bins(keys).orderBy("_bin")).cast("long")
    return cut_lineage(bins.filter(wanted).withColumn("_ordinal", ordinal).select(*_bin_keys(keys), "_ordinal", *marks, "_bin_n", "_low", "_high"))


def _with_parent(parts: DataFrame, keys: list[str], chosen: DataFrame, marks: list[str]) -> DataFrame:
    """Parts with ``_parent``, the number of the bin they were cut from, and its marks as ``_p...``."""
    above = chosen.select(*[F.col(f"_k_{k}") for k in keys], "_ordinal", *[F.col(m).alias(f"_p{m}") for m in marks])
    same = F.col("_parent") == F.col("_ordinal")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return parts.withColumn("_parent", F.floor(F.col("_bin") / FAN)).join(above, same).drop("_ordinal")


def quantiles(df: DataFrame, keys: list[str], value: str, probabilities: dict[str, float], bin_rows: int = BIN_ROWS) -> DataFrame:
    """Linear-interpolated quantiles, one column per probability, plus ``n``.

    NULL and non-finite values are left out.
    """
    usable = df.select(*keys, F.col(value).cast("double").alias("_x")).filter(_finite(F.col("_x"))).withColumn("_bin", _bin(F.col("_x")).cast("long"))
    usable = cut_lineage(usable)
    whole = _over_bins(keys)
    upto = whole.orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    rank = lambda q: (F.col("_total") - 1) * F.lit(float(q))
    wanted = F.lit(False)
    for q in probabilities.values():
        for r in (F.floor(rank(q)), F.ceil(rank(q))):
            wanted = wanted | ((r < F.col("_end")) & (r >= F.col("_end") - F.col("_bin_n")))
    bins = usable.groupBy(*keys, "_bin").agg(*_range())
    placed = bins.withColumn("_end", F.sum("_bin_n").over(upto)).withColumn("_total", F.sum("_bin_n").over(whole))
    marks = [(F.col("_end") - F.col("_bin_n")).alias("_start"), F.col("_total")]
    chosen = _chosen(placed, keys, wanted, marks)
    while _too_large(chosen, bin_rows):
        usable = _divided(usable, keys, chosen, [])
        parts = _with_parent(usable.groupBy(*keys, "_bin").agg(*_range()), keys, chosen, ["_start", "_total"])
        within = Window.partitionBy(*keys, "_parent").orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
        placed = parts.withColumn("_end", F.col("_p_start") + F.sum("_bin_n").over(within)).withColumnRenamed("_p_total", "_total")
        chosen = _chosen(placed, keys, wanted, marks)
    inside = Window.partitionBy(*keys, "_bin").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    tallied = usable.join(chosen.drop("_ordinal", "_bin_n", "_low", "_high"), _same_bin(keys)).groupBy(*keys, "_bin", "_x", "_start", "_total").agg(F.count("*").alias("_n"))
    ranked = tallied.withColumn("_upto", F.col("_start") + F.sum("_n").over(inside))
    at = lambda r: F.max(F.when((r < F.col("_upto")) & (r >= F.col("_upto") - F.col("_n")), F.col("_x")))
    columns = [F.max("_total").alias("n")]
    for name, q in probabilities.items():
        low, high = F.floor(rank(q)), F.ceil(rank(q))
        columns += [at(low).alias(f"_lo_{name}"), at(high).alias(f"_hi_{name}"), F.max(rank(q) - low).alias(f"_f_{name}")]
    picked = ranked.groupBy(*keys).agg(*columns)
    between = lambda p: F.col(f"_lo_{p}") + (F.col(f"_hi_{p}") - F.col(f"_lo_{p}")) * F.col(f"_f_{p}")
    return picked.select(*keys, *[between(p).alias(p) for p in probabilities], "n")


def weighted_quantiles(
    df: DataFrame, keys: list[str], value: str, weight: str, probabilities: dict[str, float], bin_rows: int = BIN_ROWS
) -> DataFrame:
    """Quantiles interpolated on cumulative weight, plus ``n`` and ``total_weight``.

    The cutoff is q times the total weight; the answer lies between the last value
    below it and the first value whose cumulative weight reaches it.  Ties are taken
    in order of weight, which fixes an order the definition leaves open.
    """
    usable = df.select(
        *keys, F.col(value).cast("double").alias("_x"), F.col(weight).cast("double").alias("_w")
    ).filter(_finite(F.col("_x")) & _finite(F.col("_w")) & (F.col("_w") > 0)).withColumn("_bin", _bin(F.col("_x")).cast("long"))
    usable = cut_lineage(usable)
    whole = _over_bins(keys)
    in_order = whole.orderBy("_bin")
    mass = [F.sum("_w").alias("_mass"), *_range()]
    bins = (
        usable.groupBy(*keys, "_bin").agg(*mass)
        .withColumn("_end", F.sum("_mass").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_total", F.sum("_mass").over(whole))
        .withColumn("_count", F.sum("_bin_n").over(whole))
        .withColumn("_start", F.coalesce(F.lag("_end").over(in_order), F.lit(0.0)))
        .withColumn("_before", F.lag("_high").over(in_order))
        .withColumn("_is_last", F.lead("_bin").over(in_order).isNull())
    )
    cut = lambda q: F.col("_total") * F.lit(float(q))
    reach = lambda q: ((F.col("_end") >= cut(q)) & ((F.col("_start") < cut(q)) | F.col("_before").isNull())) | (
        F.col("_is_last") & (F.col("_end") < cut(q))
    )
    wanted = F.lit(False)
    for q in probabilities.values():
        wanted = wanted | reach(q)
    marks = ["_start", "_end", "_before", "_total", "_count", "_is_last"]
    chosen = _chosen(bins, keys, wanted, marks)
    while _too_large(chosen, bin_rows):
        usable = _divided(usable, keys, chosen, ["_w"])
        parts = _with_parent(usable.groupBy(*keys, "_bin").agg(*mass), keys, chosen, marks)
        within = Window.partitionBy(*keys, "_parent").orderBy("_bin")
        last = F.lead("_bin").over(within).isNull()
        # the last part ends where the whole bin did, whatever the order in which weights were added
        placed = (
            parts.withColumn("_sum", F.col("_p_start") + F.sum("_mass").over(within.rowsBetween(Window.unboundedPreceding, 0)))
            .withColumn("_end", F.when(last, F.col("_p_end")).otherwise(F.least("_sum", "_p_end")))
            .withColumn("_start", F.coalesce(F.lag("_end").over(within), F.col("_p_start")))
            .withColumn("_before", F.coalesce(F.lag("_high").over(within), F.col("_p_before")))
            .withColumn("_is_last", last & F.col("_p_is_last"))
        )
        chosen = _chosen(placed.withColumnsRenamed({"_p_total": "_total", "_p_count": "_count"}), keys, wanted, marks)
    inside = Window.partitionBy(*keys, "_bin").orderBy("_x", "_w")
    blocks = (
        usable.join(chosen.drop("_ordinal", "_bin_n", "_low", "_high"), _same_bin(keys)).groupBy(*keys, "_bin", "_x", "_w", *marks).agg(F.count("*").alias("_n"))
        .withColumn("_c1", F.col("_start") + F.sum(F.col("_w") * F.col("_n")).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_c0", F.col("_c1") - F.col("_w") * F.col("_n"))
        .withColumn("_prev", F.coalesce(F.lag("_x").over(inside), F.col("_before")))
    )
    columns = [F.max("_count").alias("n"), F.max("_total").alias("total_weight")]
    for name, q in probabilities.items():
        # Only the first of the equal values borders on the value before.
        share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (cut(q) - F.col("_c0")) / F.col("_w")))
        here = F.when(F.col("_prev").isNull(), F.col("_x")).otherwise(F.col("_prev") * (1 - share) + F.col("_x") * share)
        columns.append(F.min_by(here, F.when(reach(q) & (F.col("_c1") >= cut(q)), F.struct("_x", "_w"))).alias(name))
        columns.append(F.max(F.when(reach(q), F.col("_x"))).alias(f"_max_{name}"))
    picked = blocks.groupBy(*keys).agg(*columns)
    return picked.select(*keys, *[F.coalesce(F.col(p), F.col(f"_max_{p}")).alias(p) for p in probabilities], "n", "total_weight")


def weighted_mean(value: Column, weight: Column) -> Column:
    """Weighted mean over finite values with positive finite weight; 0 without any."""
    v = F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value.cast("double"))
    w = F.when(~F.isnan(weight) & (weight > 0) & (weight < float("inf")), weight.cast("double"))
    both = v.isNotNull() & w.isNotNull()
    return F.coalesce(F.try_divide(F.sum(F.when(both, v * w)), F.sum(F.when(both, w))), F.lit(0.0))
