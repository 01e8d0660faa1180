"""One ranking from several lists whose scores can't be compared: ideal-point ranking.

Scores are winsorised and vector-normalised within their list; an item's weighted distances to the ideal point (the best value of every list) and to the
anti-ideal point (the worst) give its relative closeness, anti / (ideal + anti). By default every list weighs the same: its weight is the inverse of the
distance between its own best and worst normalised value, so that no list moves an item further than another one. Other weights multiply that one. An item
that a list lacks stands at that list's worst value.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.joins import lookup
from tessera.session import written

#: Winsorising: scores below / above these quantiles of their list are set to them.
LOW, HIGH = 0.05, 0.9


def fuse(items: DataFrame, lower_is_better: tuple[str, ...] = ("distance",), low: float = LOW, high: float = HIGH, weights: Mapping[str, float] | None = None) -> DataFrame:
    """query_id, item_id, closeness (0 to 1), unclipped (mean place between worst and best before the upper clip, to part equal closeness).

    Rows with a null key, or a null or NaN score, count as absent; an item twice in a list counts with its better score. In a list whose scores are all
    equal every listed item is at the best value. Queries without any score have no rows. ``weights`` by list name; 1 where none is given.
    """
    ok = items.where(F.col("query_id").isNotNull() & F.col("list_name").isNotNull() & F.col("item_id").isNotNull() & F.col("score").isNotNull() & ~F.isnan("score"))
    score = F.when(F.col("list_name").isin(*lower_is_better), -F.col("score")).otherwise(F.col("score")).cast("double")
    best = written(ok.groupBy("query_id", "list_name", "item_id").agg(F.max(score).alias("s")), "best")  # read for the cuts, the norms and the places
    cuts = F.percentile_approx("s", F.array(F.lit(low), F.lit(high)), F.lit(10_000))
    lists = best.groupBy("query_id", "list_name").agg(cuts.alias("q"), F.max("s").alias("top"))
    lists = lists.select("query_id", "list_name", F.col("q")[0].alias("worst"), F.col("q")[1].alias("ideal"), "top")
    given = F.element_at(F.create_map(*(F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1])))), F.col("list_name")) if weights else F.lit(None).cast("double")
    lists = written(lists.withColumn("given", F.coalesce(given, F.lit(1.0))), "lists")
    all_ = lists.groupBy("query_id").agg(F.sum(F.col("given") * F.col("given")).alias("all_squares"), F.sum("given").alias("all_given"))
    known = lookup(best, lists.join(all_, "query_id"), ["query_id", "list_name"])
    clipped = F.least(F.greatest("s", "worst"), "ideal")
    norms = known.groupBy("query_id", "list_name").agg(F.sqrt(F.sum(clipped * clipped)).alias("norm"))
    known = lookup(known, norms, ["query_id", "list_name"])
    # normalised value, best and worst of the list, and the weight that makes their distance the given one
    x, hi, lo = clipped / F.col("norm"), F.col("ideal") / F.col("norm"), F.col("worst") / F.col("norm")
    spread = F.col("ideal") > F.col("worst")
    weight = F.col("given") / (hi - lo)
    known = known.withColumn("to_best", F.when(spread, weight * (hi - x)).otherwise(F.lit(0.0))).withColumn("to_worst", F.when(spread, weight * (x - lo)).otherwise(F.col("given")))
    place = F.when(F.col("top") > F.col("worst"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("s") - F.col("worst")) / (F.col("top") - F.col("worst"))))).otherwise(F.lit(1.0))
    square = lambda c: F.sum(F.col(c) * F.col(c))
    sums = known.groupBy("query_id", "item_id").agg(
        square("to_best").alias("to_ideal"), square("to_worst").alias("to_anti"), square("given").alias("squares"), F.sum(place * F.col("given")).alias("u"), F.max("all_squares").alias("all_squares"), F.max("all_given").alias("all_given")
    )
    # of the lists that lack the item the whole weight lies between it and the ideal point
    ideal, anti = F.sqrt(F.col("to_ideal") + F.col("all_squares") - F.col("squares")), F.sqrt("to_anti")
    return sums.select("query_id", "item_id", F.round(F.when(ideal + anti > 0, anti / (ideal + anti)).otherwise(F.lit(1.0)), 12).alias("closeness"), F.round(F.col("u") / F.col("all_given"), 12).alias("unclipped"))


def top(fused: DataFrame, k: int) -> DataFrame:
    """The first k items of each query with their rank; equal ones by item_id. The limit is applied before the shuffle too."""
    by = Window.partitionBy("query_id").orderBy(F.desc("closeness"), F.desc("unclipped"), "item_id")
    return fused.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
