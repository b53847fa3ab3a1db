"""Blocks of ordered points: islands, uncovered intervals, sweeps, boundaries, breakpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def islands(points: DataFrame, keys: list[str], thd: int, order: list[str] | None = None) -> DataFrame:
    """Adds block_id: a new block begins where x or y steps back or by `thd` or more."""
    by = Window.partitionBy(*keys).orderBy(*(order or ["x", "y"]))
    dx, dy = F.col("x") - F.lag("x").over(by), F.col("y") - F.lag("y").over(by)
    goes_on = (dx >= 0) & (dx < thd) & (dy >= 0) & (dy < thd)
    new = F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)
    return points.withColumn("new", new).withColumn("block_id", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("new")


def block_table(points: DataFrame, keys: list[str], thd: int) -> DataFrame:
    """One row a block: first and last point, number of points."""
    grouped = islands(points, keys, thd).groupBy(*keys, "block_id")
    return grouped.agg(F.min("x").alias("xstart"), F.max("x").alias("xend"), F.min("y").alias("ystart"), F.max("y").alias("yend"), F.count("*").alias("n_anchors"))


def without_short(blocks: DataFrame, share: float = 0.05, window: int = 96) -> DataFrame:
    """Blocks of at least min(2, share * len / window) points."""
    return blocks.where(F.col("n_anchors") >= F.least(F.lit(2.0), share * F.col("len") / window))


def uncovered(intervals: DataFrame, keys: list[str], lengths: DataFrame, thd: int) -> DataFrame:
    """Parts of [0, len) longer than `thd` that no interval [start_, end_) covers, head and tail included."""
    by = Window.partitionBy(*keys).orderBy("start_", "end_").rowsBetween(Window.unboundedPreceding, -1)
    inner = intervals.withColumn("gap_start", F.coalesce(F.max("end_").over(by), F.lit(0))).select(*keys, "gap_start", F.col("start_").alias("gap_end"))
    tail = lengths.join(intervals.groupBy(*keys).agg(F.max("end_").alias("last_end")), keys, "left").select(*keys, F.coalesce("last_end", F.lit(0)).alias("gap_start"), F.col("len").alias("gap_end"))
    return inner.unionByName(tail).where(F.col("gap_end") - F.col("gap_start") > thd)


def coverage_steps(intervals: DataFrame, keys: list[str]) -> DataFrame:
    """keys, start_, end_, coverage of the stretches between interval ends: events, their running sum, the next event."""
    events = intervals.select(*keys, F.col("start_").alias("at"), F.lit(1).alias("step")).unionByName(intervals.select(*keys, F.col("end_").alias("at"), F.lit(-1).alias("step")))
    steps = events.groupBy(*keys, "at").agg(F.sum("step").alias("step"))
    by = Window.partitionBy(*keys).orderBy("at")
    out = steps.select(*keys, F.col("at").alias("start_"), F.lead("at").over(by).alias("end_"), F.sum("step").over(by.rowsBetween(Window.unboundedPreceding, 0)).alias("coverage"))
    return out.where("end_ is not null")


def low_coverage(intervals: DataFrame, keys: list[str], below: int = 2, longer: int = 20, merge: int = 20) -> DataFrame:
    """Ranges covered fewer than `below` times, longer than `longer`; those nearer than `merge` to one another are one."""
    low = coverage_steps(intervals, keys).where(F.col("coverage") < below)
    by = Window.partitionBy(*keys).orderBy("start_")
    new = F.when(F.col("start_") - F.lag("end_").over(by) < merge, 0).otherwise(1)
    runs = low.withColumn("new", new).withColumn("run", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*keys, "run").agg(F.min("start_").alias("start_"), F.max("end_").alias("end_")).where(F.col("end_") - F.col("start_") > longer).drop("run")


def largest_overlap(left: DataFrame, right: DataFrame, keys: list[str], bucket: int) -> DataFrame:
    """left_id, overlap: the most that any right interval of the same keys overlaps each left one.

    A range join by buckets: both sides are dealt to every bucket they touch, so it is an equi-join with a residual; a pair may meet more than once, which a maximum doesn't mind.
    """
    deal = lambda df: df.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start_") / bucket), F.floor((F.col("end_") - 1) / bucket))))
    l, r = deal(left.where("end_ > start_")).alias("l"), deal(right.where("end_ > start_")).alias("r")
    on = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in keys] + [F.col("l.bucket") == F.col("r.bucket"), F.col("l.start_") < F.col("r.end_"), F.col("r.start_") < F.col("l.end_")]
    joined = l.join(r, on).select(F.col("l.left_id").alias("left_id"), (F.least("l.end_", "r.end_") - F.greatest("l.start_", "r.start_")).alias("overlap"))
    return joined.groupBy("left_id").agg(F.max("overlap").alias("overlap"))


def not_contained(chains: DataFrame, keys: list[str], ratio: float = 0.5) -> DataFrame:
    """Chains that no longer chain of the same keys contains, if their length is below `ratio` of its."""
    a, b = chains.alias("a"), chains.alias("b")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys] + [F.col("a.chain_id") != F.col("b.chain_id"), F.col("b.start_") <= F.col("a.start_"), F.col("a.end_") <= F.col("b.end_"), F.col("a.end_") - F.col("a.start_") < ratio * (F.col("b.end_") - F.col("b.start_"))]
    return a.join(b, on, "left_anti")


def breakpoint(points: DataFrame, keys: list[str], w: int = 5, before: int = 8, after: int = 12) -> DataFrame:
    """keys, ord, score: where the slopes over the next and the last `w` steps differ most, the last below `before`, the next above `after`."""
    by = Window.partitionBy(*keys).orderBy("ord")
    gain = lambda c: (F.lead(c, w).over(by) - F.col(c)) - (F.col(c) - F.lag(c, w).over(by))
    scored = points.withColumn("score", gain("gx") + gain("gy"))
    left = (F.col("gx") - F.lag("gx", w).over(by)) + (F.col("gy") - F.lag("gy", w).over(by))
    right = (F.lead("gx", w).over(by) - F.col("gx")) + (F.lead("gy", w).over(by) - F.col("gy"))
    scored = scored.withColumns({"left": left, "right": right}).where((F.col("left") < before) & (F.col("right") > after))
    return scored.groupBy(*keys).agg(F.max(F.struct("score", (-F.col("ord")).alias("o"))).alias("m")).select(*keys, (-F.col("m.o")).alias("ord"), F.col("m.score").alias("score"))


def x_drop(points: DataFrame, keys: list[str], one: int = 125, five: int = 300) -> DataFrame:
    """Points up to the first gap longer than `one`, or five gaps in a row longer than `five` together."""
    by = Window.partitionBy(*keys).orderBy("ord")
    gap = F.greatest(F.col("x") - F.lag("x").over(by), F.col("y") - F.lag("y").over(by))
    gaps = points.withColumn("gap", F.coalesce(gap, F.lit(0)))
    stop = (F.col("gap") > one) | (F.sum("gap").over(by.rowsBetween(-4, 0)) > five)
    stopped = gaps.withColumn("stop", F.when(stop, 1).otherwise(0))
    return stopped.withColumn("stopped", F.max("stop").over(by.rowsBetween(Window.unboundedPreceding, 0))).where("stopped = 0").drop("stop", "stopped", "gap")


def main_strand(points: DataFrame, keys: list[str]) -> DataFrame:
    """Strand of most points of a group, the first point's if both have as many."""
    grouped = points.groupBy(*keys).agg(F.sum("strand").alias("ones"), F.count("*").alias("n"), F.min_by("strand", "ord").alias("first"))
    return grouped.select(*keys, F.when(2 * F.col("ones") > F.col("n"), 1).when(2 * F.col("ones") < F.col("n"), 0).otherwise(F.col("first")).cast("int").alias("strand"))


def cut_points(chains: DataFrame, keys: list[str]) -> DataFrame:
    """Chains split at each other's starts and ends: keys, chain_id, start_, end_ of the pieces."""
    cuts = chains.select(*keys, F.col("start_").alias("at")).union(chains.select(*keys, F.col("end_").alias("at"))).groupBy(*keys).agg(F.sort_array(F.collect_set("at")).alias("cuts"))
    inside = F.filter("cuts", lambda c: (c >= F.col("start_")) & (c <= F.col("end_")))
    pieces = chains.join(cuts, keys).withColumn("own", inside).select(*keys, "chain_id", F.explode(F.expr("transform(sequence(1, greatest(1, size(own) - 1)), i -> struct(own[i - 1] as start_, own[i] as end_))")).alias("p"))
    return pieces.select(*keys, "chain_id", "p.start_", "p.end_").where("end_ > start_")
