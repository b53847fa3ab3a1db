"""Joins of read probes with a genome index, and filters of the anchors they give."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.config import BinParams, IndexParams


def one_substitution(a: Column, b: Column) -> Column:
    """Extensions that are equal or whose differing bits lie within two neighbouring ones."""
    v = a.bitwiseXOR(b)
    return (v == 0) | (v / F.greatest(v.bitwiseAND(-v), F.lit(1)) < 4)


def _anchors(joined: DataFrame, span: int) -> DataFrame:
    strand = F.col("r.strand").bitwiseXOR(F.col("g.strand"))
    y = F.when(strand == 0, F.col("r.y")).otherwise(F.col("r.len") - span - F.col("r.y"))
    return joined.select(F.col("r.read_id").alias("read_id"), F.col("g.gid").alias("gid"), strand.alias("strand"), F.col("g.x").alias("x"), y.alias("y"), (F.col("g.x") - y).alias("diag"), F.col("r.ext").alias("ext_r"), F.col("g.ext").alias("ext_g"))


def match(probes: DataFrame, index: DataFrame, params: IndexParams = IndexParams(), mode: str = "d") -> DataFrame:
    """Anchors by an equi-join on the minimizer. The index is capped, so a probe meets a bounded number of entries; the join's side is chosen at run time.

    mode d: the extensions differ by one substitution at most. mode h: they are equal, or the genome's is 0 (left out). mode s: any extension, anchors with
    x > y; long_pattern marks equal extensions.
    """
    joined = probes.alias("r").join(index.alias("g"), F.col("r.minimizer") == F.col("g.minimizer"))
    if mode == "d":
        joined = joined.where(one_substitution(F.col("g.ext"), F.col("r.ext")))
    elif mode == "h":
        joined = joined.where((F.col("g.ext") == F.col("r.ext")) | (F.col("g.ext") == 0))
    elif mode != "s":
        raise ValueError("mode is d, h or s")
    out = _anchors(joined, params.span)
    if mode == "s":
        return out.where("x > y").withColumn("long_pattern", F.col("ext_r") == F.col("ext_g")).drop("ext_r", "ext_g")
    return out.drop("ext_r", "ext_g")


def bin_filter(anchors: DataFrame, params: BinParams = BinParams()) -> DataFrame:
    """Anchors in diagonal bins with more than `least` anchors; all of a read's where none of its bins has."""
    keys = ["read_id", "bin"] if params.legacy else ["read_id", "gid", "strand", "bin"]
    binned = anchors.withColumn("bin", F.floor((F.col("diag") + (1 << 20)) / params.width))
    counted = binned.withColumn("n_bin", F.count("*").over(Window.partitionBy(*keys)))
    return counted.withColumn("best", F.max("n_bin").over(Window.partitionBy("read_id"))).where(f"n_bin > {params.least} or best <= {params.least}").drop("best")


def diagonal_islands(anchors: DataFrame) -> DataFrame:
    """Islands of anchors along the diagonal order: a row goes on with an island while diag - lag(diag) < |dy| / 4.

    The lag form of the running-median rule (`islands_by_median` has that one).
    """
    order = Window.partitionBy("read_id", "gid", "strand").orderBy("diag", "y", "x")
    new = F.when(F.col("diag") - F.lag("diag").over(order) < F.shiftright(F.abs(F.col("y") - F.lag("y").over(order)), 2), 0).otherwise(1)
    return anchors.withColumn("new", new).withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("new")


def density_filter(islands: DataFrame, per: int = 1024, least: int = 2) -> DataFrame:
    """Islands with more than max(span in y / per, least) anchors."""
    keys = ["read_id", "gid", "strand", "island"]
    stats = islands.groupBy(*keys).agg(F.count("*").alias("n"), (F.max("y") - F.min("y")).alias("span_y"), F.min("x").alias("x_min"), F.max("x").alias("x_max"), F.min("y").alias("y_min"), F.max("y").alias("y_max"))
    return stats.where(F.col("n") > F.greatest(F.col("span_y") / per, F.lit(least)))


def genomes_of_reads(anchors: DataFrame) -> DataFrame:
    """Which genomes each read touches."""
    return anchors.select("read_id", "gid").distinct()


def reads_touching(reads: DataFrame, touched: DataFrame) -> DataFrame:
    return reads.join(touched, "read_id", "left_semi")


def stick_to_chain(left: DataFrame, right: DataFrame, keys: list[str], within: int = 12) -> DataFrame:
    """As-of join: each left row goes with the last right row at or before its x (the first if there is none); kept if diagonals differ by less than `within` + 1.

    By a union and one ordered window, so there is no range join.
    """
    both = left.select(*keys, "x", "y", F.lit(1).alias("side"), F.lit(None).cast("struct<x:long,y:long>").alias("to")).unionByName(
        right.select(*keys, "x", "y", F.lit(0).alias("side"), F.struct(F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y")).alias("to"))
    )
    order = Window.partitionBy(*keys).orderBy("x", "side", "y")
    last = F.last("to", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    first = F.first("to", ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    stuck = both.withColumn("main", F.coalesce(last, first)).where("side = 1 and main is not null")
    near = F.abs((F.col("x") - F.col("y")) - (F.col("main.x") - F.col("main.y"))) <= within
    return stuck.where(near).select(*keys, "x", "y", F.col("main.x").alias("main_x"), F.col("main.y").alias("main_y"))
