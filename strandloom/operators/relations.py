"""Relations between cords, blocks and chains, and what gap resolution decides by them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Codes of variants.
VARIANT_CODES = {"inv": 1, "ins": 2, "del": 4, "trs": 8, "dup": 16}


def between(v: Column, low: float, high: float) -> Column:
    return (v > low) & (v < high)


def chainable(same_strand: Column, dx: Column, dy: Column, dy_first: Column, dy_second: Column, low: int = -100, high: int = 10_000) -> Column:
    """Whether two blocks can be neighbours: steps in (low, high). Across strands either of the two steps in y, with one block or the other turned round, may fit."""
    across = between(dy_first, low, high) | between(dy_second, low, high)
    return between(dx, low, high) & F.when(same_strand, between(dy, low, high)).otherwise(across)


def overlapping(same_strand: Column, dx: Column, dy: Column, size: int = 96) -> Column:
    return same_strand & (F.abs(dx) < size) & (F.abs(dy) < size)


def gap_before(dx: Column, size: int = 96) -> Column:
    """The second begins `size` or more after the first; of -dx it says the same of the first."""
    return dx >= size


def off_anchor(dx: Column, dy: Column, sign: int, least: int = 30, share: float = 0.2) -> Column:
    """The step leaves the diagonal by more than `share` of its length (or of `least`), to the side of `sign`."""
    longest = F.greatest(F.abs(dx), F.abs(dy), F.lit(least))
    return (F.abs(dy - dx) > F.floor(longest * share)) & (dy - dx * sign >= 0)


def variant_code(kind: Column) -> Column:
    code = F.lit(0)
    for name, number in VARIANT_CODES.items():
        code = F.when(kind == name, number).otherwise(code)
    return code


def gap_branch(dx: Column, dy: Column, same_strand: Column, off: int = 80, residual: int = 90) -> Column:
    """How a gap is resolved: extend both ends (strands differ), look for an insertion or duplication (more read than genome), a deletion, or map what is left."""
    d = dy - dx
    return F.when(~same_strand, "both_ends").when(d > off, "insertion").when(d < -off, "deletion").when(F.greatest(dx, dy) > residual, "remap").otherwise("none")


def near_long_islands(anchors: DataFrame, keys: list[str], apart: int, top: int = 5, within: int = 2500) -> DataFrame:
    """Anchors whose x is nearer than `within` to the mean x of one of the `top` largest islands of long-pattern anchors (neighbours in x less than `apart` apart).

    Means are at most `top` rows a group, so the semi join meets a bounded number of rows for each anchor.
    """
    by = Window.partitionBy(*keys).orderBy("x")
    new = F.when(F.col("x") - F.lag("x").over(by) < apart, 0).otherwise(1)
    long = anchors.where("long_pattern").withColumn("new", new).withColumn("island", F.sum("new").over(by))
    sizes = long.groupBy(*keys, "island").agg(F.count("*").alias("n"), F.floor(F.avg("x")).alias("mean_x"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "island"))
    means = sizes.withColumn("rank", rank).where(F.col("rank") <= top).select(*[F.col(k).alias(f"m_{k}") for k in keys], "mean_x")
    on = [F.col(k) == F.col(f"m_{k}") for k in keys] + [F.abs(F.col("x") - F.col("mean_x")) < within]
    return anchors.join(means, on, "left_semi")


def banded_words(left: DataFrame, right: DataFrame, keys: list[str], lower: int, upper: int) -> DataFrame:
    """Equal words (keys, kmer) of both sides' x and y with lower <= x - y < upper: an equi join on the keys and the word with a residual."""
    d = F.col("x") - F.col("y")
    return left.join(right, [*keys, "kmer"]).where((d >= lower) & (d < upper))


def facing_overlap(first: DataFrame, second: DataFrame, keys: list[str], slack: int = 25) -> DataFrame:
    """keys, from_1, to_2: where two chains that come towards each other overlap: from the point of the first after its last that lies clearly before the second's
    start, up to the second's first point clearly beyond the first's end (null: to its end). Both have keys, ord, x, y."""
    start = second.groupBy(*keys).agg(F.min_by("x", "ord").alias("x2"), F.min_by("y", "ord").alias("y2"))
    end = first.groupBy(*keys).agg(F.max_by("x", "ord").alias("x1"), F.max_by("y", "ord").alias("y1"))
    before = F.when((F.col("x") < F.col("x2") - slack) & (F.col("y") < F.col("y2") - slack), F.col("ord") + 1)
    one = first.join(start, keys).groupBy(*keys).agg(F.coalesce(F.max(before), F.min("ord")).alias("from_1"))
    beyond = F.when((F.col("x") > F.col("x1") + 2 * slack) & (F.col("y") > F.col("y1") + 2 * slack), F.col("ord"))
    two = second.join(end, keys).groupBy(*keys).agg(F.min(beyond).alias("to_2"))
    return one.join(two, keys)


def framed_tiles(tiles: DataFrame, gaps: DataFrame, keys: list[str], size: int = 96) -> DataFrame:
    """keys, ord, role, x1, y1, x2, y2: each gap's tiles between a head tile at its start and a tail tile at its end. No tile is longer than `size` or reaches beyond the gap.

    gaps: keys, x_lo, y_lo, x_hi, y_hi; tiles: keys, ord, x, y.
    """
    c = F.col
    last = tiles.groupBy(*keys).agg(F.max_by("x", "ord").alias("lx"), F.max_by("y", "ord").alias("ly"), F.max("ord").alias("n"), F.min("ord").alias("first"))
    framed = gaps.join(last, keys, "left")
    whole = F.least(c("x_hi") - c("x_lo"), c("y_hi") - c("y_lo"), F.lit(size))
    head = F.coalesce(F.least(c("lx") - c("x_lo"), c("ly") - c("y_lo"), F.lit(size)), whole)
    tail = F.coalesce(F.least(c("x_hi") - c("lx"), c("y_hi") - c("ly"), F.lit(size)), whole)
    ends = framed.select(*keys, F.explode(F.array(
        F.struct((F.coalesce(c("first"), F.lit(1)) - 1).cast("long").alias("ord"), F.lit("head").alias("role"), c("x_lo").alias("x1"), c("y_lo").alias("y1"), (c("x_lo") + head).alias("x2"), (c("y_lo") + head).alias("y2")),
        F.struct((F.coalesce(c("n"), F.lit(0)) + 1).cast("long").alias("ord"), F.lit("tail").alias("role"), (c("x_hi") - tail).alias("x1"), (c("y_hi") - tail).alias("y1"), c("x_hi").alias("x2"), c("y_hi").alias("y2")),
    )).alias("t")).select(*keys, "t.*")
    own = F.least(c("x_hi") - c("x"), c("y_hi") - c("y"), F.lit(size))
    inner = tiles.join(gaps, keys).select(*keys, c("ord").cast("long").alias("ord"), F.lit("tile").alias("role"), c("x").alias("x1"), c("y").alias("y1"), (c("x") + own).alias("x2"), (c("y") + own).alias("y2"))
    return ends.unionByName(inner)


def closest_chain(chains: DataFrame, keys: list[str], off: int = 50, within: int = 3000) -> DataFrame:
    """keys, chain_id of the first chain near enough to its gap's side, by columns gx, gy (the side) and x, y (the chain's end that faces it)."""
    dx, dy = F.col("x") - F.col("gx"), F.col("y") - F.col("gy")
    near = (F.abs(dx - dy) < off) & (F.greatest(F.abs(dx), F.abs(dy)) < within)
    return chains.where(near).groupBy(*keys).agg(F.min("chain_id").alias("chain_id"))


def merged_blocks(blocks: DataFrame, keys: list[str], low: int = -100, high: int = 10_000) -> DataFrame:
    """Adds merged_id: neighbours in x (of one strand) whose steps in x and y lie in (low, high) are one block. Blocks of equal start and id have one merged_id."""
    by = Window.partitionBy(*keys).orderBy("xstart", "ystart", "block_id")
    dx, dy = F.col("xstart") - F.lag("xend").over(by), F.col("ystart") - F.lag("yend").over(by)
    goes_on = between(dx, low, high) & between(dy, low, high) & (F.col("strand") == F.lag("strand").over(by))
    new = F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)
    return blocks.withColumn("new", new).withColumn("merged_id", F.sum("new").over(by.rangeBetween(Window.unboundedPreceding, Window.currentRow))).drop("new")


def small_groups(rows: DataFrame, keys: list[str], most: int = 1000) -> DataFrame:
    """Rows of groups (the segments of a gap) of `most` rows or fewer; longer gaps are left to the second pass."""
    kept = rows.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") <= most).select(*keys)
    return rows.join(kept, keys, "left_semi")


def density_breakpoint(columns: DataFrame, keys: list[str], head: bool, window: int = 50, edge: int = 10, low: float = 0.65, high: float = 0.75, least: float = 2.2) -> DataFrame:
    """keys, ord, gain: the column of an alignment where the score per column over the next and the last `window` columns differ most (the head's end or the tail's
    start), with shares of matches below `low` on the bad side and above `high` on the good one. columns: keys, ord (gapless), score, matches (running sums)."""
    by = Window.partitionBy(*keys).orderBy("ord")
    left, right = by.rowsBetween(-window, 0), by.rowsBetween(0, window)
    before, after = F.count("*").over(left) - 1, F.count("*").over(right) - 1
    per = lambda n, a, b: (b - a) / F.when(n > 0, n)
    both = columns.select(
        *keys, "ord", before.alias("before"), after.alias("after"),
        per(before, F.first("score").over(left), F.col("score")).alias("sl"), per(after, F.col("score"), F.last("score").over(right)).alias("sr"),
        per(before, F.first("matches").over(left), F.col("matches")).alias("ml"), per(after, F.col("matches"), F.last("matches").over(right)).alias("mr"),
    ).where((F.col("before") >= edge) & (F.col("after") >= edge))
    gain = F.col("sr") - F.col("sl") if head else F.col("sl") - F.col("sr")
    bad, good = ("ml", "mr") if head else ("mr", "ml")
    fits = both.withColumn("gain", F.round(gain, 9)).where((F.col("gain") >= least) & (F.col(bad) < low) & (F.col(good) > high))
    return fits.groupBy(*keys).agg(F.max(F.struct("gain", (-F.col("ord")).alias("o"))).alias("m")).select(*keys, (-F.col("m.o")).alias("ord"), F.col("m.gain").alias("gain"))


def gap_shares(gaps: DataFrame, lengths: DataFrame, keys: list[str]) -> DataFrame:
    """keys, share: of a read's length in gaps (gap_start, gap_end), 0 without any. Reads of a share of 0.7 or more are mapped again with more probes."""
    sums = gaps.groupBy(*keys).agg(F.sum(F.col("gap_end") - F.col("gap_start")).alias("in_gaps"))
    return lengths.join(sums, keys, "left").select(*keys, F.round(F.coalesce("in_gaps", F.lit(0)) / F.greatest("len", F.lit(1)), 6).alias("share"))


def out_of_order(rows: DataFrame, keys: list[str], position: str, value: str) -> DataFrame:
    """keys, n: how many rows are smaller than the one before them; none where a sort holds."""
    by = Window.partitionBy(*keys).orderBy(position)
    return rows.withColumn("back", F.when(F.col(value) < F.lag(value).over(by), 1).otherwise(0)).groupBy(*keys).agg(F.sum("back").alias("n"))


def equal_bases(a: Column, b: Column, k: int) -> tuple[Column, Column]:
    """Equal bases at the left and the right end of two packed words of k bases (2 bits each)."""
    differ = a.bitwiseXOR(b)
    lowest = differ.bitwiseAND(-differ)
    left = F.when(differ == 0, k).otherwise(k - F.floor((F.length(F.bin(differ)) + 1) / 2))
    right = F.when(differ == 0, k).otherwise(F.floor((F.length(F.bin(lowest)) - 1) / 2))
    return left, right


def cord_text(gid: Column, strand: Column, x: Column, y: Column) -> Column:
    """A cord as text, for logs."""
    return F.concat(gid.cast("string"), F.lit(":"), x.cast("string"), F.when(strand == 1, "-").otherwise("+"), y.cast("string"))
