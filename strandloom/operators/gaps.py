"""Gaps of mapped reads: where they are, anchors and chains inside them, choices between chains, breakpoints, and windows that extend blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.config import ChainParams, FeatureParams
from strandloom.functions import sequences as S
from strandloom.operators.chains import best_chains, truncated
from strandloom.operators.features import dimer_counts

HEAD, INNER, TAIL, TURNED = "head", "inner", "tail", "turned"
TILE, REACH = 1 << 16, 1 << 13  # genomes are cut to tiles that overlap by the longest window of a gap


def gap_table(blocks: DataFrame, reads: DataFrame, least: int = 50, end_most: int = 2000, inner_most: int = 3000) -> DataFrame:
    """read_id, gid, strand, kind, x_lo, x_hi, y_lo, y_hi: before the first block (`end_most` bases at most), between neighbours of one genome and strand whose x
    steps are below `inner_most`, and after the last; in strand coordinates, longer than `least` in x or y.
    """
    by = Window.partitionBy("read_id", "gid", "strand").orderBy("ystart", "xstart", "yend", "xend")
    marked = blocks.join(reads.select("read_id", F.length("seq").alias("len")), "read_id").select("*", F.lag("xend").over(by).alias("px"), F.lag("yend").over(by).alias("py"), F.lead("ystart").over(by).alias("ny"))
    row = lambda kind, a, b, c, d: F.struct(F.lit(kind).alias("kind"), a.cast("long").alias("x_lo"), b.cast("long").alias("x_hi"), c.cast("long").alias("y_lo"), d.cast("long").alias("y_hi"))
    c = F.col
    before = F.least(c("ystart"), c("xstart"), F.lit(end_most))
    after = F.least(c("len") - c("yend"), F.lit(end_most))
    gaps = F.array(
        F.when(c("py").isNull() & (before > least), row(HEAD, c("xstart") - before, c("xstart"), c("ystart") - before, c("ystart"))),
        F.when((F.abs(c("xstart") - c("px")) < inner_most) & (c("xstart") >= c("px")) & (c("ystart") >= c("py")) & (F.greatest(c("xstart") - c("px"), c("ystart") - c("py")) > least), row(INNER, c("px"), c("xstart"), c("py"), c("ystart"))),
        F.when(c("ny").isNull() & (after > least), row(TAIL, c("xend"), c("xend") + after, c("yend"), c("yend") + after)),
    )
    return marked.select("read_id", "gid", "strand", F.explode(F.filter(gaps, lambda g: g.isNotNull())).alias("g")).select("read_id", "gid", "strand", "g.*")


def gap_anchors(gaps: DataFrame, reads: DataFrame, genomes: DataFrame, k: int = 9, genome_step: int = 5, within: int = 50) -> DataFrame:
    """read_id, gid, strand, kind, x, y of equal k-mers of a gap's genome and read windows whose diagonals differ from the gap's by `within` or less, or lie between its ends'.

    Windows are cut first, so only they are exploded; the join is on the gap and the k-mer. A gap meets the tile of its genome in which it begins, so no gap carries a whole
    genome and no genome is one hot key; windows longer than REACH are cut to it.
    """
    keys = ["read_id", "gid", "strand", "kind", "x_lo", "y_lo"]
    seq = F.when(F.col("strand") == 0, F.col("seq")).otherwise(S.reverse_complement(F.col("seq")))
    cut = lambda c, lo, hi: F.substr(c.cast("binary"), (F.col(lo) + 1).cast("int"), F.greatest(F.col(hi) - F.col(lo), F.lit(0)).cast("int"))
    right = gaps.join(reads.select("read_id", "seq"), "read_id").select(*keys, "x_hi", "y_hi", cut(seq, "y_lo", "y_hi").alias("b"))
    b = F.col("seq").cast("binary")
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.octet_length(b) - 1, F.lit(0)).cast("long"), F.lit(TILE).cast("long"))
    tiles = genomes.select("gid", b.alias("seq"), F.explode(starts).alias("begin")).select("gid", "begin", F.substr("seq", (F.col("begin") + 1).cast("int"), F.lit(TILE + REACH)).alias("seq"))
    placed = gaps.withColumn("begin", F.floor(F.greatest("x_lo", F.lit(0)) / TILE) * TILE)
    own = placed.join(tiles, ["gid", "begin"])
    left = own.select(*keys, F.substr("seq", (F.col("x_lo") - F.col("begin") + 1).cast("int"), F.least(F.greatest(F.col("x_hi") - F.col("x_lo"), F.lit(0)), F.lit(REACH)).cast("int")).alias("b"))

    def words(df: DataFrame, step: int, name: str) -> DataFrame:
        at = F.when(F.octet_length("b") >= k, F.sequence(F.lit(0), F.octet_length("b") - k, F.lit(step))).otherwise(F.array().cast("array<int>"))
        return df.select("*", F.explode(at).alias("p")).select(*[c for c in df.columns if c != "b"], F.substr("b", F.col("p") + 1, F.lit(k)).alias("kmer"), F.col("p").cast("long").alias(name))

    found = words(left, genome_step, "px").join(words(right, 1, "py"), [*keys, "kmer"])
    x, y = F.col("x_lo") + F.col("px"), F.col("y_lo") + F.col("py")
    d1, d2 = F.col("x_lo") - F.col("y_lo"), F.col("x_hi") - F.col("y_hi")
    inside = (x - y >= F.least(d1, d2) - within) & (x - y <= F.greatest(d1, d2) + within)
    return found.where(inside).select("read_id", "gid", "strand", "kind", "x_lo", "y_lo", x.alias("x"), y.alias("y"))


def with_turned(gaps: DataFrame, reads: DataFrame) -> DataFrame:
    """Gaps, and each inner one on the other strand as well (kind `turned`): an inversion lies there."""
    lengths = reads.select("read_id", F.length("seq").cast("long").alias("len"))
    other = gaps.where(F.col("kind") == INNER).join(lengths, "read_id")
    other = other.select("read_id", "gid", (1 - F.col("strand")).alias("strand"), F.lit(TURNED).alias("kind"), "x_lo", "x_hi", (F.col("len") - F.col("y_hi")).alias("y_lo"), (F.col("len") - F.col("y_lo")).alias("y_hi"))
    return gaps.unionByName(other)


def on_better_strand(anchors: DataFrame) -> DataFrame:
    """Anchors of each inner gap on the strand that has more of them (its own, of equals)."""
    main = F.when(F.col("kind") == TURNED, 1 - F.col("strand")).otherwise(F.col("strand"))
    by = Window.partitionBy("read_id", "gid", "x_lo", main, F.col("kind").isin(INNER, TURNED))
    turned = F.sum(F.when(F.col("kind") == TURNED, 1).otherwise(0)).over(by)
    kept = anchors.withColumn("n_turned", turned).withColumn("n_all", F.count("*").over(by))
    return kept.where(~F.col("kind").isin(INNER, TURNED) | ((2 * F.col("n_turned") > F.col("n_all")) == (F.col("kind") == TURNED))).drop("n_turned", "n_all")


def gap_scores(dx: np.ndarray, dy: np.ndarray) -> np.ndarray:
    """The numbers of `scores.gap_anchor_score` over arrays, on one strand."""
    e = truncated(100 * np.abs(dx - dy), np.maximum(dy, 50))
    s_e = np.select([e < 10, e < 15], [0, 10 + 2 * e], truncated(e * e, 10) + 40)
    d = np.select([dy < 100, dy < 200], [truncated(dy, 4), truncated(dy, 3) - 9], dy - 145)
    return np.where((dy < 0) | ((np.abs(dx) < 8) & (dx != dy)), -10_000, 100 - d - s_e)


def gap_chains(anchors: DataFrame, params: ChainParams = ChainParams(depth=20, dx=80, best_n=20)) -> DataFrame:
    """The best chain of each gap, and by falling score the others of two anchors or more that lie wholly before or after those taken: read_id, gid, strand, kind, x_lo, ord, x, y.

    So both sides of an insertion or a deletion inside a gap are there, and where it begins and ends is where they meet. A group is one gap's anchors.
    """
    schema = "read_id long, gid int, strand int, kind string, x_lo long, ord int, x long, y long"

    def run(t: pa.Table) -> pa.Table:
        order = np.lexsort((t["y"].to_numpy(), -t["x"].to_numpy()))
        x, y = t["x"].to_numpy()[order], t["y"].to_numpy()[order]
        found = best_chains(x, y, params, gap_scores)
        members: list[int] = []
        spans: list[tuple[int, int, int, int]] = []
        for _, chain in found:
            own = x[chain].min(), x[chain].max(), y[chain].min(), y[chain].max()
            if not spans or (len(chain) > 1 and all((own[0] > b and own[2] > d) or (own[1] < a and own[3] < c) for a, b, c, d in spans)):
                spans.append(own)
                members += chain
        members.sort(key=lambda m: (y[m], x[m]))
        first = lambda name, kind: pa.array([t[name][0].as_py()] * len(members), kind)
        return pa.table(
            [first("read_id", pa.int64()), first("gid", pa.int32()), first("strand", pa.int32()), first("kind", pa.string()), first("x_lo", pa.int64()), pa.array(range(1, len(members) + 1), pa.int32()), pa.array([int(x[m]) for m in members], pa.int64()), pa.array([int(y[m]) for m in members], pa.int64())],
            [c.split()[0] for c in schema.split(", ")],
        )

    kept = anchors.select(F.col("read_id").cast("long"), F.col("gid").cast("int"), F.col("strand").cast("int"), "kind", F.col("x_lo").cast("long").alias("x_lo"), "y_lo", F.col("x").cast("long"), F.col("y").cast("long"))
    return kept.groupBy("read_id", "gid", "strand", "kind", "x_lo", "y_lo").applyInArrow(run, schema)


def with_gap_tiles(points: DataFrame, tiles: DataFrame) -> DataFrame:
    """Points of blocks and of gaps in one order: read_id, gid, strand, ord, x, y, from_gap."""
    both = points.select("read_id", "gid", "strand", "x", "y", F.lit(False).alias("from_gap")).unionByName(tiles.select("read_id", "gid", "strand", "x", "y", F.lit(True).alias("from_gap")))
    return both.withColumn("ord", F.row_number().over(Window.partitionBy("read_id", "gid", "strand").orderBy("y", "x", "from_gap")))


def remapped(blocks: DataFrame, points: DataFrame, reads: DataFrame, genomes: DataFrame, least: int = 50) -> DataFrame:
    """Points with what the gaps between blocks gave: gaps, their anchors, the best chain of each, and both together."""
    found = gap_chains(gap_anchors(gap_table(blocks, reads, least), reads, genomes))
    return with_gap_tiles(points, found)


def gap_lengths(points: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Adds gx, gy: lengths of all gaps in x and y so far, less the word's length."""
    by = Window.partitionBy(*keys).orderBy("ord")
    gap = lambda c: F.coalesce(F.greatest(F.col(c) - F.lag(c).over(by) - k, F.lit(0)), F.lit(0))
    steps = points.withColumns({"sx": gap("x"), "sy": gap("y")})
    run = by.rowsBetween(Window.unboundedPreceding, 0)
    return steps.withColumns({"gx": F.sum("sx").over(run), "gy": F.sum("sy").over(run)}).drop("sx", "sy")


def best_cut(first: DataFrame, second: DataFrame, keys: list[str], within: int = 30) -> DataFrame:
    """keys, ord_1, ord_2, cost: where a chain from the left ends and one from the right begins so that the gaps kept and the step between them are shortest.

    Both have keys, ord, main, cost (gap lengths up to a point in the first, from it on in the second). Candidates have 0 <= main_2 - main_1 <= within: a range join by buckets of that width.
    """
    a = first.select(*keys, F.col("ord").alias("ord_1"), F.col("main").alias("m1"), F.col("cost").alias("c1"), F.explode(F.array(F.floor(F.col("main") / (within + 1)), F.floor(F.col("main") / (within + 1)) + 1)).alias("bucket"))
    b = second.select(*keys, F.col("ord").alias("ord_2"), F.col("main").alias("m2"), F.col("cost").alias("c2"), F.floor(F.col("main") / (within + 1)).alias("bucket"))
    pairs = a.join(b, [*keys, "bucket"]).where((F.col("m2") >= F.col("m1")) & (F.col("m2") - F.col("m1") <= within))
    best = pairs.groupBy(*keys).agg(F.min(F.struct((F.col("c1") + F.col("c2") + F.col("m2") - F.col("m1")).alias("cost"), "ord_1", "ord_2")).alias("m"))
    return best.select(*keys, "m.ord_1", "m.ord_2", "m.cost")


def until_far(tiles: DataFrame, keys: list[str], most: int = 200) -> DataFrame:
    """Tiles before the first step of more than `most` in x or y."""
    by = Window.partitionBy(*keys).orderBy("ord")
    far = F.when((F.abs(F.col("x") - F.lag("x").over(by)) > most) | (F.abs(F.col("y") - F.lag("y").over(by)) > most), 1).otherwise(0)
    return tiles.withColumn("far", far).withColumn("stop", F.max("far").over(by.rowsBetween(Window.unboundedPreceding, 0))).where("stop = 0").drop("far", "stop")


def large_groups(anchors: DataFrame, keys: list[str], group: str, groups_over: int = 10) -> DataFrame:
    """Anchors of groups as large as the median group or larger, where a gap has more than `groups_over` groups."""
    sizes = anchors.groupBy(*keys, group).agg(F.count("*").alias("n"))
    stats = sizes.groupBy(*keys).agg(F.median("n").alias("mid"), F.count("*").alias("groups"))
    return anchors.join(sizes, [*keys, group]).join(stats, keys).where((F.col("groups") <= groups_over) | (F.col("n") >= F.col("mid"))).drop("mid", "groups")


def beside_major(chains: DataFrame, keys: list[str], reach: str) -> DataFrame:
    """Chains that can stand with their group's longest: within twice `reach` of it in x, and no overlap with it in y. The longest stays."""
    by = Window.partitionBy(*keys).orderBy(F.desc("n"), "chain_id")
    top = chains.withColumn("rank", F.row_number().over(by))
    for c in ("xstart", "xend", "ystart", "yend"):
        top = top.withColumn(f"m_{c}", F.first(c).over(by))
    near = (F.col("xstart") <= F.col("m_xend") + 2 * F.col(reach)) & (F.col("xend") >= F.col("m_xstart") - 2 * F.col(reach))
    apart = (F.col("ystart") > F.col("m_yend")) | (F.col("yend") < F.col("m_ystart"))
    return top.where((F.col("rank") == 1) | (near & apart)).drop("rank", *[f"m_{c}" for c in ("xstart", "xend", "ystart", "yend")])


def best_strand(chains: DataFrame, keys: list[str]) -> DataFrame:
    """keys, strand with the longer chains together (0 of equals), total."""
    sums = chains.groupBy(*keys, "strand").agg(F.sum(F.col("yend") - F.col("ystart")).alias("total"))
    return sums.groupBy(*keys).agg(F.max(F.struct("total", (-F.col("strand")).alias("s"))).alias("m")).select(*keys, (-F.col("m.s")).cast("int").alias("strand"), F.col("m.total").alias("total"))


def hit_list(groups: DataFrame, keys: list[str], list_n: int = 20, best_n: int = 10, ratio: float = 0.1) -> DataFrame:
    """Groups by falling n: of the first `list_n` those of at least `ratio` of the largest, `best_n` at most."""
    by = Window.partitionBy(*keys).orderBy(F.desc("n"), "group_id")
    ranked = groups.withColumn("rank", F.row_number().over(by)).withColumn("top", F.max("n").over(Window.partitionBy(*keys)))
    return ranked.where((F.col("rank") <= min(list_n, best_n)) & (F.col("n") >= ratio * F.col("top"))).drop("top")


def block_scores(points: DataFrame, keys: list[str], longest: int = 400) -> DataFrame:
    """keys, drift (mean of absolute steps of the diagonal), mapped (sum of y steps below `longest`)."""
    by = Window.partitionBy(*keys).orderBy("ord")
    d, dy = F.abs((F.col("x") - F.col("y")) - F.lag(F.col("x") - F.col("y")).over(by)), F.col("y") - F.lag("y").over(by)
    steps = points.withColumns({"d": d, "dy": dy})
    return steps.groupBy(*keys).agg(F.round(F.avg("d"), 6).alias("drift"), F.coalesce(F.sum(F.when((F.col("dy") >= 0) & (F.col("dy") < longest), F.col("dy"))), F.lit(0)).alias("mapped"))


def paf_rows(cords: DataFrame, reads: DataFrame, genomes: DataFrame) -> DataFrame:
    """A row for each block: read and genome names, lengths, ends, strand, windows."""
    grouped = cords.groupBy("read_id", "block_id", "gid", "strand").agg(F.min("y1").alias("ystart"), F.max("y2").alias("yend"), F.min("x1").alias("xstart"), F.max("x2").alias("xend"), F.count("*").alias("windows"))
    named = grouped.join(reads.select("read_id", F.col("name").alias("rname"), F.length("seq").alias("rlen")), "read_id").join(genomes.select("gid", F.col("name").alias("gname"), F.length("seq").alias("glen")), "gid")
    return named.select("read_id", "block_id", "rname", "rlen", "ystart", "yend", F.when(F.col("strand") == 1, "-").otherwise("+").alias("sign"), "gname", "glen", "xstart", "xend", "windows")


def error_shares(cigar: Column) -> Column:
    """Share of a CIGAR's length in X and in I and D below 100."""
    total = F.aggregate(cigar, F.lit(0).cast("long"), lambda s, e: s + e["n"])
    wrong = F.aggregate(cigar, F.lit(0).cast("long"), lambda s, e: s + F.when((e["op"] == "X") | (e["op"].isin("I", "D") & (e["n"] < 100)), e["n"]).otherwise(0))
    return F.round(wrong / F.greatest(total, F.lit(1)), 6)


def extended(starts: DataFrame, params: FeatureParams = FeatureParams()) -> DataFrame:
    """Windows that go on from a start as long as their composition agrees: start_id, ord, x, y.

    starts: start_id, x, y, genome, read (sequences on one strand). Each step moves `med` cells on in the read and looks in the genome at `inf` to `sup` + `med` cells on; the nearest
    window is taken while its distance is `accept` or less. A row is a read and its stretch of genome, so memory is bounded by a row.
    """
    apart = params.span // params.cell

    def walk(x: int, y: int, genome: str, read: str) -> list[tuple[int, int]]:
        g, r, out = (*(dimer_counts(q.encode(), params.span, params.cell) for q in (genome, read)), [])
        cx, cy = x // params.cell, y // params.cell
        while True:
            cy += params.med
            options = [c for c in range(cx + params.inf, cx + params.sup + params.med) if c + apart < len(g)]
            if cy + apart >= len(r) or not options:
                return out
            dist = [int(np.abs(g[c] - r[cy]).sum() + np.abs(g[c + apart] - r[cy + apart]).sum()) for c in options]
            k = min(range(len(options)), key=lambda i: (dist[i], abs(options[i] - cx - params.med)))
            if dist[k] > params.accept:
                return out
            cx = options[k]
            out.append((cx * params.cell, cy * params.cell))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, k, *p) for i, x, y, g, r in zip(*(c.to_pylist() for c in batch.columns), strict=True) for k, p in enumerate(walk(x, y, g or "", r or ""), 1)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["start_id", "ord", "x", "y"])

    kept = starts.select(F.col("start_id").cast("long"), F.col("x").cast("long"), F.col("y").cast("long"), F.col("genome").cast("string"), F.col("read").cast("string"))
    return kept.mapInArrow(run, "start_id long, ord int, x long, y long")


def extended_back(starts: DataFrame, params: FeatureParams = FeatureParams()) -> DataFrame:
    """`extended` towards the start: the same walk over both sequences turned end to end, in their own coordinates. start_id, ord (1 is the nearest), x, y."""
    c = F.col
    lengths = starts.select(c("start_id").cast("long").alias("start_id"), F.length("genome").alias("gl"), F.length("read").alias("rl"))
    turned = starts.select("start_id", (F.length("genome") - params.window - c("x")).alias("x"), (F.length("read") - params.window - c("y")).alias("y"), F.reverse("genome").alias("genome"), F.reverse("read").alias("read"))
    found = extended(turned.where((c("x") >= 0) & (c("y") >= 0)), params).join(lengths, "start_id")
    return found.select("start_id", "ord", (c("gl") - params.window - c("x")).alias("x"), (c("rl") - params.window - c("y")).alias("y"))


def patched(pairs: DataFrame, params: FeatureParams = FeatureParams()) -> DataFrame:
    """Windows between two cords: from the first on as far as composition agrees and the second isn't passed, then from the second back to where the others end.

    pairs: start_id, x, y, x2, y2, genome, read on one strand. start_id, ord (along the read), x, y, side (left or right).
    """
    c = F.col
    ends = pairs.select(c("start_id").cast("long").alias("start_id"), c("x").alias("x1"), c("y").alias("y1"), "x2", "y2")
    right = extended(pairs, params).join(ends, "start_id").where((c("x") < c("x2")) & (c("y") < c("y2")))
    last = ends.join(right.groupBy("start_id").agg(F.max("x").alias("mx"), F.max("y").alias("my")), "start_id", "left").select("start_id", F.coalesce("mx", "x1").alias("mx"), F.coalesce("my", "y1").alias("my"))
    back = extended_back(pairs.select("start_id", c("x2").alias("x"), c("y2").alias("y"), "genome", "read"), params).join(last, "start_id").where((c("x") > c("mx")) & (c("y") > c("my")))
    both = right.select("start_id", "x", "y", F.lit("left").alias("side")).unionByName(back.select("start_id", "x", "y", F.lit("right").alias("side")))
    return both.withColumn("ord", F.row_number().over(Window.partitionBy("start_id").orderBy("y", "x"))).select("start_id", "ord", "x", "y", "side")
