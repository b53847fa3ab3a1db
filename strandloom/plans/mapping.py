"""The mapping plan: reads and genomes to anchors, chains, blocks and virtual alignments."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.config import EngineParams
from strandloom.functions import sequences as S
from strandloom.operators import alignments, anchors, blocks, chains, gaps, relations, seeds


@dataclass(frozen=True)
class Mapping:
    """What a run gives: each a lazy DataFrame."""

    anchors: DataFrame
    blocks: DataFrame
    chains: DataFrame
    lines: DataFrame
    cords: DataFrame


def anchor_blocks(reads: DataFrame, genomes: DataFrame, params: EngineParams = EngineParams(), thd: int = 500) -> DataFrame:
    """read_id, gid, strand, ystart, yend, xstart, xend, n_anchors: relational all the way (joins, bins, islands)."""
    index = seeds.genome_index(genomes, params.index)
    found = anchors.match(seeds.read_probes(reads, params.probe, params.index), index, params.index)
    kept = anchors.bin_filter(found, params.bins)
    table = blocks.block_table(kept, ["read_id", "gid", "strand", "bin"], thd)
    return table.select("read_id", "gid", "strand", "ystart", "yend", "xstart", "xend", "n_anchors")


def again_if_sparse(reads: DataFrame, kept: DataFrame, index: DataFrame, params: EngineParams, share: float = 0.7) -> DataFrame:
    """Anchors, with those of more probes for reads of whose length `share` or more lies in gaps of over `gap_len` between anchors."""
    lengths = reads.select("read_id", F.length("seq").cast("long").alias("len"))
    forward = kept.join(lengths, "read_id").select("read_id", S.flip(F.col("y"), F.col("len") - params.index.span, F.col("strand")).alias("start_")).withColumn("end_", F.col("start_") + params.index.span)
    shares = relations.gap_shares(blocks.uncovered(forward, ["read_id"], lengths.where(F.col("len") > params.probe.min_read), 10 * params.gap_len), lengths, ["read_id"])
    sparse = reads.join(shares.where(F.col("share") >= share).select("read_id"), "read_id", "left_semi")
    more = anchors.bin_filter(anchors.match(seeds.read_probes(sparse, params.probe, params.index, retry=True), index, params.index), params.bins)
    return kept.select("read_id", "gid", "strand", "x", "y").unionByName(more.select("read_id", "gid", "strand", "x", "y")).distinct()


def cords_of(chained: DataFrame, major: DataFrame, reads: DataFrame, genomes: DataFrame, params: EngineParams, word: int = 9) -> DataFrame:
    """Cords of the major chains and of what lies between and beside them: gaps are mapped again with short words, inner ones on both strands, and small steps back are evened out."""
    keys = ["read_id", "gid", "strand"]
    span = params.index.span
    points = chained.join(major.select(*keys, "chain_id", "rank"), [*keys, "chain_id"]).select(*keys, F.col("rank").alias("block_id"), "x", "y", F.lit(span).alias("size"))
    steps = points.select(*keys, F.col("x").alias("xstart"), (F.col("x") + span).alias("xend"), F.col("y").alias("ystart"), (F.col("y") + span).alias("yend"))
    found = gaps.with_turned(gaps.gap_table(steps, reads, params.gap_len), reads)
    tiles = gaps.gap_chains(gaps.on_better_strand(gaps.gap_anchors(found, reads, genomes, word)))
    lengths = reads.select("read_id", F.length("seq").cast("long").alias("len"))
    own = F.when(F.col("kind") == gaps.TURNED, 1 - F.col("strand")).otherwise(F.col("strand"))  # the strand of the block that has the gap
    inner = tiles.join(lengths, "read_id").select("read_id", "gid", "strand", own.alias("main"), F.when(F.col("kind") == gaps.TURNED, F.col("len") - F.col("y") - word).otherwise(F.col("y")).alias("at"), F.lit(None).cast("int").alias("block_id"), "x", "y", F.lit(word).alias("size"), "kind", "x_lo")
    turned = F.min("at").over(Window.partitionBy("read_id", "gid", "main", "kind", "x_lo"))  # all of an inversion stands where it begins, in its own order
    inner = inner.withColumn("at", F.when(F.col("kind") == gaps.TURNED, turned).otherwise(F.col("at"))).drop("kind", "x_lo")
    every = points.select(*keys, F.col("strand").alias("main"), F.col("y").alias("at"), "block_id", "x", "y", "size").unionByName(inner)
    order = Window.partitionBy("read_id", "gid", "main").orderBy("at", "x", "size")
    block = F.coalesce(F.last("block_id", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.first("block_id", ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing)))
    placed = every.withColumn("block_id", block).withColumn("ord", F.row_number().over(Window.partitionBy("read_id").orderBy("block_id", "at", "x", "size")))
    cords = placed.select("read_id", "ord", "block_id", "gid", "strand", F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + F.col("size")).alias("x2"), (F.col("y") + F.col("size")).alias("y2"))
    evened = chains.repaired(cords.select("read_id", "ord", "x1", "y1", "x2", "y2"))
    return cords.select("read_id", "ord", "block_id", "gid", "strand").join(evened, ["read_id", "ord"])


def map_reads(reads: DataFrame, genomes: DataFrame, params: EngineParams = EngineParams()) -> Mapping:
    """reads: read_id, name, seq; genomes: gid, name, seq."""
    index = seeds.genome_index(genomes, params.index)
    found = anchors.match(seeds.read_probes(reads, params.probe, params.index), index, params.index)
    kept = again_if_sparse(reads, anchors.bin_filter(found, params.bins).persist(), index, params)
    chained = chains.chain_anchors(kept, params.chain).persist()
    major = chains.covering_chains(chained, reads)
    cords = cords_of(chained, major, reads, genomes, params) if params.gap_len else plain_cords(chained, major, params)
    lines = alignments.virtual_alignments(cords, reads, params.sam)
    tagged = alignments.supplementary_tags(lines, genomes)
    return Mapping(kept, blocks.block_table(kept, ["read_id", "gid", "strand"], 500), major, tagged, cords)


def plain_cords(chained: DataFrame, major: DataFrame, params: EngineParams) -> DataFrame:
    """Cords of the major chains alone, for runs without gap mapping."""
    keys = ["read_id", "gid", "strand", "chain_id"]
    points = chained.join(major.select(*keys, "rank"), keys).withColumn("ord", F.row_number().over(Window.partitionBy("read_id").orderBy("rank", "chain_ord")))
    return points.select("read_id", "ord", F.col("rank").alias("block_id"), "gid", "strand", F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + params.index.span).alias("x2"), (F.col("y") + params.index.span).alias("y2"))
