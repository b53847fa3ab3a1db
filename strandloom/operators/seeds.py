"""Seeds: k-mers, minimizers with extension, sampled and capped indexes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.config import IndexParams, ProbeParams
from strandloom.functions import sequences as S


def spread(df: DataFrame) -> DataFrame:
    """`df` dealt evenly to all cores if it comes straight from a scan with fewer parts than that; what follows makes many rows of each."""
    plan, cores = df._jdf.queryExecution(), df.sparkSession.sparkContext.defaultParallelism
    if plan.executedPlan().nodeName().startswith("Adaptive"):  # it has a shuffle already, and counting its parts would run it
        return df
    return df.repartition(cores) if plan.toRdd().getNumPartitions() < cores else df


def kmer_rows(seqs: DataFrame, seq_id: str, k: int, step: int = 1) -> DataFrame:
    """seq_id, pos, kmer: every `step`-th k-mer without N.

    Positions are exploded and each k-mer is cut in generated code, from bytes: a cut of a string walks to its place, one of bytes doesn't.
    """
    rows = spread(seqs.select(F.col(seq_id).alias("seq_id"), F.col("seq").cast("binary").alias("b")))
    last = F.octet_length("b") - k
    at = F.when(last >= 0, F.sequence(F.lit(0), last, F.lit(step))).otherwise(F.array().cast("array<int>"))
    cut = rows.select("seq_id", "b", F.explode(at).alias("pos")).select("seq_id", "pos", F.substr("b", F.col("pos") + 1, F.lit(k)).cast("string").alias("kmer"))
    return cut.where(~F.contains("kmer", F.lit("N")))


def kmer_counts(seqs: DataFrame, seq_id: str, k: int) -> DataFrame:
    """kmer, n over all sequences; partial counts are combined before the shuffle."""
    return kmer_rows(seqs, seq_id, k).groupBy("kmer").agg(F.count("*").alias("n"))


PIECE = 1 << 20  # bases at a time
_ORDINAL = np.full(256, -1, np.int64)
_ORDINAL[np.frombuffer(S.BASES.encode(), np.uint8)] = np.arange(4)


def spans(seq: bytes, step: int, params: IndexParams) -> tuple[np.ndarray, ...]:
    """Place, strand (0 if the canonical one is forward), minimizer and extension of every `step`-th span without N, all as arrays.

    The numbers are those of `sequences.minimizer` and `sequences.extension`: words of the canonical strand as 2-bit numbers, the leftmost least one, and the four
    bases after it within the span (A where it ends) as 8 bits.
    """
    base = _ORDINAL[np.frombuffer(seq, np.uint8)]
    n, k = params.span, params.weight
    at = np.arange(0, len(base) - n + 1, step)
    odd = np.concatenate([[0], np.cumsum(base < 0)])
    at = at[odd[at + n] == odd[at]]
    if not len(at):
        return (np.zeros(0, np.int64),) * 4
    base = np.maximum(base, 0)
    words = len(base) - k + 1
    forward, backward = np.zeros(words, np.int64), np.zeros(words, np.int64)
    for i in range(k):
        forward |= base[i : i + words] << 2 * (k - 1 - i)
        backward |= (3 - base[i : i + words]) << 2 * i
    sums = np.concatenate([[0], np.cumsum(2 * base - 3)])
    reverse = sums[at + n] - sums[at] <= 0
    places = at[:, None] + np.arange(n - k + 1)
    each = np.where(reverse[:, None], backward[places][:, ::-1], forward[places])
    first = each.argmin(1)
    ext = np.zeros(len(at), np.int64)
    for i in range(4):
        off = first + k + i
        inside = off < n
        p = np.where(inside, np.where(reverse, at + n - 1 - off, at + off), at)
        ext = ext << 2 | np.where(inside, np.where(reverse, 3 - base[p], base[p]), 0)
    return at, reverse.astype(np.int64), each[np.arange(len(at)), first], ext


def seed_rows(seqs: DataFrame, seq_id: str, step: int, params: IndexParams = IndexParams(), new_only: bool = False, min_gap: int | None = None) -> DataFrame:
    """seq_id, pos, strand, minimizer (2-bit number), ext, len of every `step`-th span.

    new_only drops a seed whose minimizer is that of the seed before it in its sequence, unless that is more than `min_gap` away. An Arrow kernel, so this needs no shuffle;
    long sequences are read in pieces.
    """
    piece = max(1, PIECE // step) * step
    schema = "seq_id long, pos long, strand int, minimizer long, ext int, len long"
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple[np.ndarray, ...]] = []
            for i, seq in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                last, last_at = -1, 0
                for begin in range(0, len(seq or b""), piece):
                    at, strand, word, ext = spans(seq[begin : begin + piece + params.span - 1], step, params)
                    if not len(at):
                        continue
                    at = at + begin
                    if new_only:
                        before, before_at = np.append(last, word[:-1]), np.append(last_at, at[:-1])
                        last, last_at = int(word[-1]), int(at[-1])
                        keep = (word != before) | ((at - before_at > min_gap) if min_gap is not None else False)
                        at, strand, word, ext = at[keep], strand[keep], word[keep], ext[keep]
                    held.append((np.full(len(at), i), at, strand, word, ext, np.full(len(at), len(seq))))
                if sum(len(h[0]) for h in held) > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(t.to_pandas_dtype())) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], schema.replace(",", "").split()[::2])
                    held = []
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(t.to_pandas_dtype())) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], schema.replace(",", "").split()[::2])

    return spread(seqs.select(F.col(seq_id).cast("long").alias("seq_id"), F.col("seq").cast("binary").alias("b"))).mapInArrow(run, schema)


def capped(seeds: DataFrame, cap: int) -> DataFrame:
    """Seeds whose minimizer occurs `cap` times or less: a semi join with counts, so a frequent minimizer's rows never meet in one task."""
    few = seeds.groupBy("minimizer").agg(F.count("*").alias("n")).where(F.col("n") <= cap).select("minimizer")
    return seeds.join(few, "minimizer", "left_semi")


def genome_index(genomes: DataFrame, params: IndexParams = IndexParams()) -> DataFrame:
    """gid, x, strand, minimizer, ext: the sampled, capped index."""
    found = seed_rows(genomes, "gid", params.step, params, new_only=True, min_gap=params.min_repeat_gap)
    return capped(found, params.cap).select(F.col("seq_id").cast("int").alias("gid"), F.col("pos").alias("x"), "strand", "minimizer", "ext")


def read_probes(reads: DataFrame, params: ProbeParams = ProbeParams(), index: IndexParams = IndexParams(), retry: bool = False) -> DataFrame:
    """read_id, y, strand, minimizer, ext, len of the probes of reads longer than `min_read`."""
    long = reads.where(F.length("seq") > params.min_read)
    found = seed_rows(long, "read_id", params.alpha_retry if retry else params.alpha, index, new_only=True)
    return found.select(F.col("seq_id").alias("read_id"), F.col("pos").alias("y"), "strand", "minimizer", "ext", "len")


def index_statistics(seeds: DataFrame) -> DataFrame:
    """n (entries of a block), blocks: histogram of block sizes."""
    return seeds.groupBy("minimizer").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("blocks"))
