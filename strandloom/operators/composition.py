"""Library operators on sequences and intervals: k-mer statistics, alignment-free distances, bins of k-mers, pile-ups, graphs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.operators import seeds


def d2(left: DataFrame, right: DataFrame, k: int) -> DataFrame:
    """left_id, right_id, d2: sum over k-mers of the product of their counts.

    An equi-join on the k-mer with products added up before the shuffle by pair; no pair without a common k-mer is made.
    """
    counts = lambda df, side: seeds.kmer_rows(df, side, k).groupBy(F.col("seq_id").alias(side), "kmer").agg(F.count("*").alias(f"n_{side}"))
    joined = counts(left, "left_id").join(counts(right, "right_id"), "kmer")
    return joined.groupBy("left_id", "right_id").agg(F.sum(F.col("n_left_id") * F.col("n_right_id")).alias("d2"))


def centred_d2(left: DataFrame, right: DataFrame, k: int, pseudo: float = 0.0) -> DataFrame:
    """left_id, right_id, d2z: D2 divided by the lengths of the count vectors (a cosine)."""
    counts = lambda df, side: seeds.kmer_rows(df, side, k).groupBy(F.col("seq_id").alias(side), "kmer").agg(F.count("*").alias(f"n_{side}"))
    norm = lambda df, side: df.groupBy(side).agg(F.sqrt(F.sum(F.col(f"n_{side}") * F.col(f"n_{side}"))).alias(f"norm_{side}"))
    a, b = counts(left, "left_id"), counts(right, "right_id")
    dots = a.join(b, "kmer").groupBy("left_id", "right_id").agg(F.sum(F.col("n_left_id") * F.col("n_right_id")).alias("d2"))
    return dots.join(norm(a, "left_id"), "left_id").join(norm(b, "right_id"), "right_id").select("left_id", "right_id", (F.col("d2") / (F.col("norm_left_id") * F.col("norm_right_id"))).alias("d2z"))


def d2_star(seqs: DataFrame, seq_id: str, pairs: DataFrame, k: int) -> DataFrame:
    """seq_id, other, score: sums of products of centred word counts, each by its expected share, over the words of any sequence, for the given pairs.

    Words are expected by the bases' shares in all sequences; there are at most 4 ** k of them, so each sequence has a bounded row set.
    """
    letters = seqs.select(F.sum(F.length("seq")).cast("double").alias("all"), *[F.sum(F.length("seq") - F.length(F.replace("seq", F.lit(b), F.lit("")))).alias(b) for b in "ACGT"]).first()
    share = F.create_map(*[F.lit(v) for b in "ACGT" for v in (b, float(letters[b] or 0) / (letters["all"] or 1))])
    counts = seeds.kmer_rows(seqs, seq_id, k).groupBy(F.col("seq_id").alias(seq_id), "kmer").agg(F.count("*").alias("n"))
    words = [r["kmer"] for r in counts.select("kmer").distinct().collect()]  # 4 ** k at most
    listed = F.array(*[F.lit(w) for w in sorted(words)])
    totals = counts.groupBy(seq_id).agg(F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("kmer", "n"))).alias("ns"))
    expected = lambda w: F.aggregate(F.transform(F.split(w, ""), lambda b: F.element_at(share, b)), F.lit(1.0), lambda a, x: a * x)
    rows = totals.select(seq_id, "total", F.explode(F.transform(listed, lambda w: F.struct(w.alias("kmer"), expected(w).alias("p"), (F.coalesce(F.try_element_at("ns", w), F.lit(0)) - F.col("total") * expected(w)).alias("v")))).alias("e")).select(seq_id, "total", "e.*")
    a = pairs.join(rows, seq_id)
    b = rows.select(F.col(seq_id).alias("other"), "kmer", F.col("v").alias("w"), F.col("total").alias("other_total"))
    both = a.join(b, ["other", "kmer"])
    return both.groupBy(seq_id, "other").agg(F.round(F.sum(F.col("v") * F.col("w") / (F.sqrt(F.col("total").cast("double") * F.col("other_total")) * F.col("p"))), 6).alias("score"))


def bin_counts(bins: DataFrame, queries: DataFrame, k: int, threshold: int) -> DataFrame:
    """query_id, bin_id, n: distinct bins' k-mers that a query's distinct k-mers hit, `threshold` or more (an exact interleaved filter)."""
    inside = seeds.kmer_rows(bins, "bin_id", k).select(F.col("seq_id").alias("bin_id"), "kmer").distinct()
    hit = seeds.kmer_rows(queries, "query_id", k).select(F.col("seq_id").alias("query_id"), "kmer").join(inside.select("kmer").distinct(), "kmer", "left_semi")
    return hit.distinct().join(inside, "kmer").groupBy("query_id", "bin_id").agg(F.count("*").alias("n")).where(F.col("n") >= threshold)


def gapped_qgrams(seqs: DataFrame, seq_id: str, shape: str) -> DataFrame:
    """seq_id, pos, gram: bases at the shape's 1s, every position."""
    keep = [i for i, c in enumerate(shape) if c == "1"]
    rows = seeds.kmer_rows(seqs, seq_id, len(shape))
    return rows.select("seq_id", "pos", F.concat(*[F.substr("kmer", F.lit(i + 1), F.lit(1)) for i in keep]).alias("gram"))


def markov_transitions(seqs: DataFrame, seq_id: str, order: int = 1) -> DataFrame:
    """state, next, n, p: transitions of a Markov model of some order."""
    pairs = seeds.kmer_rows(seqs, seq_id, order + 1).groupBy(F.substr("kmer", F.lit(1), F.lit(order)).alias("state"), F.substr("kmer", F.lit(order + 1), F.lit(1)).alias("next")).agg(F.count("*").alias("n"))
    return pairs.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("state")))


def word_zscores(seqs: DataFrame, seq_id: str, k: int) -> DataFrame:
    """kmer, n, expected, z under independent bases."""
    rows = seeds.kmer_rows(seqs, seq_id, k)
    counts = rows.groupBy("kmer").agg(F.count("*").alias("n"))
    bases = seeds.kmer_rows(seqs, seq_id, 1).groupBy(F.col("kmer").alias("base")).agg(F.count("*").alias("m"))
    share = bases.select("base", F.log(F.col("m") / F.sum("m").over(Window.partitionBy())).alias("log_p"))  # four rows
    total = counts.agg(F.sum("n").alias("total"))
    spelt = counts.select("kmer", "n", F.explode(F.split("kmer", "")).alias("base")).where("base <> ''").join(F.broadcast(share), "base").groupBy("kmer", "n").agg(F.exp(F.sum("log_p")).alias("p"))
    return spelt.join(F.broadcast(total)).select("kmer", "n", (F.col("total") * F.col("p")).alias("expected"), ((F.col("n") - F.col("total") * F.col("p")) / F.sqrt(F.col("total") * F.col("p") * (1 - F.col("p")))).alias("z"))


def pile_up(placed: DataFrame) -> DataFrame:
    """gid, pos, base, depth, share: majority base of placed bases (gid, pos, base)."""
    counts = placed.groupBy("gid", "pos", "base").agg(F.count("*").alias("n"))
    by = Window.partitionBy("gid", "pos")
    ranked = counts.withColumn("depth", F.sum("n").over(by)).withColumn("rank", F.row_number().over(by.orderBy(F.desc("n"), "base")))
    return ranked.where("rank = 1").select("gid", "pos", "base", "depth", (F.col("n") / F.col("depth")).alias("share"))


def exact_matches(seqs: DataFrame, seq_id: str, patterns: DataFrame, length: int) -> DataFrame:
    """pattern_id, seq_id, pos of patterns of one length, by an equi-join on their text."""
    rows = seeds.kmer_rows(seqs, seq_id, length)
    return rows.join(patterns, rows["kmer"] == patterns["pattern"]).select("pattern_id", "seq_id", "pos")


def hamming_matches(seqs: DataFrame, seq_id: str, patterns: DataFrame, length: int, errors: int) -> DataFrame:
    """pattern_id, seq_id, pos, distance of places within `errors` substitutions.

    Pigeonhole: one of errors + 1 pieces is free of errors, so candidates come from equi-joins on pieces; each is then compared.
    """
    from strandloom.functions.sequences import hamming

    cuts = np.linspace(0, length, errors + 2).astype(int).tolist()
    pieces = lambda c: F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.substr(c, F.lit(a + 1), F.lit(b - a)).alias("piece")) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]))
    left = seeds.kmer_rows(seqs, seq_id, length).withColumn("p", pieces(F.col("kmer"))).select("seq_id", "pos", "kmer", "p.i", "p.piece")
    right = patterns.withColumn("p", pieces(F.col("pattern"))).select("pattern_id", "pattern", "p.i", "p.piece")
    found = left.join(right, ["i", "piece"]).select("pattern_id", "seq_id", "pos", hamming(F.col("kmer"), F.col("pattern")).alias("distance"))
    return found.where(F.col("distance") <= errors).distinct()


def hamming_windows(seqs: DataFrame, seq_id: str, patterns: DataFrame, length: int = 24, errors: int = 3) -> DataFrame:
    """pattern_id, start, seq_id, pos, distance: every window of every pattern (pattern_id, seq) against every window of every sequence.

    The pigeonhole of `hamming_matches` as an Arrow kernel over 2-bit windows (31 bases at most); a pair counts at its first piece without errors. The patterns' windows go to all workers.
    """
    cuts = np.linspace(0, length, errors + 2).astype(int).tolist()
    code = np.full(256, 4, np.uint8)
    code[np.frombuffer(b"ACGT", np.uint8)] = np.arange(4)

    def windows(seq: str | None) -> tuple[np.ndarray, np.ndarray]:
        c = code[np.frombuffer((seq or "").encode(), np.uint8)]
        n = len(c) - length + 1
        if n < 1:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        packed, good = np.zeros(n, np.uint64), np.ones(n, bool)
        for i in range(length):
            packed = (packed << np.uint64(2)) | (c[i : i + n] & 3).astype(np.uint64)
            good &= c[i : i + n] < 4
        return np.flatnonzero(good), packed[good]

    places = [(r[0], *windows(r[1])) for r in patterns.select("pattern_id", "seq").collect()]
    owner = np.repeat(np.array([p for p, _, _ in places], np.int64), [len(a) for _, a, _ in places])
    starts = np.concatenate([np.zeros(0, np.int64), *[a for _, a, _ in places]])
    values = np.concatenate([np.zeros(0, np.uint64), *[v for _, _, v in places]])
    cut = lambda x, a, b: (x >> np.uint64(2 * (length - b))) & np.uint64(4 ** (b - a) - 1)
    orders = [np.argsort(cut(values, a, b), kind="stable") for a, b in zip(cuts, cuts[1:], strict=False)]
    evens = np.uint64(0x5555555555555555)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = [cut(values, a, b)[o] for o, a, b in zip(orders, cuts, cuts[1:], strict=False)]
        for batch in batches:
            for seq, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at, mine = windows(text)
                for i in range(0, len(mine), 20_000):
                    x = mine[i : i + 20_000]
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        lo, hi = np.searchsorted(keys[k], cut(x, a, b)), np.searchsorted(keys[k], cut(x, a, b), "right")
                        n = hi - lo
                        who = np.repeat(np.arange(len(x)), n)
                        which = orders[k][np.arange(len(who)) - np.repeat(np.cumsum(n) - n - lo, n)]
                        apart = x[who] ^ values[which]
                        apart = (apart | (apart >> np.uint64(1))) & evens
                        distance = np.bitwise_count(apart)
                        kept = distance <= errors
                        for c, d in zip(cuts[:k], cuts[1:], strict=False):
                            kept &= cut(apart, c, d) > 0
                        if kept.any():
                            yield pa.RecordBatch.from_arrays([pa.array(owner[which[kept]]), pa.array(starts[which[kept]]), pa.array([seq] * int(kept.sum()), pa.int64()), pa.array(at[i + who[kept]]), pa.array(distance[kept].astype(np.int64))], ["pattern_id", "start", "seq_id", "pos", "distance"])

    return seeds.spread(seqs.select(F.col(seq_id).cast("long").alias("seq_id"), "seq")).mapInArrow(run, "pattern_id long, start long, seq_id long, pos long, distance long")


def word_counts(seqs: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Words of k bytes without N of all sequences, as rows of bytes, and how often each occurs."""
    data = np.frombuffer(b"N".join(seqs), np.uint8)
    n = len(data) - k + 1
    if n < 1:
        return np.zeros((0, k), np.uint8), np.zeros(0, np.int64)
    odd = np.concatenate([[0], np.cumsum(data == ord("N"))])
    at = np.flatnonzero(odd[k:] == odd[:-k])
    letters = np.unique(data[data != ord("N")])
    if len(letters) <= 4 and k <= 32:  # words as numbers
        code = np.zeros(256, np.uint64)
        code[letters] = np.arange(len(letters))
        code, packed = code[data], np.zeros(n, np.uint64)
        for i in range(k):
            packed = (packed << np.uint64(2)) | code[i : i + n]
        _, first, counts = np.unique(packed[at], return_index=True, return_counts=True)
    else:
        _, first, counts = np.unique(np.lib.stride_tricks.sliding_window_view(data, k)[at].view(f"S{k}").ravel(), return_index=True, return_counts=True)
    first = at[first]
    return data[first[:, None] + np.arange(k)], counts


HELD = 1 << 21  # bases of one id that are counted together


def repeats(seqs: DataFrame, seq_id: str, k: int, least: int = 2) -> DataFrame:
    """seq_id, kmer, n: words that occur `least` times or more in a sequence.

    Whole sequences are dealt out by id and their words are counted beside them, so words don't travel. Rows of one id are one sequence's: beyond HELD bases their
    counts are handed on, all words, and added up.
    """
    one = 1 if least <= 1 else least

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held, size, split = None, [], 0, False

        def counted(least: int) -> Iterator[pa.RecordBatch]:
            words, counts = word_counts(held, k)
            kept = counts >= least
            words, counts = words[kept], counts[kept]
            if len(words):
                text = pa.FixedSizeBinaryArray.from_buffers(pa.binary(k), len(words), [None, pa.py_buffer(words.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([own] * len(words), pa.int64()), text, pa.array(counts, pa.int64())], ["seq_id", "kmer", "n"])

        for batch in batches:
            for i, seq in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held and (i != own or size >= HELD):
                    split = split or i == own
                    yield from counted(1 if split else one)
                    held, size = [], 0
                    split = split and i == own
                own = i
                held.append(seq or b"")
                size += len(held[-1])
        if held:
            yield from counted(1 if split else one)

    rows = seqs.select(F.col(seq_id).cast("long").alias("seq_id"), F.col("seq").cast("binary").alias("b"))
    found = rows.repartition("seq_id").sortWithinPartitions("seq_id").mapInArrow(run, "seq_id long, kmer binary, n long")
    return found.groupBy("seq_id", F.col("kmer").cast("string").alias("kmer")).agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def banded_score(a: str, b: str, band: int, match: int = 3, mismatch: int = -2, gap: int = -1) -> int:
    """Global alignment score within a band, a row at a time over arrays."""
    n, m = len(a), len(b)
    band = max(band, abs(n - m))
    low = -(10**9)
    bs = np.frombuffer(b.encode(), np.uint8)
    row = np.full(m + 1, low, np.int64)
    row[: min(m, band) + 1] = gap * np.arange(min(m, band) + 1)
    steps = gap * np.arange(m + 1)
    for i, c in enumerate(a.encode(), 1):
        new = np.full(m + 1, low, np.int64)
        lo, hi = max(0, i - band), min(m, i + band)
        new[lo : hi + 1] = row[lo : hi + 1] + gap
        if lo == 0:
            new[0] = gap * i
        s = max(lo, 1)
        new[s : hi + 1] = np.maximum(new[s : hi + 1], row[s - 1 : hi] + np.where(bs[s - 1 : hi] == c, match, mismatch))
        # gaps along the row: a running maximum of values less the cost so far
        new[lo : hi + 1] = np.maximum.accumulate(new[lo : hi + 1] - steps[lo : hi + 1]) + steps[lo : hi + 1]
        row = new
    return int(row[m])


def alignment_scores(pairs: DataFrame, band: int = 48) -> DataFrame:
    """pair_id, score of (pair_id, a, b)."""

    def run(batches):
        for batch in batches:
            scores = [banded_score(a or "", b or "", band) for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.int64())], ["pair_id", "score"])

    return pairs.select(F.col("pair_id").cast("long"), F.col("a").cast("string"), F.col("b").cast("string")).mapInArrow(run, "pair_id long, score long")
