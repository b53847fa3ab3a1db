"""Exact alignment of pairs within a band, its CIGAR, and checks of alignments."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MATCH, MISMATCH, GAP, BAND = 3, -2, -1, 48


def banded(a: str, b: str, band: int = BAND) -> tuple[int, list[tuple[str, int]]]:
    """Score and CIGAR (operations on a as the genome: D is a base of a alone, I one of b) of the global alignment within `band` of the diagonal.

    Rows are arrays; gaps along a row are a running maximum. Of equal ways a step in both comes first, then D, then I. Memory is len(a) x len(b) bytes.
    """
    n, m = len(a), len(b)
    band = max(band, abs(n - m))
    low = -(10**9)
    bs = np.frombuffer(b.encode(), np.uint8)
    steps = GAP * np.arange(m + 1)
    row = np.where(np.arange(m + 1) <= band, steps, low)
    ways = np.zeros((n + 1, m + 1), np.int8)  # 0 both, 1 D, 2 I
    ways[0, 1:] = 2
    for i, c in enumerate(a.encode(), 1):
        lo, hi = max(0, i - band), min(m, i + band)
        down = np.full(m + 1, low, np.int64)
        down[lo : hi + 1] = row[lo : hi + 1] + GAP
        both = np.full(m + 1, low, np.int64)
        s = max(lo, 1)
        both[s : hi + 1] = row[s - 1 : hi] + np.where(bs[s - 1 : hi] == c, MATCH, MISMATCH)
        best = np.maximum(down, both)
        run = np.full(m + 1, low, np.int64)
        run[lo : hi + 1] = np.maximum.accumulate(best[lo : hi + 1] - steps[lo : hi + 1]) + steps[lo : hi + 1]
        ways[i] = np.where(run > best, 2, np.where(both >= down, 0, 1))
        row = run
    ops: list[tuple[str, int]] = []
    i, j = n, m
    while i or j:
        way = int(ways[i, j]) if i else 2
        op = ("=" if a[i - 1] == b[j - 1] else "X") if way == 0 else "D" if way == 1 else "I"
        i, j = i - (way != 2), j - (way != 1)
        if ops and ops[-1][0] == op:
            ops[-1] = (op, ops[-1][1] + 1)
        else:
            ops.append((op, 1))
    return int(row[m]), ops[::-1]


def aligned(pairs: DataFrame, band: int = BAND) -> DataFrame:
    """pair_id, score, cigar of (pair_id, a, b)."""
    schema = "pair_id long, score long, cigar array<struct<op:string,n:bigint>>"
    kind = pa.list_(pa.struct([("op", pa.string()), ("n", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [banded(a or "", b or "", band) for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s for s, _ in done], pa.int64()), pa.array([[{"op": o, "n": n} for o, n in c] for _, c in done], kind)], ["pair_id", "score", "cigar"])

    return pairs.select(F.col("pair_id").cast("long"), F.col("a").cast("string"), F.col("b").cast("string")).mapInArrow(run, schema)


WORDS = 4096  # of the bit vectors that step together
_ONES = np.uint64(2**64 - 1)


def edit_distances(pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Edit distances of pairs of code point arrays, whole, in words of 64 rows (Myers and Hyyro).

    The longer sequence of a pair lies along the words. Word b takes the shorter one's place t - b at step t, so all words of all pairs of a group step together, each
    with what the word before it handed on a step ago; a word that nothing has reached is left as it is by a place without a character. Rows that fill up a pair's first
    word have no vertical difference.
    """
    out = np.array([max(len(a), len(b)) for a, b in pairs], np.int64)
    sides = [(a, b) if len(a) >= len(b) else (b, a) for a, b in pairs]
    words = np.array([-(-len(a) // 64) for a, _ in sides], np.int64)
    steps = np.array([len(b) for _, b in sides], np.int64) + words - 1
    order = [int(i) for i in np.argsort(-steps, kind="stable") if len(sides[i][1])]
    begin = 0
    while begin < len(order):
        end, held = begin + 1, int(words[order[begin]])
        while end < len(order) and held + words[order[end]] <= WORDS:
            held, end = held + int(words[order[end]]), end + 1
        group = order[begin:end]
        out[group] = _group_distances([sides[i] for i in group], words[group], steps[group])
        begin = end
    return out


def _group_distances(sides: list[tuple[np.ndarray, np.ndarray]], words: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Distances of pairs in falling order of their steps; the words of those that still step are the first ones."""
    letters = np.unique(np.concatenate([x for s in sides for x in s]))
    after = np.cumsum(words)
    first, last, total, kinds = after - words, after - 1, int(after[-1]), len(letters) + 1
    equal = np.zeros((total, kinds), np.uint64)  # the last kind is no character
    pv, mv = np.full(total, _ONES), np.zeros(total, np.uint64)
    feed, place, at = [], np.empty(total, np.int64), 0
    for (a, b), f, w in zip(sides, first.tolist(), words.tolist(), strict=True):
        fill = 64 * w - len(a)
        bits = np.zeros((kinds - 1, 64 * w), bool)
        bits[np.searchsorted(letters, a), np.arange(fill, 64 * w)] = True
        equal[f : f + w, :-1] = np.packbits(bits, axis=1, bitorder="little").view("<u8").T
        pv[f] = _ONES << np.uint64(fill)
        none = np.full(w - 1, kinds - 1)
        feed += [none, np.searchsorted(letters, b), none]
        place[f : f + w] = at + w - 1 - np.arange(w)
        at += len(b) + 2 * (w - 1)
    feed, equal = np.concatenate(feed), equal.ravel()
    row = np.arange(total) * kinds
    buffers = [np.zeros(total, np.uint64) for _ in range(5)]
    up, down = np.zeros(total, np.uint64), np.zeros(total, np.uint64)
    one, top = np.uint64(1), np.uint64(63)
    score = np.array([len(a) for a, _ in sides], np.int64)
    live, t = len(sides), 0
    while live:
        n, until = int(after[live - 1]), int(steps[live - 1])
        p, m, hp, hm, r, at_ = pv[:n], mv[:n], up[:n], down[:n], row[:n], place[:n]
        eq, xv, xh, ph, mh = (x[:n] for x in buffers)
        ends, starts, sums = last[:live], first[:live], score[:live]
        code = np.empty(n, np.int64)
        while t < until:
            hp[starts], hm[starts] = 1, 0
            np.take(feed, at_, out=code, mode="clip")
            code += r
            np.take(equal, code, out=eq, mode="clip")
            np.bitwise_or(eq, m, out=xv)
            eq |= hm
            np.bitwise_and(eq, p, out=xh)
            xh += p
            xh ^= p
            xh |= eq
            np.bitwise_or(xh, p, out=ph)
            np.invert(ph, out=ph)
            ph |= m
            np.bitwise_and(p, xh, out=mh)
            np.left_shift(ph, one, out=xh)
            xh |= hp
            np.left_shift(mh, one, out=eq)
            eq |= hm
            ph >>= top
            mh >>= top
            sums += ph[ends].view(np.int64)
            sums -= mh[ends].view(np.int64)
            hp[1:], hm[1:] = ph[:-1], mh[:-1]
            np.bitwise_or(xv, xh, out=p)
            np.invert(p, out=p)
            p |= eq
            np.bitwise_and(xh, xv, out=m)
            at_ += 1
            t += 1
        while live and steps[live - 1] == t:
            live -= 1
    return score


def _code_points(text: str | None) -> np.ndarray | None:
    return None if text is None else np.frombuffer(text.encode(), np.uint8) if text.isascii() else np.frombuffer(text.encode("utf-32-le"), np.uint32)


def whole_distances(pairs: DataFrame) -> DataFrame:
    """id, edit (of a and b, null if one is), hamming (of a and its own reverse complement) of (id, a, b)."""
    turned = np.arange(128, dtype=np.uint32)
    turned[np.frombuffer(b"ACGT", np.uint8)] = np.frombuffer(b"TGCA", np.uint8)

    def mirrored(a: np.ndarray | None) -> int | None:
        return None if a is None else int((a != np.where(a < 128, turned[np.minimum(a, 127)], a)[::-1]).sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2_000):
                part = batch.slice(i, 2_000)
                a, b = ([_code_points(t) for t in part.column(k).to_pylist()] for k in (1, 2))
                both = [k for k in range(len(a)) if a[k] is not None and b[k] is not None]
                edit = np.zeros(len(a), np.int64)
                edit[both] = edit_distances([(a[k], b[k]) for k in both])
                lost = np.ones(len(a), bool)
                lost[both] = False
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(edit, mask=lost), pa.array(list(map(mirrored, a)), pa.int64())], ["id", "edit", "hamming"])

    return pairs.select(F.col("id").cast("long"), F.col("a").cast("string"), F.col("b").cast("string")).mapInArrow(run, "id long, edit long, hamming long")


def sound(score: Column, cigar: Column, least_density: float = 2.0, least_share: float = 0.75) -> Column:
    """Whether an alignment scores `least_density` a column or more and matches `least_share` of its columns."""
    total = lambda *ops: F.aggregate(cigar, F.lit(0).cast("long"), lambda s, e: s + F.when(e["op"].isin(*ops), e["n"]).otherwise(0))
    columns = F.greatest(total("=", "X", "I", "D"), F.lit(1))
    return (score / columns >= least_density) & (total("=") / columns >= least_share)


def without_small_indels(cigar: Column, within: int = 15) -> Column:
    """I and D become = while what they have added up to (D less I) stays within `within`; runs are merged."""
    from strandloom.operators.alignments import merged_runs

    empty = F.array().cast("array<struct<op:string,n:bigint>>")

    def step(s: Column, e: Column) -> Column:
        moved = s["at"] + F.when(e["op"] == "D", e["n"]).when(e["op"] == "I", -e["n"]).otherwise(0)
        small = e["op"].isin("I", "D") & (F.abs(moved) < within)
        return F.struct(F.when(small, moved).otherwise(s["at"]).alias("at"), F.array_append(s["out"], F.struct(F.when(small, "=").otherwise(e["op"]).alias("op"), e["n"].alias("n"))).alias("out"))

    return merged_runs(F.aggregate(cigar, F.struct(F.lit(0).cast("long").alias("at"), empty.alias("out")), step)["out"])


def colinear(dx: Column, dy: Column, within: int = 50) -> Column:
    return (dx >= 0) & (dy >= 0) & (F.abs(dx - dy) < within)


def band_areas(bands: DataFrame, keys: list[str]) -> DataFrame:
    """keys, area: sum of the areas of bands (len, width) along 45 degrees."""
    return bands.groupBy(*keys).agg(F.sum((2 * F.col("width") + 1) * F.col("len")).alias("area"))


def off_diagonal(tiles: DataFrame, keys: list[str], within: int = 80) -> DataFrame:
    """Tiles whose diagonal differs from their group's first by `within` or less."""
    by = Window.partitionBy(*keys).orderBy("ord")
    return tiles.withColumn("base", F.first(F.col("x") - F.col("y")).over(by)).where(F.abs(F.col("x") - F.col("y") - F.col("base")) <= within).drop("base")


def probable_score(kind: Column, length: Column, mean: float = 1000.0, deviation: float = 1000.0) -> Column:
    """100 * p(variant) * (1 - cdf(length))."""
    from strandloom.functions.sequences import normal_cdf
    from strandloom.operators.scores import variant_probability

    return F.round(100 * variant_probability(kind) * (1 - normal_cdf(length, mean, deviation)), 4)
