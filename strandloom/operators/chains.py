"""Chaining: ordered dynamic programming within a read, traceback, and choices among chains.

A fold whose row depends on rows it has already changed isn't relational; it runs per read in `applyInArrow`, where a group is one read's anchors. What follows
(ranks, ratios, spans) is DataFrame code again.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.config import ChainParams

CHAIN_SCHEMA = "read_id long, gid int, strand int, chain_id int, chain_score long, chain_ord int, x long, y long"


def truncated(a: np.ndarray, b) -> np.ndarray:
    return np.trunc(a / b).astype(np.int64)


def anchor_scores(dx: np.ndarray, dy: np.ndarray) -> np.ndarray:
    """The numbers of `scores.anchor_score` over arrays."""
    da = np.abs(dx - dy)
    derr = truncated(100 * da, np.maximum(np.maximum(np.abs(dx), np.abs(dy)), 50))
    s_derr = np.select([derr < 5, derr < 10, derr < 100], [4 * derr, 6 * derr - 10, derr * derr - 5 * derr], 1000)
    d = truncated(dy, 15)
    s_dy = np.select([d < 150, d < 10_000], [truncated(d, 5), truncated(d * d, 200) + 20], 10_000)
    return np.where(dy < 10, -10_000, np.where(da < 10, 100 - s_dy, 100 - s_dy - s_derr))


def best_chains(x: np.ndarray, y: np.ndarray, params: ChainParams = ChainParams(), score: Callable = anchor_scores) -> list[tuple[int, list[int]]]:
    """(score, members from the last to the first) of chains of anchors, which are sorted by x downwards.

    An anchor's predecessor is one of the `depth` before it, and beyond that all nearer than `dx`; of equal sums the farther wins. Chains share no
    anchor: leaves are taken by score, and a chain ends where it meets one that was taken.
    """
    n = len(x)
    total, parent = np.zeros(n, np.int64), np.full(n, -1)
    for i in range(1, n):
        far = int(np.searchsorted(-x, -(x[i] + params.dx), side="left"))
        lo = max(0, min(far, i - params.depth))
        gains = score(x[lo:i] - x[i], y[lo:i] - y[i])
        sums = np.where(gains > 0, gains + total[lo:i], -1)
        k = int(np.argmax(sums))  # the first of equals is the farthest
        if sums[k] > 0:
            total[i], parent[i] = sums[k], lo + k
    taken, out = np.zeros(n, bool), []
    for leaf in np.lexsort((np.arange(n), -total)).tolist():
        if taken[leaf] or len(out) >= params.best_n:
            continue
        members, at = [], leaf
        while at >= 0 and not taken[at]:
            members.append(at)
            taken[at] = True
            at = int(parent[at])
        value = int(total[leaf] - (total[at] if at >= 0 else 0))
        if len(members) < params.min_len or (out and value < params.stop_ratio * out[0][0]):
            continue
        out.append((value, members))
    return out


def chain_anchors(anchors: DataFrame, params: ChainParams = ChainParams()) -> DataFrame:
    """Chains of each read, genome and strand: CHAIN_SCHEMA, chain_id by falling score."""

    def run(t: pa.Table) -> pa.Table:
        order = np.lexsort((t["y"].to_numpy(), -t["x"].to_numpy()))
        x, y = t["x"].to_numpy()[order].astype(np.int64), t["y"].to_numpy()[order].astype(np.int64)
        rows = [(c, value, k, int(x[m]), int(y[m])) for c, (value, members) in enumerate(best_chains(x, y, params), 1) for k, m in enumerate(members, 1)]
        cols = list(zip(*rows, strict=True)) or [()] * 5
        same = lambda name, kind: pa.array([t[name][0].as_py()] * len(rows), kind)
        return pa.table([same("read_id", pa.int64()), same("gid", pa.int32()), same("strand", pa.int32()), *[pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)]], [c.split()[0] for c in CHAIN_SCHEMA.split(", ")])

    kept = anchors.select(F.col("read_id").cast("long"), F.col("gid").cast("int"), F.col("strand").cast("int"), F.col("x").cast("long"), F.col("y").cast("long"))
    return kept.groupBy("read_id", "gid", "strand").applyInArrow(run, CHAIN_SCHEMA)


def major_chains(chains: DataFrame, optional: int = 4, ratio: float = 0.8) -> DataFrame:
    """A read's best chain and at most `optional` more whose score is above `ratio` of its."""
    stats = chains.groupBy("read_id", "gid", "strand", "chain_id").agg(F.first("chain_score").alias("chain_score"), F.count("*").alias("n"), F.min("x").alias("xstart"), F.max("x").alias("xend"), F.min("y").alias("ystart"), F.max("y").alias("yend"))
    by = Window.partitionBy("read_id").orderBy(F.desc("chain_score"), F.desc("n"), "gid", "strand", "chain_id")
    ranked = stats.withColumn("rank", F.row_number().over(by)).withColumn("best", F.first("chain_score").over(by))
    return ranked.where((F.col("rank") == 1) | ((F.col("rank") <= optional + 1) & (F.col("chain_score") > ratio * F.col("best")))).drop("best")


def covering_chains(chains: DataFrame, reads: DataFrame, optional: int = 4, ratio: float = 0.8, apart: float = 0.5, least: float = 0.1, anchors: int = 3) -> DataFrame:
    """The chains that a read is mapped by, with their rank: by falling score those that lie for `apart` or more of their length beside all chains taken before, so
    the parts of a split read are all there, and of the others at most `optional` whose score is above `ratio` of the best. Chains of fewer than `anchors` anchors or below
    `least` of the best score are left out, the best one never. A read's chains are bounded by the traceback.
    """
    keys = ["read_id", "gid", "strand", "chain_id"]
    stats = chains.groupBy(*keys).agg(F.first("chain_score").alias("chain_score"), F.count("*").alias("n"), F.min("x").alias("xstart"), F.max("x").alias("xend"), F.min("y").alias("ystart"), F.max("y").alias("yend"))
    rows = stats.join(reads.select(F.col("read_id").cast("long").alias("read_id"), F.length("seq").cast("long").alias("len")), "read_id")
    schema = "read_id long, gid int, strand int, chain_id int, chain_score long, n long, xstart long, xend long, ystart long, yend long, rank int"

    def run(t: pa.Table) -> pa.Table:
        rows = sorted(t.to_pylist(), key=lambda r: (-r["chain_score"], -r["n"], r["gid"], r["strand"], r["chain_id"]))
        best, taken, more, out = rows[0]["chain_score"], [], 0, []
        for r in rows:
            if out and (r["n"] < anchors or r["chain_score"] < least * best):
                continue
            a, b = (r["ystart"], r["yend"]) if not r["strand"] else (r["len"] - r["yend"], r["len"] - r["ystart"])
            free, at = 0, a
            for lo, hi in sorted(taken):
                free += max(0, min(lo, b) - at)
                at = max(at, hi)
            free += max(0, b - at)
            if not out or free >= apart * max(1, b - a):
                taken.append((a, b))
            elif more < optional and r["chain_score"] > ratio * best:
                more += 1
            else:
                continue
            out.append([*(r[c.split()[0]] for c in schema.split(", ")[:-1]), len(out) + 1])
        return pa.table([pa.array(c, pa.int64() if k.endswith("long") else pa.int32()) for c, k in zip(zip(*out, strict=True), schema.split(", "), strict=True)], [c.split()[0] for c in schema.split(", ")])

    return rows.groupBy("read_id").applyInArrow(run, schema)


def chain_blocks(blocks: DataFrame, depth: int = 20, best_n: int = 50) -> DataFrame:
    """Chains of blocks: read_id, chain_id, chain_score, chain_ord, block_id, the last block (in x) first.

    blocks: read_id, block_id, strand, xstart, xend, ystart, yend, score. A block follows the one of the `depth` before it (by falling x) with the greatest sum of both blocks' chains and the
    positive score of the step; of equal sums the nearer. A block that none can precede begins a chain with its own score. Leaves are taken by score, and a chain ends where it meets
    one that was taken.
    """
    schema = "read_id long, chain_id int, chain_score long, chain_ord int, block_id long"

    def run(t: pa.Table) -> pa.Table:
        rows = sorted(t.to_pylist(), key=lambda r: (-r["xstart"], -r["ystart"], r["block_id"]))
        total, parent = [r["score"] for r in rows], [-1] * len(rows)
        for i, r in enumerate(rows):
            best = -1
            for j in range(max(0, i - depth), i):
                q = rows[j]
                gain = block_step_score(q["xstart"] - r["xend"], q["ystart"] - r["yend"], q["strand"] == r["strand"])
                if gain > 0 and gain + total[j] + r["score"] >= best:
                    best, parent[i] = gain + total[j] + r["score"], j
            if best > 0:
                total[i] = best
            else:
                parent[i] = -1
        taken, out, n = set(), [], 0
        for leaf in sorted(range(len(rows)), key=lambda i: (-total[i], i)):
            if leaf in taken or n >= best_n:
                continue
            members, at = [], leaf
            while at >= 0 and at not in taken:
                members.append(at)
                taken.add(at)
                at = parent[at]
            n += 1
            out += [(rows[leaf]["read_id"], n, total[leaf] - (total[at] if at >= 0 else 0), k, rows[m]["block_id"]) for k, m in enumerate(members, 1)]
        return pa.table([pa.array(c, pa.int64() if k.endswith("long") else pa.int32()) for c, k in zip(zip(*out, strict=True), schema.split(", "), strict=True)], [c.split()[0] for c in schema.split(", ")])

    kept = blocks.select(*[F.col(c).cast("long") for c in ("read_id", "block_id", "strand", "xstart", "xend", "ystart", "yend", "score")])
    return kept.groupBy("read_id").applyInArrow(run, schema)


def block_step_score(dx: int, dy: int, same_strand: bool) -> int:
    """The number of `scores.block_score`."""
    if dx < 0 or dy < 0 or not same_strand or dx > 20_000 or dy > 20_000:
        return -10_000
    apart = abs(dx - dy)
    if apart > 100 or 100 * apart // max(dx, dy, 1) > 50:
        return 70 - dy // 1000 - dx // 100 if dy > dx else 70 - dy // 100 - dx // 1000
    return 100 - dy // 95


def without_steps_back(points: DataFrame, within: int = 50, share: float = 0.05, window: int = 96) -> DataFrame:
    """Points of each block without those that step back from the last one kept by less than `within` in x and y; blocks left with fewer than min(2, share * len / window) points go.

    points: read_id, block_id, ord, x, y, len (of the read). Whether a point stays depends on which stayed before, so it is a fold over a read's points.
    """
    schema = "read_id long, block_id long, ord long, x long, y long"

    def run(t: pa.Table) -> pa.Table:
        kept: dict[int, list[dict]] = {}
        length = 0
        for r in sorted(t.to_pylist(), key=lambda r: r["ord"]):
            own, length = kept.setdefault(r["block_id"], []), r["len"]
            if own:
                dx, dy = r["x"] - own[-1]["x"], r["y"] - own[-1]["y"]
                if (dx < 0 or dy < 0) and abs(dx) < within and abs(dy) < within:
                    continue
            own.append(r)
        out = [r for own in kept.values() if len(own) >= min(2, share * length / window) for r in own]
        return pa.table([pa.array([r[c.split()[0]] for r in out], pa.int64()) for c in schema.split(", ")], [c.split()[0] for c in schema.split(", ")])

    kept = points.select(*[F.col(c).cast("long") for c in ("read_id", "block_id", "ord", "x", "y", "len")])
    return kept.groupBy("read_id").applyInArrow(run, schema)


def islands_by_median(anchors: DataFrame) -> DataFrame:
    """Diagonal islands by the running-median rule: a row goes on with an island while its diagonal is less than |dy| / 4 beyond that of the island's middle row."""
    schema = "read_id long, gid int, strand int, x long, y long, island int"

    def run(t: pa.Table) -> pa.Table:
        diag = t["x"].to_numpy() - t["y"].to_numpy()
        order = np.lexsort((t["x"].to_numpy(), t["y"].to_numpy(), diag))
        diag, y = diag[order], t["y"].to_numpy()[order]
        island, begin, out = 1, 0, []
        for i in range(len(diag)):
            middle = (begin + i) // 2
            if i > begin and not diag[i] - diag[middle] < (abs(int(y[i]) - int(y[middle])) >> 2):
                island, begin = island + 1, i
            out.append(island)
        return t.take(pa.array(order)).append_column("island", pa.array(out, pa.int32()))

    kept = anchors.select(F.col("read_id").cast("long"), F.col("gid").cast("int"), F.col("strand").cast("int"), F.col("x").cast("long"), F.col("y").cast("long"))
    return kept.groupBy("read_id", "gid", "strand").applyInArrow(run, schema)


def repaired(cords: DataFrame, low: int = -20) -> DataFrame:
    """Small steps back between neighbours (low < d < 0 in x or y) are evened out: both ends move half-way. Row i sees row i - 1 as it was changed."""
    schema = "read_id long, ord int, x1 long, y1 long, x2 long, y2 long"

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("ord")
        x1, y1, x2, y2 = (t[c].to_numpy().copy() for c in ("x1", "y1", "x2", "y2"))
        for i in range(1, len(x1)):
            for a, b in ((x1, x2), (y1, y2)):
                d = int(a[i] - b[i - 1])
                if low < d < 0:
                    half = -d // 2
                    b[i - 1] -= half
                    a[i] += -d - half
        return pa.table([t["read_id"], t["ord"], pa.array(x1), pa.array(y1), pa.array(x2), pa.array(y2)], [c.split()[0] for c in schema.split(", ")])

    kept = cords.select(F.col("read_id").cast("long"), F.col("ord").cast("int"), *[F.col(c).cast("long") for c in ("x1", "y1", "x2", "y2")])
    return kept.groupBy("read_id").applyInArrow(run, schema)
