"""SimHash near-duplicates by anchor-point covering.

Anchors are the 4,096 words of the binary Golay code on 23 chosen bits of the 64-bit fingerprint. That code is perfect: each
point has exactly one anchor within the covering radius 3, its home. A fingerprint is replicated to every anchor within 3 + 3
of it (about 71), so two fingerprints that differ in 3 bits or fewer meet at the home of either. At each anchor the residents are
compared with all that came; a pair is seen once from each side and no pair is lost. A crowded anchor is dealt out as blocks
(residents x visitors), each of bounded size.

Only distinct fingerprints are compared. Each block emits a forest of its links, never all pairs; connected components of the
forests are the same as of all links.

Defined results: null text counts as empty; a null doc_id is no component's smallest (a component of such rows alone has none); no words give fingerprint 0, linked like any other; fewer words than a shingle give
the one shingle of all words; repeated rows each get a row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import U64, mix, split_runs, stored, tidied
from strandloom.llm.components import connected_components

CODE_BITS, COVER_RADIUS = 23, 3
RESIDENTS, VISITORS = 4096, 65536  # of one block


@lru_cache(1)
def golay() -> np.ndarray:
    """The 4,096 words of the cyclic code generated by x^11 + x^9 + x^7 + x^6 + x^5 + x + 1."""
    words = np.zeros(1, np.uint32)
    for i in range(12):
        words = np.concatenate([words, words ^ np.uint32(0b101011100011 << i)])
    return np.sort(words)


@lru_cache(1)
def nearest_anchor() -> np.ndarray:
    """For each 23-bit point the number of its home anchor."""
    low = np.arange(1 << CODE_BITS, dtype=np.uint32)
    errors = low[np.bitwise_count(low) <= COVER_RADIUS]
    out = np.empty(1 << CODE_BITS, np.uint16)
    for i, word in enumerate(golay()):
        out[errors ^ word] = i
    return out


@lru_cache(2)
def reach(threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each error pattern e of a home: the code words within COVER_RADIUS + threshold of e, flattened, with offsets by e's rank."""
    low = np.arange(1 << CODE_BITS, dtype=np.uint32)
    errors = low[np.bitwise_count(low) <= COVER_RADIUS]
    near = np.bitwise_count(errors[:, None] ^ golay()[None, :]) <= COVER_RADIUS + threshold
    rank = np.zeros(1 << CODE_BITS, np.uint16)
    rank[errors] = np.arange(len(errors))
    at = np.concatenate([[0], np.cumsum(near.sum(1))])
    return rank, at, golay()[np.nonzero(near)[1]]


def points(fingerprints: np.ndarray) -> np.ndarray:
    """23 of the 64 bits: every third from the lowest, and the second."""
    out = np.zeros(len(fingerprints), np.uint32)
    for to, bit in enumerate([*range(0, 64, 3), 1]):
        out |= ((fingerprints >> U64(bit)) & U64(1)).astype(np.uint32) << np.uint32(to)
    return out


def homes_and_visits(fingerprints: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Home anchor of each fingerprint; (which fingerprint, which anchor) of all replicas."""
    return anchors_of(points(fingerprints), threshold)


def anchors_of(p: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same of 23-bit points."""
    home = nearest_anchor()[p]
    word = golay()[home]
    rank, at, flat = reach(threshold)
    r = rank[p ^ word]
    n = (at[r + 1] - at[r]).astype(np.int64)
    who = np.repeat(np.arange(len(p)), n)
    offset = np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n)
    anchors = np.searchsorted(golay(), flat[np.repeat(at[r], n) + offset] ^ word[who])
    return home.astype(np.int64), who, anchors


def fingerprints_of(texts: list[str | None], shingle: int) -> np.ndarray:
    """SimHash of the XXH64 (seed 42) of each text's word shingles, repeats included."""
    xx, hashes = xxhash.xxh64_intdigest, []
    for text in texts:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            hashes.append([])
            continue
        joined, ends, at = b" ".join(words), [], -1
        for n in map(len, words):
            at += n + 1
            ends.append(at)
        if len(words) <= shingle:
            own = [xx(joined, 42)]
        else:
            starts = [0, *[e + 1 for e in ends[: len(words) - shingle]]]
            own = [xx(joined[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :], strict=True)]
        hashes.append(own)
    return majority_bits(hashes)


def majority_bits(hashes: list) -> np.ndarray:
    """Of each list of 64-bit hashes the bits that are 1 in over half of them; 0 of an empty list."""
    n = np.array(list(map(len, hashes)), np.int64)
    out = np.zeros(len(hashes), U64)
    full = np.flatnonzero(n)
    if not len(full):
        return out
    h = np.concatenate([np.asarray(hashes[i], U64) for i in full.tolist()])
    # bits are summed in byte lanes, so 255 hashes at a time, then by text
    blocks = (n[full] + 254) // 255
    text_of = np.repeat(np.arange(len(full)), blocks)
    begin = np.cumsum(n[full]) - n[full]
    inner = np.arange(len(text_of)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    at = begin[text_of] + inner * 255
    to = np.cumsum(blocks) - blocks
    sums = np.empty((len(full), 64), np.int64)
    for s in range(8):
        lanes = np.add.reduceat((h >> U64(s)) & U64(0x0101010101010101), at)
        sums[:, s::8] = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), to, axis=0)
    bits = (2 * sums > n[full][:, None]).astype(np.uint8)
    out[full] = np.packbits(bits, axis=1, bitorder="little").view(U64).ravel()
    return out


def fingerprint_rows(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                fp = fingerprints_of(part.column(1).to_pylist(), shingle).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidied(run), "doc_id long, fp long")


def _count_anchors(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        homes, visits = np.zeros(len(golay()), np.int64), np.zeros(len(golay()), np.int64)
        for batch in batches:
            home, _, anchors = homes_and_visits(batch.column(0).to_numpy(zero_copy_only=False).view(U64), threshold)
            homes += np.bincount(home, minlength=len(homes))
            visits += np.bincount(anchors, minlength=len(visits))
        at = np.flatnonzero(visits)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(homes[at]), pa.array(visits[at])], ["anchor", "homes", "visits"])

    return run


def _deal(threshold: int, home_parts: np.ndarray, visit_parts: np.ndarray):
    """Packs residents and visitors of each block: one row per block and batch, not one per replica."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column(0).to_numpy(zero_copy_only=False).view(U64)
            for i in range(0, len(every), 10_000):
                fp = every[i : i + 10_000]
                home, who, anchors = homes_and_visits(fp, threshold)
                mine = mix(fp ^ U64(0x9E3779B97F4A7C15))
                blocks: dict[tuple[int, int, int], list[bytes]] = {}
                for kind, (f, a) in enumerate(((fp, home), (fp[who], anchors))):
                    m = mix(f ^ U64(0x9E3779B97F4A7C15)) if kind else mine
                    own, other = (home_parts, visit_parts) if not kind else (visit_parts, home_parts)
                    part = (m % own[a].astype(U64)).astype(np.int64)
                    n = other[a]
                    rows = np.repeat(np.arange(len(f)), n)
                    beside = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)
                    h, v = (part[rows], beside) if not kind else (beside, part[rows])
                    key = (a[rows].astype(np.int64) << 40) | (h << 20) | v
                    order = np.argsort(key, kind="stable")
                    data = f[rows][order]
                    for k, lo, hi in split_runs(key[order]):
                        blocks.setdefault(k, [b"", b""])[kind] = data[lo:hi].tobytes()
                yield pa.RecordBatch.from_arrays([pa.array(list(blocks), pa.int64()), pa.array([x[0] for x in blocks.values()], pa.binary()), pa.array([x[1] for x in blocks.values()], pa.binary())], ["block", "homes", "visits"])

    return run


def _compare(threshold: int):
    """Forest of the links between a block's residents and visitors."""

    def run(t: pa.Table) -> pa.Table:
        homes = np.frombuffer(b"".join(t.column("homes").to_pylist()), U64)
        every = np.frombuffer(b"".join(t.column("visits").to_pylist()), U64)
        us, vs = [], []
        if len(homes) and len(every):
            every = np.sort(every)
            tree: dict[int, int] = {}

            def root(x: int) -> int:
                while tree.setdefault(x, x) != x:
                    tree[x] = tree[tree[x]]
                    x = tree[x]
                return x

            step = max(1, 2_000_000 // len(every))
            for i in range(0, len(homes), step):
                apart = np.bitwise_count(homes[i : i + step, None] ^ every[None, :])
                near = (apart <= threshold) & (apart > 0)  # a resident's own copy may have been dealt to another block
                for k in np.flatnonzero(near.any(1)).tolist():
                    x, ys = int(homes[i + k]), every[near[k]].tolist()
                    a = root(x)
                    for y in ys:
                        b = root(y)
                        if a != b:
                            tree[b] = a
                            us.append(x)
                            vs.append(y)
        return pa.table([pa.array(np.array(us, U64).view(np.int64)), pa.array(np.array(vs, U64).view(np.int64))], ["u", "v"])

    return run


def links_forest(distinct: DataFrame, threshold: int = 3) -> DataFrame:
    """(u, v): links between distinct fingerprints (column fp) that span the same components as all links at `threshold` bits or fewer."""
    counts = distinct.select("fp").mapInArrow(tidied(_count_anchors(threshold)), "anchor int, homes long, visits long").groupBy("anchor").agg(F.sum("homes"), F.sum("visits"))
    home_parts, visit_parts = np.ones(len(golay()), np.int64), np.ones(len(golay()), np.int64)
    for anchor, homes, visits in counts.collect():  # one row per anchor: 4,096 at most
        home_parts[anchor] = max(1, -(-homes // RESIDENTS))
        visit_parts[anchor] = max(1, -(-visits // VISITORS))
    dealt = distinct.select("fp").mapInArrow(tidied(_deal(threshold, home_parts, visit_parts)), "block long, homes binary, visits binary")
    return dealt.groupBy("block").applyInArrow(_compare(threshold), "u long, v long")


def near_duplicates(docs: DataFrame, shingle: int = 3, threshold: int = 3) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id reachable by links, itself included) of every row of `docs`."""
    rows = stored(fingerprint_rows(docs, shingle), "simhash")
    distinct = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")), "fingerprints")
    parts = connected_components(links_forest(distinct, threshold)).withColumnRenamed("node", "fp")
    both = distinct.join(parts, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = both.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = stored(both.join(least, "component").select("fp", "component_id"), "named")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_one_of_each(docs: DataFrame, shingle: int = 3, threshold: int = 3) -> DataFrame:
    """Rows of `docs` whose doc_id is the smallest of its component of fingerprints, and those with a null doc_id; repeated rows of an id all stay; columns unchanged."""
    return only_first(docs, near_duplicates(docs, shingle, threshold))


def only_first(docs: DataFrame, components: DataFrame) -> DataFrame:
    kept = components.where("doc_id = component_id").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").select(*docs.columns).unionByName(docs.where("doc_id is null"))
