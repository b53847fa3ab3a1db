"""Near-duplicate vectors by product quantisation with inverted lists.

Coarse centroids and the codebooks of the residuals are fitted on a bounded sample. Every vector is stored in its nearest centroid's list as residual
codes, with the length e of what the codes leave. A query probes every list that can hold a vector within the threshold and
compares codes by table look-ups; candidates are reranked by exact cosine in double precision.

On unit vectors, cosine >= c means distance r = sqrt(2 - 2c) or less.
* Probes: a vector y of list j is nearer to centroid j than to the query's own i, so a query x has |x - c_j|^2 - |x - c_i|^2 <=
  2 (x - y).(c_i - c_j) / |c_i - c_j| * |c_i - c_j|. The part of x - y along c_i - c_j is r at most, which makes MARGIN = 1 exact; in d dimensions
  it is about r / sqrt(d) for pairs that differ by noise. With MARGIN = 0.5 all lists within half the worst case are probed: four
  standard deviations at 64 dimensions. The tests measure recall against brute force, also on pairs that differ along few dimensions.
* Codes: |x - decoded(y)| <= r + e(y) for every y within r, so that is the cut for look-up distances; no pair is lost there.

Equal vectors are one class: only classes are compared, weighted by their size. Each list is dealt out as blocks of queries and members of
bounded size; a block emits a count and a forest of links, never pairs.

Defined results: vectors that are null, zero, or hold null or non-finite components get n_links 0 and are their own component;
so do rows with a null vec_id; vectors link with those of their own length only, each length has an index of its own; repeated rows each get a row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import U64, mix, split_runs, stored
from strandloom.llm.components import connected_components

SAMPLE = 16_384  # vectors that the index is fitted on, by the hash of their bytes; 16 for each list, if that is more
MOST_LISTS = 4096  # their distances are a table of 128 MB at most
MARGIN = 0.5  # share of the worst case that probes cover
SUBSPACES, CODES = 8, 64
MEMBERS, QUERIES = 4096, 8192  # of one block
SLACK = 1e-5  # for rounding in single precision
ROUNDING = 1e-4  # of squared look-up distances: 16 at most, a term and a sum for each subspace


def lists_for(n: int) -> int:
    return max(1, min(MOST_LISTS, round(math.sqrt(n))))


def kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Centroids by Lloyd's rounds from the first k rows; an empty one keeps its place."""
    centers = x[:k].copy()
    for _ in range(rounds):
        near = nearest(x, centers)
        sums = np.zeros_like(centers)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(centers))
        centers[n > 0] = sums[n > 0] / n[n > 0, None]
    return centers


def nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    half = (centers**2).sum(1) / 2
    return np.concatenate([np.argmax(x[i : i + 4096] @ centers.T - half, axis=1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, in double precision; scaled first, so no square overflows."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


class ProductIndex:
    def __init__(self, sample: np.ndarray, lists: int, threshold: float, margin: float):
        self.radius = math.sqrt(max(0.0, 2 - 2 * threshold)) + SLACK
        self.threshold, self.margin = threshold, margin
        self.centers = kmeans(sample, min(lists, len(sample)))
        square = (self.centers**2).sum(1)
        self.apart = np.sqrt(np.maximum(0, square[:, None] + square[None] - 2 * self.centers @ self.centers.T)) + SLACK
        self.cuts = np.array_split(np.arange(sample.shape[1]), min(SUBSPACES, sample.shape[1]))
        rest = sample - self.centers[nearest(sample, self.centers)]
        self.books = [kmeans(rest[:, c], min(CODES, len(rest))) for c in self.cuts]

    def encode(self, x: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of members of the lists `of`, and the lengths of what they leave."""
        rest = x - self.centers[of]
        codes = np.stack([nearest(rest[:, c], b) for c, b in zip(self.cuts, self.books, strict=True)], 1)
        left = rest - np.concatenate([b[codes[:, i]] for i, b in enumerate(self.books)], 1)
        return codes, np.sqrt((left**2).sum(1))

    def probes(self, x: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which row, which list) of every list that may hold a vector within the radius."""
        far = (self.centers**2).sum(1)[None] - 2 * x @ self.centers.T
        own = far[np.arange(len(x)), of][:, None]
        return np.nonzero(far - own <= 2 * self.margin * self.radius * self.apart[of] + SLACK)

    def near(self, queries: np.ndarray, at: int, codes: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Candidates (member x query) by look-up distances in list `at`. The tables are in single precision: a member's row of them is copied whole; ROUNDING covers what that costs."""
        rest = queries - self.centers[at]
        far = np.zeros((len(codes), len(queries)), np.float32)
        row = np.empty_like(far)
        for i, (c, b) in enumerate(zip(self.cuts, self.books, strict=True)):
            part = rest[:, c]
            to = (b**2).sum(1)[:, None] - 2 * (b @ part.T) + (part**2).sum(1)[None]
            np.take(to.astype(np.float32), codes[:, i], axis=0, out=row, mode="clip")
            far += row
        return far <= ((self.radius + left + SLACK) ** 2 + ROUNDING).astype(np.float32)[:, None]


def _kind(vectors: DataFrame) -> np.dtype:
    """Single precision is kept as it is where the column has it; all arithmetic is in double precision."""
    return np.dtype(np.float32 if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else np.float64)


def _rows_of(data: list[bytes], width: int, kind: np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join(data), kind).reshape(-1, width).astype(np.float64)


def _unpacked(blobs: list[bytes], width: int, kind: np.dtype) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, sizes and vectors of packed rows."""
    rows = np.frombuffer(b"".join(blobs), np.dtype([("id", np.int64), ("n", np.int64), ("x", kind, (width,))]))
    return rows["id"].copy(), rows["n"].copy(), rows["x"].astype(np.float64)


def valid_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, key (bytes of the vector, null where it links with nothing), width (of those bytes)."""
    kind = _kind(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(kind) + kind.type(0)  # null components become NaN
            row = np.repeat(np.arange(len(n)), n)
            some = lambda of: np.bincount(row[of], minlength=len(n)) > 0
            ok = some(x != 0) & ~some(~np.isfinite(x))
            begin = np.concatenate([[0], np.cumsum(np.where(ok, n, 0) * kind.itemsize)]).astype(np.int64)
            keys = pa.Array.from_buffers(pa.large_binary(), len(n), [pa.py_buffer(np.packbits(ok, bitorder="little").tobytes()), pa.py_buffer(begin.tobytes()), pa.py_buffer(x[ok[row]].tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column(0), keys.cast(pa.binary())], ["vec_id", "key"])

    kept = vectors.select(F.col("vec_id").cast("long"), F.col("embedding"))
    return kept.mapInArrow(run, "vec_id long, key binary").withColumn("width", F.length("key"))


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, margin: float = MARGIN) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of `vectors`."""
    rows = stored(valid_vectors(vectors), "vectors")
    usable = F.col("key").isNotNull() & F.col("vec_id").isNotNull()
    widths = sorted(r["width"] for r in rows.where(usable).select("width").distinct().collect())  # lengths of vectors: one of each model that made them
    alone = lambda df: df.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    out = alone(rows.where(~usable))
    for width in widths:
        out = out.unionByName(_of_one_width(rows.where(usable & (F.col("width") == width)), _kind(vectors), width, threshold, margin))
    return out


def _of_one_width(rows: DataFrame, kind: np.dtype, n_bytes: int, threshold: float, margin: float) -> DataFrame:
    spark = rows.sparkSession
    width = n_bytes // kind.itemsize
    classes = stored(rows.groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")), "classes")
    total = classes.count()
    sample = classes.select("key").orderBy(F.xxhash64("key"), "key").limit(max(SAMPLE, 16 * lists_for(total))).toPandas()["key"]
    index = spark.sparkContext.broadcast(ProductIndex(unit(_rows_of(list(sample), width, kind)), lists_for(total), threshold, margin))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = index.value
        members, queries = np.zeros(len(ix.centers), np.int64), np.zeros(len(ix.centers), np.int64)
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                x = unit(_rows_of(batch.slice(i, 1024).column(0).to_pylist(), width, kind))
                of = nearest(x, ix.centers)
                members += np.bincount(of, minlength=len(members))
                queries += np.bincount(ix.probes(x, of)[1], minlength=len(queries))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(members), dtype=np.int32)), pa.array(members), pa.array(queries)], ["list", "members", "queries"])

    counts = classes.select("key").mapInArrow(count, "list int, members long, queries long").groupBy("list").agg(F.sum("members"), F.sum("queries"))
    member_parts, query_parts = np.ones(MOST_LISTS, np.int64), np.ones(MOST_LISTS, np.int64)
    for at, members, queries in counts.collect():  # a row a list: MOST_LISTS at most
        member_parts[at], query_parts[at] = max(1, -(-members // MEMBERS)), max(1, -(-queries // QUERIES))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = index.value
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                data = np.empty(part.num_rows, np.dtype([("id", np.int64), ("n", np.int64), ("x", kind, (width,))]))
                data["x"] = raw = _rows_of(part.column(0).to_pylist(), width, kind)
                reps, data["n"] = (part.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
                data["id"] = reps
                x = unit(raw)
                of = nearest(x, ix.centers)
                who, lists = ix.probes(x, of)
                h = mix(reps.view(U64))
                blocks: dict[int, list[list[bytes]]] = {}
                for side, (rows_, at) in enumerate(((np.arange(len(x)), of), (who, lists))):
                    own, other = (member_parts, query_parts) if not side else (query_parts, member_parts)
                    mine = (h[rows_] % own[at].astype(U64)).astype(np.int64)
                    beside = other[at]
                    rep = np.repeat(np.arange(len(rows_)), beside)
                    else_ = np.arange(len(rep)) - np.repeat(np.cumsum(beside) - beside, beside)
                    m, q = (mine[rep], else_) if not side else (else_, mine[rep])
                    key = (at[rep].astype(np.int64) << 40) | (m << 20) | q
                    order = np.argsort(key, kind="stable")
                    for k, lo, hi in split_runs(key[order]):
                        blocks.setdefault(k, [b"", b""])[side] = data[rows_[rep[order[lo:hi]]]].tobytes()
                yield pa.RecordBatch.from_arrays([pa.array(list(blocks), pa.int64()), pa.array([b[0] for b in blocks.values()], pa.binary()), pa.array([b[1] for b in blocks.values()], pa.binary())], ["block", "members", "queries"])

    def compare(t: pa.Table) -> pa.Table:
        ix = index.value
        ids, weight, members = _unpacked(t.column("members").to_pylist(), width, kind)
        query_ids, _, queries = _unpacked(t.column("queries").to_pylist(), width, kind)
        out: dict[str, list[int]] = {"rep": [], "links": [], "other": []}
        if len(members) and len(queries):
            at = t.column("block")[0].as_py() >> 40
            y = unit(members)
            codes, left = ix.encode(y, np.full(len(y), at))
            tree: dict[int, int] = {}

            def root(v: int) -> int:
                while tree.setdefault(v, v) != v:
                    tree[v] = tree[tree[v]]
                    v = tree[v]
                return v

            def linked(ix: ProductIndex, x: np.ndarray, own: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray]:
                """(which members, of which queries) of the links, by query. Where many are candidates all products are made at once; what they leave is decided pair by pair."""
                near = ix.near(x, at, codes, left)
                if np.count_nonzero(near) * 16 > near.size:
                    near &= y @ x.T >= threshold - 1e-9
                of, which = np.nonzero(near.T)
                links = []
                for i in range(0, len(of), 65_536):
                    k, m = of[i : i + 65_536], which[i : i + 65_536]
                    links.append(np.flatnonzero((np.einsum("ij,ij->i", y[m], x[k]) >= threshold) & (ids[m] != own[k])) + i)
                kept = np.concatenate(links) if links else np.zeros(0, np.int64)
                return which[kept], of[kept]

            step = max(1, 1_000_000 // len(members))
            for i in range(0, len(queries), step):
                own, x = query_ids[i : i + step], unit(queries[i : i + step])
                which, of = linked(ix, x, own, at)
                for k, lo, hi in split_runs(of):
                    who = which[lo:hi]
                    if len(who):
                        a, others = int(own[k]), ids[who].tolist()
                        top = root(a)
                        new = []
                        for b in others:
                            r = root(b)
                            if r != top:
                                tree[r] = top
                                new.append(b)
                        out["rep"] += [a] * max(1, len(new))
                        out["links"] += [int(weight[who].sum())] + [0] * (max(1, len(new)) - 1)
                        out["other"] += new or [a]
        return pa.table([pa.array(out[k], pa.int64()) for k in ("rep", "links", "other")], ["rep", "links", "other"])

    dealt = classes.select("key", "rep", "n").mapInArrow(deal, "block long, members binary, queries binary")
    found = stored(dealt.groupBy("block").applyInArrow(compare, "rep long, links long, other long"), "found")
    parts = connected_components(found.select("rep", "other"))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    named = classes.join(links, "rep", "left").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
    named = stored(named.select("key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")), "named")
    return rows.join(named, "key").select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
