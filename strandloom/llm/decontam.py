"""Benchmark decontamination by latent semantic retrieval.

1. Terms of the benchmark make the vocabulary; their document frequencies over all documents give the IDF.
2. Documents are read as overlapping passages of a few lengths, so that whatever may repeat an item lies whole in some passage. A
   repeat must hold SHARE of its item's weight (squared IDF of its words) in order, within the item's span; so a passage with no stretch of that span whose
   terms weigh as much as the lightest such item needs can hold none. Nor can one without any key term: an item's keys are its heaviest
   words, so many that without them less than SHARE is left. The other passages are stored as sequences of term numbers.
3. A randomised SVD of the TF-IDF rows of the items and of all stored passages: every task adds up a (a Omega) over its rows, Spark sums
   the products, the driver keeps an orthonormal basis (terms x RANK) and repeats this POWER times; a last sum gives the singular values.
4. Each passage is compared with all items of its length by cosine in the latent space; pairs of at least COSINE are checked: the longest common
   subsequence by weight (SHARE of the item) and by words (WORD_SHARE), and, below SURE, the item's answer (column `answer`, or its last
   sentence) must be there in order as well (ANSWER_SHARE of its weight).

Benchmarks are taken in blocks of ITEMS items and ITEM_BYTES of text at most (or one longer item), so the vocabulary and the basis are bounded; documents never are.

Defined results: null or wordless texts and items match nothing; repeated items are items of their own if their ids differ, repeated rows of one doc_id one document; empty
tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import stored, tidied

ITEMS, ITEM_BYTES = 5_000, 8 << 20
RANK, POWER, SEED = 96, 2, 20240101
COSINE = 0.25
SHARE, WORD_SHARE, SURE, ANSWER_SHARE = 0.6, 0.5, 0.8, 0.5
STRETCH = 1.25  # words that a repeat may span, by its item's words
SMALLEST = 20  # span of the shortest passages; others double

WORDS = re.compile(r"[^\W_]+").findall
SENTENCES = re.compile(r"[.!?\n]+")


def words(text: str | None) -> list[str]:
    return WORDS((text or "").lower())


@dataclass
class Items:
    ids: list[int]
    terms: dict[str, int]
    sequences: list[list[int]]
    answers: list[list[int]]
    spans: list[int]
    idf: np.ndarray | None = None
    weight: np.ndarray | None = None
    basis: np.ndarray | None = None
    latent: np.ndarray | None = None
    least: dict[int, float] | None = None
    keys: dict[int, np.ndarray] | None = None  # by span: 1 for key terms

    @classmethod
    def of(cls, rows: list) -> Items:
        terms: dict[str, int] = {}
        out = cls([], terms, [], [], [])
        for item_id, text, answer in rows:
            own = words(text)
            if not own:
                continue
            number = lambda ws: [terms.setdefault(w, len(terms)) for w in ws]
            last = [s for s in SENTENCES.split(text) if words(s)][-1]
            out.ids.append(item_id)
            out.sequences.append(number(own))
            out.answers.append(number(words(answer) or words(last)))
            span = SMALLEST
            while span < len(own) * STRETCH:
                span *= 2
            out.spans.append(span)
        return out

    def weigh(self, frequency: dict[str, int], documents: int) -> None:
        self.idf = np.array([math.log((1 + documents) / (1 + min(documents, frequency.get(t, 0)))) + 1e-3 for t in self.terms])
        self.weight = self.idf**2
        self.least, self.keys = {}, {}
        for s, span in zip(self.sequences, self.spans, strict=True):
            terms, n = np.unique(s, return_counts=True)
            w = n * self.weight[terms]
            order = np.argsort(-w, kind="stable")
            left = w.sum() - np.cumsum(w[order])  # what the others weigh together
            keys = self.keys.setdefault(span, np.zeros(len(self.terms) + 1, np.int32))
            keys[terms[order[: int(np.argmax(left < (SHARE - 1e-9) * w.sum())) + 1]]] = 1
            self.least[span] = min(self.least.get(span, math.inf), SHARE * float(self.weight[s].sum()))

    def row(self, sequence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Terms and unit TF-IDF weights of a sequence of term numbers (-1: other words)."""
        terms, n = np.unique(sequence[sequence >= 0], return_counts=True)
        w = (1 + np.log(n)) * self.idf[terms]
        return terms, w / (np.sqrt((w * w).sum()) or 1)

    def project(self, sequence: np.ndarray) -> np.ndarray:
        terms, w = self.row(sequence)
        x = w @ self.basis[terms]
        return x / (np.sqrt((x * x).sum()) or 1)


def common_subsequence(a: list[int], b: list[int], weight: np.ndarray) -> tuple[float, int]:
    """Greatest weight of a common subsequence of a and b, and the words of one that has it. a: without -1."""
    best, n = np.zeros(len(a) + 1), np.zeros(len(a) + 1, np.int64)
    where: dict[int, list[int]] = {}
    for i, t in enumerate(a):
        where.setdefault(t, []).append(i)
    for t in b:
        for i in reversed(where.get(t, ())):  # best[i + 1]: of subsequences that end at a[i] or before, as a running maximum
            value = best[i] + weight[t]
            if value > best[i + 1] + 1e-12:
                more = np.flatnonzero(best[i + 1 :] < value)
                best[i + 1 + more], n[i + 1 + more] = value, n[i] + 1
    return float(best[-1]), int(n[-1])


def _frequencies(terms: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, df, rows = frozenset(terms), Counter(), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                rows += 1
                df.update(known.intersection(words(text)))
        df[""] = rows
        yield pa.RecordBatch.from_arrays([pa.array(list(df), pa.string()), pa.array(list(df.values()), pa.int64())], ["term", "n"])

    return run


def _passages(items):
    """doc_id, span, first word, term numbers of passages that can hold a repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = items.value
        get, weight = own.terms.get, np.append(own.weight, 0.0)  # -1: nothing
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                lists = [words(t) for t in part.column(1).to_pylist()]
                n = np.array(list(map(len, lists)), np.int64)
                ids = np.fromiter((k for ws in lists for k in map(get, ws, repeat(-1))), np.int32, int(n.sum()))
                sums = np.concatenate([[0.0], np.cumsum(weight[ids])])
                begin = np.cumsum(n) - n
                doc_ids = part.column(0).to_pylist()
                rows: list[tuple] = []
                ends = begin + n
                doc_of = np.repeat(np.arange(len(n)), n)
                for span, least in own.least.items():
                    # heavy[i]: how many stretches of `span` words that weigh enough begin before word i
                    stop = np.minimum(np.arange(len(ids)) + span, ends[doc_of])
                    keyed = np.concatenate([[0], np.cumsum(own.keys[span][ids])])
                    heavy = np.concatenate([[0], np.cumsum((sums[stop] - sums[:-1] >= least - 1e-6) & (keyed[stop] > keyed[:-1]))])
                    if not heavy[-1]:
                        continue
                    per = np.where(n > 0, np.maximum(1, -(-(n - span) // span)), 0)
                    doc = np.repeat(np.arange(len(n)), per)
                    first = (np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)) * span
                    lo = begin[doc] + first
                    hi = np.minimum(lo + 2 * span, begin[doc] + n[doc])
                    for k in np.flatnonzero(heavy[np.maximum(hi - span + 1, lo + 1)] > heavy[lo]).tolist():
                        rows.append((doc_ids[doc[k]], span, int(first[k]), ids[lo[k] : hi[k]].tobytes()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.binary()), strict=True)], ["doc_id", "span", "first", "terms"])

    return run


def _products(items, omega):
    """Blocks of the sum of a (a omega) over a task's passages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, start = items.value, omega.value
        out = np.zeros_like(start)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                terms, w = own.row(np.frombuffer(x, np.int32))
                out[terms] += w[:, None] * (w @ start[terms])[None]
        for i in range(0, len(out), 256):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([out[i : i + 256].tobytes()], pa.binary())], ["at", "block"])

    return run


def _added(t: pa.Table) -> pa.Table:
    total = None
    for x in t.column("block").to_pylist():
        part = np.frombuffer(x, np.float64)
        total = part.copy() if total is None else total + part
    return pa.table([t.column("at").slice(0, 1), pa.array([total.tobytes()], pa.binary())], ["at", "block"])


def fit_basis(items: Items, passages: DataFrame) -> None:
    """RANK right singular vectors of the TF-IDF rows of passages and items, by a randomised range finder."""
    sc = passages.sparkSession.sparkContext
    rank = min(RANK, len(items.terms))
    basis = np.random.default_rng(SEED).standard_normal((len(items.terms), rank))
    for _ in range(POWER + 1):
        basis, _ = np.linalg.qr(basis)
        shared = (sc.broadcast(items), sc.broadcast(basis))
        product = np.zeros_like(basis)
        for at, block in passages.select("terms").mapInArrow(_products(*shared), "at int, block binary").groupBy("at").applyInArrow(_added, "at int, block binary").collect():  # terms x RANK numbers
            part = np.frombuffer(block, np.float64).reshape(-1, rank)
            product[at : at + len(part)] = part
        for s in items.sequences:
            terms, w = items.row(np.array(s))
            product[terms] += w[:, None] * (w @ basis[terms])[None]
        inner = basis.T @ product  # of the basis with which the product was made
        last, basis = basis, product
    values, turn = np.linalg.eigh((inner + inner.T) / 2)
    items.basis = last @ turn[:, ::-1]
    items.latent = np.array([items.project(np.array(s)) for s in items.sequences])


def _checked(items):
    """doc_id, item_id, first, cosine, share, word_share of the repeats in each passage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = items.value
        spans = np.array(own.spans)
        by_span = {s: np.flatnonzero(spans == s) for s in set(own.spans)}
        total = [float(own.weight[s].sum()) for s in own.sequences]
        for batch in batches:
            rows = []
            for doc_id, span, first, terms in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sequence = np.frombuffer(terms, np.int32)
                among = by_span[span]
                cosines = own.latent[among] @ own.project(sequence)
                passage = sequence.tolist()
                have = set(passage)
                for k in np.flatnonzero(cosines >= COSINE).tolist():
                    item = int(among[k])
                    s = own.sequences[item]
                    if sum(t in have for t in s) < WORD_SHARE * len(s):
                        continue
                    weight, n = common_subsequence(s, passage, own.weight)
                    share = weight / total[item]
                    if share < SHARE or n < WORD_SHARE * len(s):
                        continue
                    if share < SURE:
                        answer = own.answers[item]
                        if common_subsequence(answer, passage, own.weight)[0] < ANSWER_SHARE * float(own.weight[answer].sum()):
                            continue
                    rows.append((doc_id, own.ids[item], first, float(cosines[k]), share, n / len(s)))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "item_id", "first", "cosine", "share", "word_share"])

    return run


FOUND = "doc_id long, item_id long, first long, cosine double, share double, word_share double"


def repeats(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, first_word, cosine, share, word_share: a row for each document and item that it repeats (its best passage)."""
    spark = docs.sparkSession
    answer = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"), answer.alias("answer")).where("text is not null")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = spark.createDataFrame([], FOUND)
    block: list = []
    size = 0
    for row in rows.orderBy("item_id", "text").toLocalIterator():
        more = len((row["text"] + (row["answer"] or "")).encode("utf-8", "replace"))
        if block and (len(block) == ITEMS or size + more > ITEM_BYTES):
            found = found.unionByName(_block(texts, block))
            block, size = [], 0
        block.append(tuple(row))
        size += more
    if block:
        found = found.unionByName(_block(texts, block))
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("share", "cosine", (-F.col("first")).alias("back"), "word_share")).alias("best"))
    return best.select("doc_id", "item_id", (-F.col("best.back")).alias("first_word"), "best.cosine", "best.share", "best.word_share")


def _block(texts: DataFrame, rows: list) -> DataFrame:
    spark = texts.sparkSession
    items = Items.of(rows)
    if not items.ids:
        return spark.createDataFrame([], FOUND)
    df = {r["term"]: r["n"] for r in texts.select("text").mapInArrow(tidied(_frequencies(items.terms)), "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}  # the block's terms
    items.weigh(df, df.pop("", 0))
    found = stored(texts.mapInArrow(tidied(_passages(spark.sparkContext.broadcast(items))), "doc_id long, span int, first long, terms binary"), "passages")
    fit_basis(items, found)
    return found.mapInArrow(tidied(_checked(spark.sparkContext.broadcast(items))), FOUND)


def without_repeats(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of `docs` that repeat no benchmark item; columns unchanged. Rows with a null doc_id stay."""
    hits = repeats(docs, benchmark).select("doc_id").distinct()
    return docs.join(hits, "doc_id", "left_anti").select(*docs.columns)
