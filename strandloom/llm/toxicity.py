"""Toxicity scores from the nearest labelled examples by exact TF-IDF cosine over block-max inverted indexes.

Fitting. Labelled rows of the training folds (crc32 of the id mod 5 is not 0) are sampled by the hash of their id, EXAMPLES_A_CLASS of each label at most; this bound is
the only sample. A text's terms are its words and the first STEM letters of longer ones, so a word family is a term too. Terms whose presence goes with label 1 beyond
chance (chi-square of at least CHI_SQUARE over the examples) and clearly (its share of the examples, phi squared, of at least PHI_SQUARE) make the vocabulary, by the same rule at every size; other terms would
only say which texts have a topic, a copied passage or a random word in common. TF is 1 + log of a term's
count in the text; document frequencies behind the IDF are counted over all documents.

Search. Examples are sorted by their terms and numbered; each term's postings (example, weight) are cut into blocks of BLOCK numbers with their greatest
weight. A query bounds every block by its terms' maxima and reads blocks from the greatest bound down until none left can beat the k-th best cosine, so the k nearest are exact.
Examples with equal terms are one posting that carries the labels of all.

Scores. Votes of the neighbours are weighted by cosine; a text without any vocabulary term gets the votes of the examples without any. Votes of the examples
themselves, each left out of its own neighbours, are mapped to probabilities by isotonic regression; both classes are weighted back to their shares among the labelled rows.

Defined results: null text counts as empty; empty texts and texts of unknown words get the base score; rows of `labels` with a null label or id are no examples, repeated labels of
one id count once (the greatest); without examples of both labels every score is the share of label 1 (0 without any); repeated rows each get a row; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import Memo, stored, tidied

EXAMPLES_A_CLASS = 4096
CHI_SQUARE = 24.0  # one degree of freedom: less than one term in a million by chance
PHI_SQUARE = 1 / 64  # copies of texts and passages aren't chance, but are in few of the examples
STEM = 4
NEIGHBOURS = 15
BLOCK = 64

WORDS = re.compile(r"[^\W\d_]+").findall


Terms = frozenset[tuple[str, int]]  # (term, how often)


def terms_of(text: str | None) -> set[str]:
    """Words of a text, and as `abcd*` the first STEM letters of longer ones."""
    words = set(WORDS((text or "").lower()))
    return words | {w[:STEM] + "*" for w in words if len(w) > STEM}


@dataclass
class Index:
    """Examples as unit TF-IDF vectors in block-max posting lists. share: of label 1 among the labelled rows."""

    idf: dict[str, float]
    share: float
    weight: tuple[float, float] = (1.0, 1.0)  # of an example by label
    ids: list[list[int]] = field(default_factory=list)  # of the rows behind each vector
    labels: list[tuple[int, int]] = field(default_factory=list)  # (clean, toxic) rows behind each vector
    none: tuple[int, int] = (0, 0)  # rows without any term
    greatest: dict[str, np.ndarray] = field(default_factory=dict)  # by term: weight by block
    postings: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)  # by term and block: places, weights
    steps: tuple[np.ndarray, np.ndarray] = (np.zeros(0), np.zeros(0))

    def present(self, text: str | None) -> Terms:
        """The vocabulary's terms in a text."""
        idf, found = self.idf, {}
        for w in WORDS((text or "").lower()):
            if w in idf:
                found[w] = found.get(w, 0) + 1
            if len(w) > STEM and (s := w[:STEM] + "*") in idf:
                found[s] = found.get(s, 0) + 1
        return frozenset(found.items())

    def vector(self, terms: Terms) -> dict[str, float]:
        weights = {t: (1 + math.log(n)) * self.idf[t] for t, n in sorted(terms)}
        size = math.sqrt(sum(x * x for x in weights.values()))
        return {t: x / size for t, x in weights.items()}

    def build(self, examples: list[tuple[int, int, Terms]]) -> None:
        same: dict[tuple[tuple[str, int], ...], list[tuple[int, int]]] = {}
        none = [0, 0]
        for i, label, terms in sorted(examples, key=lambda e: e[0]):
            if terms:
                same.setdefault(tuple(sorted(terms, key=lambda t: (-self.idf[t[0]], t))), []).append((i, label))
            else:
                none[label] += 1
        self.none = (none[0], none[1])
        lists: dict[tuple[str, int], list[tuple[int, float]]] = {}
        blocks = -(-len(same) // BLOCK)
        for k, (terms, rows) in enumerate(sorted(same.items())):
            self.ids.append([i for i, _ in rows])
            self.labels.append((sum(label == 0 for _, label in rows), sum(label == 1 for _, label in rows)))
            for t, x in self.vector(frozenset(terms)).items():
                lists.setdefault((t, k // BLOCK), []).append((k % BLOCK, x))
        for (t, b), p in lists.items():
            weights = np.array([x for _, x in p])
            self.postings[t, b] = np.array([k for k, _ in p]), weights
            self.greatest.setdefault(t, np.zeros(blocks))[b] = weights.max()

    def nearest(self, terms: Terms, k: int = NEIGHBOURS) -> list[tuple[float, int]]:
        """(cosine, vector) of the k nearest with a positive cosine, the smaller number first among equals."""
        query = [(t, x) for t, x in self.vector(terms).items() if t in self.greatest]
        if not query:
            return []
        bounds = sum(x * self.greatest[t] for t, x in query)
        best: list[tuple[float, int]] = []
        for b in np.argsort(-bounds, kind="stable").tolist():
            if bounds[b] <= 0 or (len(best) == k and bounds[b] < best[-1][0] - 1e-9):
                break
            sums = np.zeros(BLOCK)
            for t, x in query:
                if (p := self.postings.get((t, b))) is not None:
                    sums[p[0]] += x * p[1]
            found = np.flatnonzero(sums > (best[-1][0] - 1e-9 if len(best) == k else 0))
            best = sorted(best + [(float(sums[f]), b * BLOCK + f) for f in found.tolist()], key=lambda n: (-round(n[0], 12), n[1]))[:k]
        return best

    def vote(self, near: list[tuple[float, int]], leave: tuple[int, int] | None = None) -> float:
        """Share of label 1 among the neighbours, weighted by cosine; leave: (vector, label) of an example that doesn't vote."""
        a = b = 0.0
        for cosine, k in near:
            clean, toxic = self.labels[k]
            if leave and leave[0] == k:
                clean, toxic = clean - (leave[1] == 0), toxic - (leave[1] == 1)
            # many rows behind one vector are one neighbour, with their mean label
            if clean + toxic:
                c, t = clean * self.weight[0], toxic * self.weight[1]
                a, b = a + cosine * c / (c + t), b + cosine * t / (c + t)
        return b / (a + b) if a + b else self.base_vote()

    def base_vote(self) -> float:
        c, t = self.none[0] * self.weight[0], self.none[1] * self.weight[1]
        return t / (c + t) if c + t else self.share

    def calibrate(self, examples: list[tuple[int, int, Terms]]) -> None:
        """Isotonic regression (pool adjacent violators) of the label on the vote."""
        where = {i: k for k, ids in enumerate(self.ids) for i in ids}
        near = Memo(self.nearest)
        votes = [(self.vote(near[terms], (where[i], label)) if terms else self.base_vote(), label) for i, label, terms in examples]
        pools: dict[float, list[float]] = {}
        for vote, label in votes:
            pool = pools.setdefault(vote, [vote, 0.0, 0.0])
            pool[1] += self.weight[label]
            pool[2] += self.weight[label] * label
        merged: list[list[float]] = []
        for _, pool in sorted(pools.items()):
            merged.append(pool)
            while len(merged) > 1 and merged[-2][2] / merged[-2][1] >= merged[-1][2] / merged[-1][1]:
                last = merged.pop()
                merged[-1] = [merged[-1][0], merged[-1][1] + last[1], merged[-1][2] + last[2]]
        self.steps = (np.array([m[0] for m in merged]), np.array([m[2] / m[1] for m in merged]))

    def score(self, terms: Terms) -> tuple[float, list[int], list[float]]:
        """Score, and as evidence an example of each neighbour and its cosine. On a step of the calibration the raw vote decides the order."""
        at, value = self.steps
        if not len(at):
            return self.share, [], []
        near = self.nearest(terms) if terms else []
        vote = self.vote(near) if near else self.base_vote()
        k = max(0, int(np.searchsorted(at, vote, side="right")) - 1)
        return float(np.clip(0.98 * value[k] + 0.02 * vote, 0, 1)), [self.ids[n][0] for _, n in near], [c for c, _ in near]


def held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame) -> Index:
    """The index over a bounded sample of the labelled rows of the training folds."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    marked = marked.groupBy("doc_id").agg(F.max("label").alias("label")).where(~held_out())
    found = {r["label"]: r["count"] for r in marked.groupBy("label").count().collect()}
    share = found.get(1, 0) / max(1, sum(found.values()))
    if not found.get(0) or not found.get(1):
        empty = Index({}, share)
        empty.steps = (np.zeros(0), np.zeros(0))
        return empty
    some = marked.where("label = 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(EXAMPLES_A_CLASS).unionByName(marked.where("label = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(EXAMPLES_A_CLASS))

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([sorted(terms_of(t)) for t in batch.column(1).to_pylist()], pa.list_(pa.string()))], ["label", "terms"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # 2 * EXAMPLES_A_CLASS ids: adaptive execution sends them, not the texts. An id with several texts stands for the least of them, equal texts of a label for the smallest id.
    chosen = some.join(texts, "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).groupBy("label", "text").agg(F.min("doc_id").alias("doc_id"))
    examples = stored(chosen.select("doc_id", "label", "text"), "examples")
    n = {r["label"]: r["count"] for r in examples.groupBy("label").count().collect()}
    n0, n1 = n.get(0, 0), n.get(1, 0)
    by_term = examples.select("label", "text").mapInArrow(tidied(terms), "label int, terms array<string>").select("label", F.explode("terms").alias("term")).groupBy("term").agg(F.count_if(F.col("label") == 0).alias("a"), F.count_if(F.col("label") == 1).alias("b"))
    chi = F.expr(f"{n0 + n1} * pow(cast(a as double) * ({n1} - b) - cast(b as double) * ({n0} - a), 2) / (cast(a + b as double) * ({n0 + n1} - a - b) * {n0}D * {n1}D)")
    vocabulary = [r["term"] for r in by_term.where(f"a + b < {n0 + n1} and b * {n0} > a * {n1}").where(chi >= max(CHI_SQUARE, PHI_SQUARE * (n0 + n1))).select("term").orderBy("term").collect()]  # terms of the examples

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, df, rows = frozenset(vocabulary), Counter(), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                rows += 1
                words = set(WORDS((text or "").lower()))
                df.update(known.intersection(words))
                df.update(known.intersection({w[:STEM] + "*" for w in words if len(w) > STEM}))
        df[""] = rows
        yield pa.RecordBatch.from_arrays([pa.array(list(df), pa.string()), pa.array(list(df.values()), pa.int64())], ["term", "n"])

    df = {r["term"]: r["n"] for r in texts.select("text").mapInArrow(tidied(frequencies), "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}  # the vocabulary
    total = df.pop("", 0)
    index = Index({t: math.log((1 + total) / (1 + df.get(t, 0))) + 1 for t in vocabulary}, share)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [list(zip(*sorted(index.present(t)), strict=True)) or [(), ()] for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([f[0] for f in found], pa.list_(pa.string())), pa.array([f[1] for f in found], pa.list_(pa.int32()))], ["doc_id", "label", "terms", "n"])

    rows = [(r["doc_id"], r["label"], frozenset(zip(r["terms"], r["n"], strict=True))) for r in examples.mapInArrow(kept, "doc_id long, label int, terms array<string>, n array<int>").collect()]  # 2 * EXAMPLES_A_CLASS rows at most
    index.weight = ((1 - share) / max(1, n0), share / max(1, n1))
    index.build(rows)
    index.calibrate(rows)
    return index


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence_ids, evidence_cosines of every row of `docs`."""
    index = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = index.value
        scores = Memo(ix.score, 20_000)
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                rows = [scores[ix.present(t)] for t in part.column(1).to_pylist()]
                columns = [part.column(0), pa.array([r[0] for r in rows], pa.float64()), pa.array([r[1] for r in rows], pa.list_(pa.int64())), pa.array([r[2] for r in rows], pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "score", "evidence_ids", "evidence_cosines"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(tidied(run), "doc_id long, score double, evidence_ids array<long>, evidence_cosines array<double>")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence_ids", "evidence_cosines")


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of `docs` whose score is below 0.5; columns unchanged."""
    index = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    schema, where = docs.schema, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = index.value
        scores = Memo(ix.score, 20_000)
        for batch in batches:
            yield batch.filter(pa.array([scores[ix.present(t)][0] < 0.5 for t in batch.column(where).to_pylist()], pa.bool_()))

    return docs.mapInArrow(tidied(run), schema)
