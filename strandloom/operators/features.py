"""Composition features of sequence cells, and distances of windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.config import FeatureParams
from strandloom.functions import sequences as S
from strandloom.operators.seeds import spread

DIMERS = [a + b for a in S.BASES for b in S.BASES if a + b != "TT"]
PIECE = 1 << 17  # bases at a time

_ORDINAL = np.full(256, -1, np.int64)
_ORDINAL[np.frombuffer(S.BASES.encode(), np.uint8)] = np.arange(4)


def window_counts(codes: np.ndarray, length: int, kinds: int, span: int, cell: int, beyond: int) -> np.ndarray:
    """Counts (windows x kinds) of codes from 0 to `kinds` (which isn't counted) in windows of `span` bases, one a cell, of a sequence of `length`.

    Codes are counted by cell, and cells added up; `beyond` codes at a window's end reach out of it and are taken off.
    """
    windows = max(0, (length - span) // cell + 1)
    if not windows:
        return np.zeros((0, kinds), np.int64)
    cells = windows - 1 + span // cell
    near = codes[: cells * cell]
    by_cell = np.bincount(np.arange(len(near)) // cell * (kinds + 1) + near, minlength=cells * (kinds + 1)).reshape(-1, kinds + 1)
    out = sum(by_cell[i : i + windows] for i in range(span // cell))
    for k in range(1, beyond + 1):
        at = np.arange(windows) * cell + span - k
        inside = at < len(codes)
        out[np.flatnonzero(inside), codes[at[inside]]] -= 1
    return out[:, :kinds]


def dimer_counts(seq: bytes, span: int = 48, cell: int = 16) -> np.ndarray:
    """Two-mers (all but TT; none with other letters) of every window."""
    base = _ORDINAL[np.frombuffer(seq, np.uint8)]
    pairs = np.where((base[:-1] >= 0) & (base[1:] >= 0), base[:-1] * 4 + base[1:], 15)
    return window_counts(pairs, len(seq), 15, span, cell, 1)


def monomer_counts(seq: bytes, span: int = 32, cell: int = 16) -> np.ndarray:
    """A, C and G of every window."""
    base = _ORDINAL[np.frombuffer(seq, np.uint8)]
    return window_counts(np.where(base < 0, 3, base), len(seq), 3, span, cell, 0)


def _features(seqs: DataFrame, seq_id: str, span: int, cell: int, counts) -> DataFrame:
    """An Arrow kernel: as many built-in expressions as kinds would each read every window anew. Long sequences are read in pieces that overlap by a window."""
    step = PIECE // cell * cell

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, seq in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for begin in range(0, max(1, len(seq or b"") - span + 1), step):
                    found = counts((seq or b"")[begin : begin + step + span - cell], span, cell)
                    n, kinds = found.shape
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * kinds + 1, kinds, dtype=np.int32)), pa.array(found.ravel().astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, i, np.int64)), pa.array((np.arange(n) + begin // cell).astype(np.int32)), lists], ["seq_id", "cell", "counts"])

    return spread(seqs.select(F.col(seq_id).cast("long").alias("seq_id"), F.col("seq").cast("binary").alias("b"))).mapInArrow(run, "seq_id long, cell int, counts array<int>")


def dimer_features(seqs: DataFrame, seq_id: str, params: FeatureParams = FeatureParams()) -> DataFrame:
    """seq_id, cell, counts (15 two-mers, all but TT) of every `span` bases, one window a cell; windows that run over the end are left out."""
    return _features(seqs, seq_id, params.span, params.cell, dimer_counts)


def monomer_features(seqs: DataFrame, seq_id: str, span: int = 32, cell: int = 16) -> DataFrame:
    """seq_id, cell, counts of A, C, G of every `span` bases."""
    return _features(seqs, seq_id, span, cell, monomer_counts)


def distance(a: Column, b: Column) -> Column:
    """Sum of absolute differences of two count arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0), lambda s, x: s + x)


def step_distances(features: DataFrame, step: int = 6, params: FeatureParams = FeatureParams()) -> DataFrame:
    """seq_id, cell, dist of each window to the one `step` cells on in its sequence: one ordered pass, no join."""
    apart = params.span // params.cell
    by = Window.partitionBy("seq_id").orderBy("cell")
    rows = features.select("seq_id", "cell", F.col("counts").alias("a1"), *[F.lead("counts", n).over(by).alias(c) for c, n in (("a2", apart), ("b1", step), ("b2", step + apart))])
    dist = distance(F.col("a1"), F.col("b1")) + distance(F.col("a2"), F.col("b2"))
    return rows.where("b2 is not null").select("seq_id", "cell", dist.alias("dist"))


def window_distances(left: DataFrame, right: DataFrame, pairs: DataFrame, params: FeatureParams = FeatureParams()) -> DataFrame:
    """Adds dist to pairs (left_id, left_cell, right_id, right_cell): over two scripts that don't overlap, window / 2 bases apart."""
    apart = params.span // params.cell
    script = lambda df, side: df.select(F.col("seq_id").alias(f"{side}_id"), F.col("cell").alias(f"{side}_cell"), F.col("counts").alias(f"{side}_1"), F.lead("counts", apart).over(Window.partitionBy("seq_id").orderBy("cell")).alias(f"{side}_2"))
    joined = pairs.join(script(left, "left"), ["left_id", "left_cell"]).join(script(right, "right"), ["right_id", "right_cell"])
    dist = distance(F.col("left_1"), F.col("right_1")) + distance(F.col("left_2"), F.col("right_2"))
    return joined.where("left_2 is not null and right_2 is not null").select("left_id", "left_cell", "right_id", "right_cell", dist.alias("dist"))
