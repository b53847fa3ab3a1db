"""Scores of pairs of anchors and blocks, and the class of a variant between blocks. Integer arithmetic, division truncates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

REJECT = -10_000


def div(a: Column, b: int | Column) -> Column:
    """Division that truncates towards 0."""
    q = a / b
    return F.when(q >= 0, F.floor(q)).otherwise(F.ceil(q)).cast("long")


def anchor_score(dx: Column, dy: Column) -> Column:
    """Score of two anchors of a chain; dx, dy: steps from the later to the earlier."""
    da = F.abs(dx - dy)
    derr = div(100 * da, F.greatest(F.abs(dx), F.abs(dy), F.lit(50)))
    s_derr = F.when(derr < 5, 4 * derr).when(derr < 10, 6 * derr - 10).when(derr < 100, derr * derr - 5 * derr).otherwise(1000)
    d = div(dy, 15)
    s_dy = F.when(d < 150, div(d, 5)).when(d < 10_000, div(d * d, 200) + 20).otherwise(10_000)
    return F.when(dy < 10, REJECT).when(da < 10, 100 - s_dy).otherwise(100 - s_dy - s_derr).cast("long")


def anchor_score_retry(dx: Column, dy: Column) -> Column:
    da = F.abs(dx - dy)
    return F.when(dy < 5, REJECT).when(da >= 30, 100 - dy - da).otherwise(100 - dy).cast("long")


def block_score(dx: Column, dy: Column, same_strand: Column) -> Column:
    """Score of two blocks of hits: insertions, deletions, or a plain step."""
    da = F.abs(dx - dy)
    derr = div(100 * da, F.greatest(dx, dy, F.lit(1)))
    indel = (da > 100) | (derr > 50)
    score = F.when(indel & (dy > dx), 70 - div(dy, 1000) - div(dx, 100)).when(indel, 70 - div(dy, 100) - div(dx, 1000)).otherwise(100 - div(dy, 95))
    return F.when((dx < 0) | (dy < 0) | ~same_strand | (dx > 20_000) | (dy > 20_000), REJECT).otherwise(score).cast("long")


def variant_class(dx: Column, dy: Column, same_strand: Column) -> Column:
    """inv, ins, dup, del or normal, of two consecutive blocks."""
    a = dx - dy
    return (
        F.when(~same_strand, "inv")
        .when((a < -F.greatest(F.abs(dx) / 4, F.lit(50.0))) & (dx > -50), "ins")
        .when((a < -F.greatest(F.abs(dx) / 4, F.lit(50.0))) & (dx <= -50), "dup")
        .when(a > F.greatest(dy / 4, F.lit(50.0)), "del")
        .otherwise("normal")
    )


def _step(v: Column) -> Column:
    return F.when(v > 300, div(v, 4) - 25).otherwise(div(v, 6))


def gap_anchor_score(dx: Column, dy: Column, same_strand: Column) -> Column:
    da = F.abs(dx - dy)
    e = div(100 * da, F.greatest(dy, F.lit(50)))
    s_e = F.when(e < 10, 0).when(e < 15, 10 + 2 * e).otherwise(div(e * e, 10) + 40)
    d = F.when(dy < 100, div(dy, 4)).when(dy < 200, div(dy, 3) - 9).otherwise(dy - 145)
    return F.when((dy < 0) | ~same_strand | ((F.abs(dx) < 8) & (dx != dy)), REJECT).otherwise(100 - d - s_e).cast("long")


def gap_anchor_score_2(dx: Column, dy: Column, same_strand: Column) -> Column:
    da = F.abs(dx - dy)
    e = div(100 * da, F.greatest(dx, dy, F.lit(50)))
    s_e = F.when(e < 5, 4 * e).when(e < 10, 6 * e - 10).otherwise(e * e - 5 * e)
    return F.when((dy < 0) | ~same_strand | ((F.abs(dy) < 8) & (dx != dy)), REJECT).otherwise(100 - div(dy * (dy + 300), 300) - s_e).cast("long")


def gap_block_score(dx: Column, dy: Column, same_strand: Column) -> Column:
    kind = variant_class(dx, dy, same_strand)
    score = F.when(kind == "inv", 80 - _step(dy)).when(kind == "ins", 80 - _step(dx)).when(kind == "dup", 40 - _step(dy)).when(kind == "del", 80 - _step(dy)).otherwise(100 - _step(dy))
    return F.when((dx < -40) | (dy < -40), REJECT).otherwise(score).cast("long")


def gap_block_score_2(dx: Column, dy: Column, same_strand: Column) -> Column:
    """`da` is signed here, so every insertion has a small r."""
    r = div(100 * F.abs(dx - dy), F.greatest(dx, dy, F.lit(100)))
    da = dx - dy
    s_r = F.when(100 * da < 15 * F.greatest(dx, dy, F.lit(100)), div(r * (r + 20), 40)).when(100 * da < 30 * F.greatest(dx, dy, F.lit(100)), div(r * (r + 50), 45)).otherwise(div(r * (r + 100), 45))
    m = F.greatest(dx, dy)
    return F.when((dx < 0) | (dy < 0), REJECT).when(~same_strand, 20 - _step(dy)).otherwise(100 - s_r - div(m * (m + 450), 2000)).cast("long")


def clip_score(dx: Column, dy: Column, same_strand: Column) -> Column:
    da = F.abs(dx - dy)
    a = F.when(da == 0, 0).when(da < 2, 30 + 5 * da).when(da < 5, 36 + 2 * da).otherwise(41 + da)
    bad = (dy <= 0) | ~same_strand | (((F.abs(dx) < 3) | (F.abs(dy) < 3)) & (dx != dy))
    return F.when(bad, REJECT).otherwise(100 - a - div(dy * (12 * dy + 650), 450)).cast("long")


def variant_probability(kind: Column) -> Column:
    return F.when(kind == "inv", 0.5).when(kind == "ins", 0.5).when(kind == "dup", 0.25).when(kind == "del", 0.5).otherwise(1.0)
