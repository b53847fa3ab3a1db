"""Parameters of the mapping operators. Every constant that changes results is here; presets differ where noted."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class IndexParams:
    """Sampled, frequency-capped index of genome seeds."""

    span: int = 21
    weight: int = 13
    step: int = 9
    min_repeat_gap: int = 10
    cap: int = 400


@dataclass(frozen=True)
class ProbeParams:
    """Read probes: every `alpha`-th position, `alpha_retry` in the second pass."""

    alpha: int = 15
    alpha_retry: int = 7
    min_read: int = 200


@dataclass(frozen=True)
class BinParams:
    """Diagonal binning: a bin is kept when it holds more than `least` anchors."""

    width: int = 30_000
    least: int = 10
    legacy: bool = False  # bins that mix genomes and strands


@dataclass(frozen=True)
class ChainParams:
    depth: int = 20
    dx: int = 300
    best_n: int = 50
    min_len: int = 1
    abort: int = 45
    stop_ratio: float = 0.0
    roots_for_all: int = 50


@dataclass(frozen=True)
class FeatureParams:
    """Composition windows: cells of 16 bases; a script spans three cells."""

    cell: int = 16
    span: int = 48
    window: int = 96
    accept: int = 36
    reject: int = 50
    sup: int = 6
    med: int = 5
    inf: int = 3


@dataclass(frozen=True)
class SamParams:
    line_gap: int = 8000
    large_indel: int = 80
    large_x: int = 200
    mapq: int = 255


@dataclass(frozen=True)
class EngineParams:
    index: IndexParams = field(default_factory=IndexParams)
    probe: ProbeParams = field(default_factory=ProbeParams)
    bins: BinParams = field(default_factory=BinParams)
    chain: ChainParams = field(default_factory=ChainParams)
    feature: FeatureParams = field(default_factory=FeatureParams)
    sam: SamParams = field(default_factory=SamParams)
    gap_len: int = 50


def preset(number: int) -> EngineParams:
    """0: sensitive, 1: default, 2: fast. Presets 1 and 2 don't stop at a ratio to the first chain."""
    if number not in (0, 1, 2):
        raise ValueError("preset is 0, 1 or 2")
    if number == 0:
        return EngineParams(chain=ChainParams(stop_ratio=0.7), sam=SamParams(large_indel=1 << 60, large_x=1 << 60))
    if number == 2:
        return EngineParams(sam=SamParams(large_indel=1 << 60, large_x=1 << 60))
    return EngineParams()


def gap_length(option: int) -> int:
    """0: off; 1: 50; 2 to 9: 10; from 10 on as given."""
    return 0 if option == 0 else 50 if option == 1 else 10 if option < 10 else option
