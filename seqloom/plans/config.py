"""Mapping parameters and presets."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from ..operators.pairwise import Scoring


@dataclass(frozen=True)
class MapOptions:
    k: int = 15
    w: int = 10
    hpc: bool = False
    mid_occ_fraction: float = 2e-4
    min_mid_occ: int = 10
    max_mid_occ: int = 1_000_000
    max_occ: int = 4095
    occ_distance: int = 500
    query_occ_fraction: float = 0.01
    max_gap: int = 5000
    bandwidth: int = 500
    bandwidth_long: int = 20_000
    min_cnt: int = 3
    min_chain_score: int = 40
    gap_scale: float = 0.8
    skip_scale: float = 0.0
    mask_level: float = 0.5
    secondary_ratio: float = 0.8
    best_n: int = 5
    min_dp_score: int = 80
    z_drop: tuple[int, int] = (400, 200)
    end_bonus: int = -1
    max_fragment: int = 800
    rmq: bool = False
    inner_distance: int = 1000
    strand: str = "both"
    max_query_length: int = 0
    max_clip: float = 1.0
    splice: bool = False
    short_reads: bool = False
    all_chains: bool = False
    no_diagonal: bool = False
    no_dual: bool = False
    junction_bonus: int = 0
    noncanonical: int = 0
    scoring: Scoring = field(default_factory=Scoring)

    @property
    def gap_penalty(self) -> float:
        return self.gap_scale * 0.01 * self.k

    @property
    def skip_penalty(self) -> float:
        return self.skip_scale * 0.01 * self.k


_BASE = MapOptions()
_LONG = replace(_BASE, k=19, w=19, max_gap=10_000, min_mid_occ=50, max_mid_occ=500)
_HIFI = Scoring(1, 4, 1, 6, 2, 26, 1)
_ASM = replace(_BASE, k=19, w=19, rmq=True, bandwidth=1000, bandwidth_long=100_000, max_gap=10_000, min_mid_occ=50, max_mid_occ=500, min_dp_score=200, best_n=50, z_drop=(200, 200))
_SPLICE = replace(_BASE, k=15, w=5, splice=True, max_gap=2000, bandwidth=200_000, bandwidth_long=200_000, z_drop=(200, 100), noncanonical=9, junction_bonus=9, scoring=Scoring(1, 2, 1, 2, 1, 32, 0))
_AVA = replace(_BASE, k=15, w=5, all_chains=True, no_diagonal=True, no_dual=True, min_chain_score=100, secondary_ratio=0.0, bandwidth=2000, bandwidth_long=2000, occ_distance=0)

PRESETS: dict[str, MapOptions] = {
    "map-ont": _BASE,
    "map-pb": replace(_BASE, k=19, hpc=True),
    "lr:hq": _LONG,
    "map-hifi": replace(_LONG, min_dp_score=200, scoring=_HIFI),
    "lr:hqae": replace(_LONG, k=25, w=51, rmq=True, max_gap=5000, occ_distance=200, best_n=100, gap_scale=5.0),
    "map-iclr-prerender": replace(_BASE, scoring=Scoring(2, 6, 1, 10, 2, 50, 1)),
    "map-iclr": replace(_BASE, k=19, scoring=Scoring(2, 6, 1, 10, 2, 50, 1)),
    "asm5": replace(_ASM, scoring=Scoring(1, 19, 1, 39, 3, 81, 1)),
    "asm10": replace(_ASM, scoring=Scoring(1, 9, 1, 16, 2, 41, 1)),
    "asm20": replace(_ASM, w=10, scoring=_HIFI),
    "sr": replace(_BASE, k=21, w=11, short_reads=True, max_gap=100, bandwidth=100, bandwidth_long=100, secondary_ratio=0.5, min_cnt=2, min_chain_score=25, min_dp_score=40, best_n=20, min_mid_occ=1000, max_occ=5000, z_drop=(100, 100), end_bonus=10, scoring=Scoring(2, 8, 1, 12, 2, 24, 1)),
    "splice": _SPLICE,
    "splice:hq": replace(_SPLICE, noncanonical=5, scoring=Scoring(1, 4, 1, 6, 1, 24, 0)),
    "splice:sr": replace(_SPLICE, noncanonical=5, short_reads=True, min_chain_score=25, min_dp_score=40, best_n=10, scoring=Scoring(1, 4, 1, 6, 1, 24, 0)),
    "ava-ont": _AVA,
    "ava-pb": replace(_AVA, k=19, hpc=True, bandwidth=500, bandwidth_long=500),
}
ALIASES = {"lr": "map-ont", "map10k": "map-pb", "map-ccs": "map-hifi", "short": "sr", "cdna": "splice"}


def preset(name: str) -> MapOptions:
    found = PRESETS.get(ALIASES.get(name, name))
    if found is None:
        raise ValueError(f"unknown preset {name!r}; there are {', '.join([*PRESETS, *ALIASES])}")
    return found


def parse_size(text: str) -> int:
    """A number with a decimal suffix K, M or G."""
    units = {"k": 10**3, "m": 10**6, "g": 10**9}
    unit = units.get(text[-1:].lower())
    return int(float(text[:-1]) * unit + 0.499) if unit else int(float(text) + 0.499)
