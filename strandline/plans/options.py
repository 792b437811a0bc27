"""Index and mapping options, presets and their validation."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, replace

from ..operators.alignment import Scoring
from ..operators.chaining import ChainOptions


@dataclass(frozen=True)
class Options:
    k: int = 15
    w: int = 10
    compressed: bool = False
    min_cnt: int = 3
    min_chain_score: int = 40
    bw: int = 500
    bw_long: int = 20000
    max_gap: int = 5000
    max_gap_ref: int = -1
    max_frag_len: int = 0
    mid_occ_fraction: float = 2e-4
    min_mid_occ: int = 10
    max_mid_occ: int = 1_000_000
    mid_occ: int = 0
    q_occ_fraction: float = 0.01
    max_occ: int = 0
    max_max_occ: int = 4095
    occ_dist: int = 500
    mask_level: float = 0.5
    pri_ratio: float = 0.8
    best_n: int = 5
    alt_drop: float = 0.15
    max_clip: float = 1.0
    pair_bonus: int = 33
    match: int = 2
    mismatch: int = 4
    transition: int = 0
    ambiguous: int = 1
    gap_open: int = 4
    gap_extend: int = 2
    gap_open2: int = 24
    gap_extend2: int = 1
    zdrop: int = 400
    zdrop_inv: int = 200
    min_dp_max: int = 80
    end_bonus: int = -1
    chain_gap_scale: float = 0.8
    chain_skip_scale: float = 0.0
    noncanonical: int = 0
    junction_bonus: int = 0
    junction_penalty: int = 0
    jump_min_match: int = 3
    plain_sites: bool = False
    rmq: bool = False
    short_reads: bool = False
    fragments: bool = False
    spliced: bool = False
    all_chains: bool = False
    no_diagonal: bool = False
    no_dual: bool = False
    no_long_join: bool = False
    no_secondary: bool = False
    forward_only: bool = False
    reverse_only: bool = False
    query_strand: bool = False
    output_sam: bool = False
    output_tags: bool = False
    split_index: bool = False
    dust: int = 0

    def __post_init__(self):
        rules = (
            (self.bw > self.bw_long, "the band may not be wider than the long-join band"),
            (self.rmq and (self.short_reads or self.spliced), "range-maximum chaining is not for short or spliced reads"),
            (self.split_index and self.output_tags, "difference tags need the whole index"),
            (self.k <= 0 or self.w <= 0, "k and w must be positive"),
            (self.best_n < 0, "best_n may not be negative"),
            (not 0 <= self.pri_ratio <= 1, "pri_ratio must be within 0 and 1"),
            (self.forward_only and self.reverse_only, "forward_only and reverse_only exclude each other"),
            (self.gap_extend <= 0 or self.gap_open <= 0, "gap costs must be positive"),
            ((self.gap_open, self.gap_extend) != (self.gap_open2, self.gap_extend2) and not (self.gap_extend > self.gap_extend2 and self.gap_open + self.gap_extend < self.gap_open2 + self.gap_extend2),
             "the second gap cost must open dearer and extend cheaper"),
            (self.gap_open + self.gap_extend + self.gap_open2 + self.gap_extend2 > 127, "gap costs may add up to 127 at most"),
            (not 0 <= self.ambiguous < self.mismatch, "the cost of ambiguous letters must be from 0 to below that of a mismatch"),
            (self.zdrop < self.zdrop_inv, "zdrop may not be less than zdrop_inv"),
            (self.no_secondary and self.all_chains, "all_chains and no_secondary exclude each other"),
            (self.query_strand and (self.output_sam or self.spliced or self.fragments or self.compressed), "query_strand is not for SAM, splicing, fragments or compressed seeds"),
        )
        for wrong, why in rules:
            if wrong:
                raise ValueError(why)
        if self.best_n == 0:
            warnings.warn("best_n = 0 makes mapping less accurate; use no_secondary", stacklevel=2)

    def scoring(self) -> Scoring:
        return Scoring(self.match, self.mismatch, self.ambiguous, self.transition, self.gap_open, self.gap_extend, self.gap_open2, self.gap_extend2, self.noncanonical)

    def chaining(self) -> ChainOptions:
        return ChainOptions(self.max_gap_ref if self.max_gap_ref > 0 else self.max_gap, self.max_gap, self.bw, 5000, self.min_cnt, self.min_chain_score,
                            self.chain_gap_scale * 0.01 * self.k, self.chain_skip_scale * 0.01 * self.k, self.spliced, self.bw)


_AVA = dict(all_chains=True, no_diagonal=True, no_dual=True, no_long_join=True, min_chain_score=100, pri_ratio=0.0, occ_dist=0)
_HQ = dict(k=19, w=19, max_gap=10000, min_mid_occ=50, max_mid_occ=500)
_ASM = dict(_HQ, bw=1000, bw_long=100000, rmq=True, min_dp_max=200, best_n=50, match=1, gap_extend2=1, zdrop=200, zdrop_inv=200)
_SPLICE = dict(k=15, w=5, spliced=True, max_gap=2000, max_gap_ref=200000, bw=200000, bw_long=200000, match=1, mismatch=2, gap_open=2, gap_extend=1, gap_open2=32, gap_extend2=0,
               noncanonical=9, junction_bonus=9, junction_penalty=5, zdrop=200, zdrop_inv=100)
_SPLICE_HQ = dict(_SPLICE, noncanonical=5, mismatch=4, gap_open=6, gap_open2=24)
_HIFI = dict(_HQ, match=1, mismatch=4, gap_open=6, gap_open2=26, gap_extend=2, gap_extend2=1, min_dp_max=200)
_SHORT = dict(k=21, w=11, short_reads=True, fragments=True, no_secondary=True, match=2, mismatch=8, gap_open=12, gap_extend=2, gap_open2=24, gap_extend2=1, zdrop=100, zdrop_inv=100, end_bonus=10,
              max_frag_len=800, max_gap=100, bw=100, bw_long=100, pri_ratio=0.5, min_cnt=2, min_chain_score=25, min_dp_max=40, best_n=20, mid_occ=1000, max_occ=5000)

#: What each preset changes of the defaults.
PRESETS: dict[str, dict] = {
    "lr": {}, "map-ont": {},
    "ava-ont": dict(_AVA, k=15, w=5, bw=2000, bw_long=2000),
    "map10k": dict(k=19, compressed=True), "map-pb": dict(k=19, compressed=True),
    "ava-pb": dict(_AVA, k=19, w=5, compressed=True, bw_long=500),
    "lr:hq": _HQ, "map-hifi": _HIFI, "map-ccs": _HIFI,
    "lr:hqae": dict(k=25, w=51, rmq=True, min_mid_occ=50, max_mid_occ=500, occ_dist=200, best_n=100, chain_gap_scale=5.0),
    "map-iclr-prerender": dict(k=15, mismatch=6, transition=1, gap_open=10, gap_open2=50),
    "map-iclr": dict(k=19, mismatch=6, transition=4, gap_open=10, gap_open2=50),
    "asm5": dict(_ASM, mismatch=19, gap_open=39, gap_open2=81, gap_extend=3),
    "asm10": dict(_ASM, mismatch=9, gap_open=16, gap_open2=41, gap_extend=2),
    "asm20": dict(_ASM, mismatch=4, gap_open=6, gap_open2=26, gap_extend=2, w=10),
    "sr": _SHORT, "short": _SHORT,
    "splice": _SPLICE, "cdna": _SPLICE, "splice:hq": _SPLICE_HQ,
    "splice:sr": dict(_SPLICE_HQ, no_secondary=True, fragments=True, min_chain_score=25, min_dp_max=40, best_n=10),
}


def preset(name: str | None = None, **changes) -> Options:
    """A preset's options; explicit changes win over it."""
    if name is not None and name not in PRESETS:
        raise ValueError(f"no preset {name}")
    return Options(**{**(PRESETS[name] if name else {}), **changes})


def with_max_intron(o: Options, size: int) -> Options:
    """The longest intron is the reach of chains of spliced reads."""
    return replace(o, max_gap_ref=size, bw=size, bw_long=size) if o.spliced and size > 0 else o
