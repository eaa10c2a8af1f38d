"""Parameters that travel with fingerprints and searches."""

from __future__ import annotations

import random
from dataclasses import dataclass
from functools import lru_cache

#: Signatures are minima of (a h + b) mod PRIME over 31-bit element hashes h.
PRIME = (1 << 31) - 1
#: Stored with fingerprints; a change of the hash family raises it.
FINGERPRINT_VERSION = 1
#: Values within this are the same threshold.
TOLERANCE = 1e-9


@dataclass(frozen=True)
class SearchParams:
    tokenizer: str = "asm"
    ngram: int = 3
    num_perm: int = 128
    threshold: float = 0.5
    top_n: int = 5
    jaccard_weight: float = 0.4
    seed: int = 7

    def __post_init__(self):
        if self.tokenizer not in ("asm", "word"):
            raise ValueError("the tokenizer is asm or word")
        if self.ngram < 1:
            raise ValueError("ngram is at least 1")
        if not 2 <= self.num_perm <= 4096:
            raise ValueError("num_perm lies in 2..4096")
        if not 0 <= self.threshold <= 1:
            raise ValueError("the threshold lies in 0..1")
        if not 0 <= self.jaccard_weight <= 1:
            raise ValueError("the weight lies in 0..1")

    @property
    def bands(self) -> tuple[int, int]:
        """(bands, rows) of the search; a search needs two bands."""
        b, r = banding(self.threshold, self.num_perm)
        if self.threshold >= 0.99 or b < 2:
            raise ValueError(f"a threshold of {self.threshold} leaves fewer than two bands of {self.num_perm} permutations")
        return b, r

    @property
    def fingerprint_key(self) -> dict[str, str]:
        """What fingerprints must agree in to be compared."""
        return {"tokenizer": self.tokenizer, "ngram": str(self.ngram), "num_perm": str(self.num_perm), "seed": str(self.seed), "version": str(FINGERPRINT_VERSION)}


@lru_cache(maxsize=64)
def permutations(num_perm: int, seed: int = 7) -> tuple[tuple[int, ...], tuple[int, ...]]:
    draw = random.Random(seed)
    pairs = [(draw.randrange(1, PRIME), draw.randrange(PRIME)) for _ in range(num_perm)]
    return tuple(a for a, _ in pairs), tuple(b for _, b in pairs)


@lru_cache(maxsize=256)
def banding(threshold: float, num_perm: int, step: float = 1e-3) -> tuple[int, int]:
    """The (bands, rows) with bands x rows <= num_perm of least error: half the area of false positives below the threshold plus half that of
    false negatives above it, by the midpoint rule."""
    below = [(i + 0.5) * threshold / max(1, round(threshold / step)) for i in range(max(1, round(threshold / step)))] if threshold > 0 else []
    above = [threshold + (i + 0.5) * (1 - threshold) / max(1, round((1 - threshold) / step)) for i in range(max(1, round((1 - threshold) / step)))] if threshold < 1 else []
    best = None
    for r in range(1, num_perm + 1):
        low, high = [1 - s**r for s in below], [1 - s**r for s in above]
        for b in range(1, num_perm // r + 1):
            fp = sum(1 - x**b for x in low) * (threshold / len(below)) if below else 0.0
            fn = sum(x**b for x in high) * ((1 - threshold) / len(above)) if above else 0.0
            if best is None or fp + fn < best[0] - 1e-12:
                best = (fp + fn, b, r)
    return best[1], best[2]
