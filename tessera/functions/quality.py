"""Quality scales and quantisation rules as SQL expressions (see functions.colour)."""

from __future__ import annotations

from tessera.functions.colour import num
from tessera.plans.tables import DISTANCE_BEND, GLOBAL_SCALE

_BEND = num(DISTANCE_BEND)


def distance(q: str) -> str:
    """Perceptual distance of a quality of 1 to 100."""
    return f"CASE WHEN {q} >= 100 THEN 0.01e0 WHEN {q} >= 30 THEN 0.1e0 + (100 - {q}) * 0.09e0 ELSE {num(53 / 3000)} * {q} * {q} - 1.15e0 * {q} + 25e0 END"


def quality(d: str) -> str:
    """The approximate inverse: exact on the linear part."""
    return f"CASE WHEN {d} <= 0.01e0 THEN 100e0 WHEN {d} <= {num(0.1 + 70 * 0.09)} THEN 100e0 - ({d} - 0.1e0) / 0.09e0 ELSE least(30e0, greatest(1e0, (25e0 - {d}) / 1.15e0)) END"


def linear_distance(scale: str, div: str) -> str:
    """Distance by a linear scale factor of 0 to 5000."""
    q = f"(CASE WHEN {scale} < 100 THEN 100 - {scale} {div} 2 ELSE 5000 {div} greatest({scale}, 1) END)"
    return distance(f"greatest(1, {q})")


def distance_scale(d: str, exponent: str) -> str:
    return f"CASE WHEN {d} < {_BEND} THEN {d} ELSE greatest(0.5e0 * {d}, pow({_BEND}, 1e0 - {exponent}) * pow({d}, {exponent})) END"


def scale_distance(s: str, exponent: str) -> str:
    return f"CASE WHEN {s} < {_BEND} THEN {s} ELSE least(2e0 * {s}, pow({_BEND}, 1e0 - 1e0 / {exponent}) * pow({s}, 1e0 / {exponent})) END"


def perceptual_entry(base: str, d: str, exponent: str, scale: float = GLOBAL_SCALE) -> str:
    return f"CAST(least(255e0, greatest(1e0, round({base} * ({distance_scale(d, exponent)}) * {num(scale)}))) AS INT)"


def standard_entry(base: str, q: str, div: str) -> str:
    scale = f"(CASE WHEN {q} < 50 THEN 5000 {div} {q} ELSE 200 - 2 * {q} END)"
    return f"least(255, greatest(1, ({base} * {scale} + 50) {div} 100))"


def blend(d: str) -> str:
    """Share of the low-quality multipliers at a distance."""
    return f"greatest(0e0, least(1e0, ({d} - 1e0) / 2e0))"


def bpp_estimate(q: str, flat: str) -> str:
    return f"(0.1e0 + 0.016e0 * {q}) * (0.3e0 + 0.7e0 * (100e0 - {flat}) / 100e0)"


def approach(metric: str, bpp: str, flat: str, complexity: str) -> str:
    """Coder to choose for a metric."""
    return f"""CASE {metric}
WHEN 'butteraugli' THEN CASE WHEN {flat} > 75e0 AND {complexity} < 20e0 AND {bpp} >= 0.35e0 AND {bpp} < 0.6e0 THEN 'trellis' ELSE 'adaptive' END
WHEN 'dssim' THEN CASE WHEN {bpp} < 0.4e0 OR {bpp} > 2.5e0 THEN 'adaptive' ELSE 'trellis' END
WHEN 'ssimulacra2' THEN CASE WHEN {bpp} >= 0.5e0 AND {bpp} <= 1.5e0 AND {complexity} <= 30e0 THEN 'trellis' ELSE 'adaptive' END
ELSE 'trellis' END"""


def perceptual_number(base: float, d: float, exponent: float, scale: float) -> int:
    """``perceptual_entry`` of a known distance, as a number."""
    by_distance = d if d < DISTANCE_BEND else max(0.5 * d, DISTANCE_BEND ** (1 - exponent) * d**exponent)
    return int(min(255, max(1, int(base * by_distance * scale + 0.5))))


def scale_distance_number(s: float, exponent: float) -> float:
    """``scale_distance`` of a known scale."""
    return s if s < DISTANCE_BEND else min(2 * s, DISTANCE_BEND ** (1 - 1 / exponent) * s ** (1 / exponent))


def effective_distance(tables_: list[list[int]], bases: list[list[float]], exponents: list[float], scale: float = GLOBAL_SCALE) -> float:
    """The distance that three tables stand for: each entry bounds it from both
    sides; a bound that contradicts those before it is passed over."""
    low, high = 0.0, 1e4
    for table, base in zip(tables_, bases, strict=True):
        for v, b, e in zip(table, base, exponents, strict=True):
            least = scale_distance_number((v - 0.5) / b / scale, e) if v > 1 else 0.0
            most = scale_distance_number((v + 0.5) / b / scale, e) if v < 255 else 1e4
            low = max(low, least) if least <= high else low
            high = min(high, most) if most >= low else high
    return high if low == 0 else low if high >= 1e4 else (low + high) / 2


def blended(distance: float, low_quality: list[float], high_quality: list[float]) -> list[float]:
    """Zero-bias multipliers at a distance: those of high quality to 1, those of low quality from 3 on."""
    share = min(1.0, max(0.0, (distance - 1) / 2))
    return [share * a + (1 - share) * b for a, b in zip(low_quality, high_quality, strict=True)]
