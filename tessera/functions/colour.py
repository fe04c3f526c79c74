"""Colour and transfer maths as SQL expressions over column names.

Each function returns text that Spark SQL and other ANSI dialects read alike;
use it with ``F.expr`` or inside a query. Samples are 0 to 255, linear light
and encoded signals 0 to 1, all arithmetic in doubles.
"""

from __future__ import annotations

import math

# Luma and chroma weights, opsin matrix, scaling of XYB and the constants of the transfer curves.
YCC = ((0.299, 0.587, 0.114), (-0.168736, -0.331264, 0.5), (0.5, -0.418688, -0.081312))
RGB_FROM_YCC = (1.402, -0.344136, -0.714136, 1.772)
OPSIN = ((0.30, 0.622, 0.078), (0.23, 0.692, 0.078), (0.24342269, 0.20476744, 0.55180987))
OPSIN_BIAS = 0.0037930733
OPSIN_BIAS_CBRT = 0.15595412
INVERSE_OPSIN = ((11.031567, -9.866944, -0.164623), (-3.254147, 4.418770, -0.164623), (-3.658851, 2.712923, 1.945928))
XYB_OFFSET = (0.015386134, 0.0, 0.27770459)
XYB_SCALE = (22.995788804, 1.183000077, 1.502141333)
HLG_A, HLG_C = 0.17883277, 0.5599107295
HLG_B = 1 - 4 * HLG_A
PQ_M1, PQ_M2, PQ_C1, PQ_C2, PQ_C3 = 2610 / 16384, 2523 / 4096 * 128, 3424 / 4096, 2413 / 4096 * 32, 2392 / 4096 * 32
INTENSITY_TARGET = 255.0
BT709_LUMA = (0.2126, 0.7152, 0.0722)
BT2020_LUMA = (0.2627, 0.678, 0.0593)


def num(x: float) -> str:
    """A double literal."""
    return f"{x!r}" if "e" in repr(x) else f"{float(x)!r}e0"


def weighted(weights: tuple[float, ...], names: tuple[str, ...], plus: float = 0.0) -> str:
    return "(" + " + ".join(f"{num(w)} * {n}" for w, n in zip(weights, names, strict=True)) + (f" + {num(plus)}" if plus else "") + ")"


def sample(x: str) -> str:
    """To the nearest whole number, halves away from zero, 0 to 255."""
    return f"CAST(greatest(0e0, least(255e0, round({x}))) AS INT)"


def ycbcr(r: str, g: str, b: str) -> tuple[str, str, str]:
    """Real-valued luma and chroma, neither rounded nor clamped."""
    return tuple(weighted(w, (r, g, b), 0.0 if i == 0 else 128.0) for i, w in enumerate(YCC))


def rgb_from_ycbcr(y: str, cb: str, cr: str) -> tuple[str, str, str]:
    a, b, c, d = map(num, RGB_FROM_YCC)
    return f"({y} + {a} * ({cr} - 128e0))", f"({y} + {b} * ({cb} - 128e0) + {c} * ({cr} - 128e0))", f"({y} + {d} * ({cb} - 128e0))"


def rgb_from_cmyk(c: str, m: str, y: str, k: str) -> tuple[str, ...]:
    return tuple(sample(f"255e0 * (1e0 - {x} / 255e0) * (1e0 - {k} / 255e0)") for x in (c, m, y))


def cmyk_from_rgb(r: str, g: str, b: str) -> tuple[str, ...]:
    top = f"greatest({r}, {g}, {b})"
    ink = tuple(f"CASE WHEN {top} = 0 THEN 0 ELSE {sample(f'({top} - {x}) * 255e0 / {top}')} END" for x in (r, g, b))
    return *ink, f"(255 - {top})"


def linear_from_srgb(v: str) -> str:
    return f"CASE WHEN {v} <= 0.04045e0 THEN {v} / 12.92e0 ELSE pow(({v} + 0.055e0) / 1.055e0, 2.4e0) END"


def srgb_from_linear(v: str) -> str:
    return f"CASE WHEN {v} <= 0.0031308e0 THEN {v} * 12.92e0 ELSE 1.055e0 * pow(greatest({v}, 0e0), {num(1 / 2.4)}) - 0.055e0 END"


def xyb_from_linear(r: str, g: str, b: str) -> tuple[str, str, str]:
    long, mid, short = (f"(cbrt({weighted(w, (r, g, b), OPSIN_BIAS)}) - {num(OPSIN_BIAS_CBRT)})" for w in OPSIN)
    return f"(0.5e0 * ({long} - {mid}))", f"(0.5e0 * ({long} + {mid}))", short


def linear_from_xyb(x: str, y: str, b: str) -> tuple[str, ...]:
    cube = lambda v: f"(pow({v} + {num(OPSIN_BIAS_CBRT)}, 3e0) - {num(OPSIN_BIAS)})"
    cones = (cube(f"({y} + {x})"), cube(f"({y} - {x})"), cube(b))
    return tuple(weighted(w, cones) for w in INVERSE_OPSIN)


def scaled_xyb(x: str, y: str, b: str) -> tuple[str, str, str]:
    o, s = XYB_OFFSET, XYB_SCALE
    return f"(({x} + {num(o[0])}) * {num(s[0])})", f"(({y} + {num(o[1])}) * {num(s[1])})", f"(({b} - {y} + {num(o[2])}) * {num(s[2])})"


def unscaled_xyb(x: str, y: str, b: str) -> tuple[str, str, str]:
    o, s = XYB_OFFSET, XYB_SCALE
    luma = f"({y} / {num(s[1])} - {num(o[1])})"
    return f"({x} / {num(s[0])} - {num(o[0])})", luma, f"({b} / {num(s[2])} - {num(o[2])} + {luma})"


def hlg_encode(s: str) -> str:
    return f"sign({s}) * CASE WHEN abs({s}) <= {num(1 / 12)} THEN sqrt(3e0 * abs({s})) ELSE {num(HLG_A)} * ln(greatest(12e0 * abs({s}) - {num(HLG_B)}, 1e-300)) + {num(HLG_C)} END"


def hlg_decode(e: str) -> str:
    return f"sign({e}) * CASE WHEN abs({e}) <= 0.5e0 THEN {e} * {e} / 3e0 ELSE (exp((abs({e}) - {num(HLG_C)}) / {num(HLG_A)}) + {num(HLG_B)}) / 12e0 END"


def pq_encode(d: str, target: float = INTENSITY_TARGET) -> str:
    p = f"pow(abs({d}) * {num(target / 10000)}, {num(PQ_M1)})"
    return f"CASE WHEN {d} = 0e0 THEN 0e0 ELSE sign({d}) * pow(({num(PQ_C1)} + {p} * {num(PQ_C2)}) / (1e0 + {p} * {num(PQ_C3)}), {num(PQ_M2)}) END"


def pq_decode(e: str, target: float = INTENSITY_TARGET) -> str:
    p = f"pow(abs({e}), {num(1 / PQ_M2)})"
    return f"CASE WHEN {e} = 0e0 THEN 0e0 ELSE sign({e}) * {num(10000 / target)} * pow(greatest({p} - {num(PQ_C1)}, 0e0) / ({num(PQ_C2)} - {num(PQ_C3)} * {p}), {num(1 / PQ_M1)}) END"


def srgb_decode(e: str) -> str:
    return f"sign({e}) * ({linear_from_srgb(f'abs({e})')})"


def srgb_encode(d: str) -> str:
    return f"sign({d}) * ({srgb_from_linear(f'abs({d})')})"


def bt709_encode(d: str) -> str:
    return f"CASE WHEN {d} < 0.018e0 THEN 4.5e0 * {d} ELSE 1.099e0 * pow(greatest({d}, 0e0), 0.45e0) - 0.099e0 END"


def bt709_decode(e: str) -> str:
    return f"CASE WHEN {e} < 0.081e0 THEN {e} / 4.5e0 ELSE pow(greatest(({e} + 0.099e0) / 1.099e0, 0e0), {num(1 / 0.45)}) END"


def pq_number(d: float) -> float:
    p = (d / 10000) ** PQ_M1 if d else 0.0
    return ((PQ_C1 + p * PQ_C2) / (1 + p * PQ_C3)) ** PQ_M2 if d else 0.0


def tone_map(r: str, g: str, b: str, source: tuple[float, float] = (0.0, 1000.0), target: tuple[float, float] = (0.0, 250.0), weights: tuple[float, ...] = BT2020_LUMA) -> tuple[str, ...]:
    """Luminance from the source's range of nits to the target's: a knee above
    and a lift of black in the PQ domain, colours scaled alike."""
    base = pq_number(source[0])
    span = pq_number(source[1]) - base
    low, high = ((pq_number(t) - base) / span for t in target)
    knee = 1.5 * high - 0.5
    luminance = f"({num(source[1])} * {weighted(weights, (r, g, b))})"
    level = f"least((({pq_encode(luminance, 1.0)}) - {num(base)}) / {num(span)}, 1e0)"
    t = f"(({level} - {num(knee)}) / {num(max(1e-6, 1 - knee))})"
    curve = f"((2e0 * pow({t}, 3e0) - 3e0 * pow({t}, 2e0) + 1e0) * {num(knee)} + (pow({t}, 3e0) - 2e0 * pow({t}, 2e0) + {t}) * {num(1 - knee)} + (3e0 * pow({t}, 2e0) - 2e0 * pow({t}, 3e0)) * {num(high)})"
    bent = f"(CASE WHEN {level} < {num(knee)} THEN {level} ELSE {curve} END)"
    lifted = f"(({num(low)} * pow(1e0 - {bent}, 4e0) + {bent}) * {num(span)} + {num(base)})"
    new = f"greatest(0e0, least({num(target[1])}, {pq_decode(lifted, 1.0)}))"
    return tuple(f"CASE WHEN {luminance} <= 1e-6 THEN {new} / {num(target[1])} ELSE {c} * {new} / greatest({luminance}, 1e-6) * {num(source[1] / target[1])} END" for c in (r, g, b))


def hlg_gamma(source: float, target: float) -> float:
    return 1.111 ** math.log2(target / source)


def hlg_ootf(r: str, g: str, b: str, gamma: float, weights: tuple[float, ...] = BT2020_LUMA) -> tuple[str, ...]:
    """Colours by a power of their luminance; left alone if gamma is within 0.01 of 1."""
    if abs(gamma - 1) <= 0.01:
        return r, g, b
    y = weighted(weights, (r, g, b))
    ratio = f"least(CASE WHEN {y} = 0e0 THEN {num(0.0 if gamma > 1 else 1e9)} ELSE pow({y}, {num(gamma - 1)}) END, 1e9)"
    return tuple(f"({c} * {ratio})" for c in (r, g, b))


def gamut_steps(r: str, g: str, b: str, keep_saturation: float = 0.1, weights: tuple[float, ...] = BT2020_LUMA) -> list[list[tuple[str, str]]]:
    """Projections, one after the other, that bring colours into the unit cube.

    The mix with gray follows the channels in the order r, g, b: the second
    amount looks at the first one as it stands when a channel's turn comes.
    """
    steps = [[("lum", weighted(weights, (r, g, b)))]]
    sat, mix = "0e0", "0e0"
    for i, c in enumerate((r, g, b)):
        inverse = f"(CASE WHEN {c} - lum = 0e0 THEN 1e0 ELSE 1e0 / ({c} - lum) END)"
        steps.append([(f"sat{i}", f"CASE WHEN {c} - lum >= 0e0 THEN {sat} ELSE greatest({sat}, {c} * {inverse}) END")])
        sat = f"sat{i}"
        steps.append([(f"mix{i}", f"greatest({mix}, CASE WHEN {c} - lum <= 0e0 THEN {sat} ELSE {c} * {inverse} - {inverse} END)")])
        mix = f"mix{i}"
    steps.append([("gray", f"greatest(0e0, least(1e0, {num(keep_saturation)} * ({sat} - {mix}) + {mix}))")])
    steps.append([(f"c{i}", f"gray * (lum - {c}) + {c}") for i, c in enumerate((r, g, b))])
    steps.append([(f"out_{n}", f"c{i} / greatest(1e0, c0, c1, c2)") for i, n in enumerate("rgb")])
    return steps
