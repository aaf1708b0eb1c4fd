"""Distances, projections and linear referencing as SQL expressions, so they stay in generated code.

Each function returns the text of an expression over the given expressions; ``F.expr`` makes it a
Column. Only functions that most SQL engines share are used.
"""

from __future__ import annotations

import math

RADIUS = 6378137.0


def _n(x: float) -> str:
    return f"({x!r}e0)" if "e" not in repr(float(x)) else f"({float(x)!r})"


def mercator_x(lng: str) -> str:
    return f"({_n(RADIUS)} * radians({lng}))"


def mercator_y(lat: str) -> str:
    return f"({_n(RADIUS)} * ln(tan({_n(math.pi / 4)} + radians({lat}) / 2)))"


def planar(x1: str, y1: str, x2: str, y2: str) -> str:
    return f"sqrt(({x1} - {x2}) * ({x1} - {x2}) + ({y1} - {y2}) * ({y1} - {y2}))"


def mercator_distance(lng1: str, lat1: str, lng2: str, lat2: str) -> str:
    """Metres on the spherical Mercator plane (EPSG:3857): too long by 1 / cos(latitude)."""
    return planar(mercator_x(lng1), mercator_y(lat1), mercator_x(lng2), mercator_y(lat2))


def degree_distance(lng1: str, lat1: str, lng2: str, lat2: str) -> str:
    return planar(lng1, lat1, lng2, lat2)


# -- transverse Mercator (UTM), the Krueger series to the sixth order of the third flattening

# The WGS 84 ellipsoid, UTM's scale and false easting, and the published series.
FLATTENING, SCALE, EASTING = 1 / 298.257223563, 0.9996, 500000.0
_t = FLATTENING / (2 - FLATTENING)
_e = math.sqrt(FLATTENING * (2 - FLATTENING))
_A = RADIUS / (1 + _t) * (1 + _t**2 / 4 + _t**4 / 64 + _t**6 / 256)


def _series(*rows: tuple[float, ...]) -> list[float]:
    """Row j holds the coefficients of the powers j, j + 1, .. 6."""
    return [sum(c * _t ** (j + i) for i, c in enumerate(row)) for j, row in enumerate(rows, 1)]


ALPHA = _series((1 / 2, -2 / 3, 5 / 16, 41 / 180, -127 / 288, 7891 / 37800), (13 / 48, -3 / 5, 557 / 1440, 281 / 630, -1983433 / 1935360), (61 / 240, -103 / 140, 15061 / 26880, 167603 / 181440), (49561 / 161280, -179 / 168, 6601661 / 7257600), (34729 / 80640, -3418889 / 1995840), (212378941 / 319334400,))
BETA = _series((1 / 2, -2 / 3, 37 / 96, -1 / 360, -81 / 512, 96199 / 604800), (1 / 48, 1 / 15, -437 / 1440, 46 / 105, -1118711 / 3870720), (17 / 480, -37 / 840, -209 / 4480, 5569 / 90720), (4397 / 161280, -11 / 504, -830251 / 7257600), (4583 / 161280, -108847 / 3991680), (20648693 / 638668800,))
DELTA = _series((2, -2 / 3, -2, 116 / 45, 26 / 45, -2854 / 675), (7 / 3, -8 / 5, -227 / 45, 2704 / 315, 2323 / 945), (56 / 15, -136 / 35, -1262 / 105, 73814 / 2835), (4279 / 630, -332 / 35, -399572 / 14175), (4174 / 315, -144838 / 6237), (601676 / 22275,))


def utm_stages(lng: str = "lng", lat: str = "lat", zone: int = 51) -> list[dict[str, str]]:
    """Columns to add, stage by stage: the last has ``x`` and ``y`` in metres (northern hemisphere)."""
    s = f"sin(radians({lat}))"
    tau = f"(sinh(atanh({s}) - {_n(_e)} * atanh({_n(_e)} * {s})))"
    d = f"radians({lng} - {_n(6.0 * zone - 183)})"
    wave = lambda f, g: " + ".join(f"{_n(a)} * {f}({2 * j} * u_xi) * {g}({2 * j} * u_eta)" for j, a in enumerate(ALPHA, 1))
    return [
        {"u_tau": tau, "u_d": d},
        {"u_xi": "atan2(u_tau, cos(u_d))", "u_eta": "asinh(sin(u_d) / sqrt(u_tau * u_tau + cos(u_d) * cos(u_d)))"},
        {"x": f"{_n(EASTING)} + {_n(SCALE * _A)} * (u_eta + {wave('cos', 'sinh')})", "y": f"{_n(SCALE * _A)} * (u_xi + {wave('sin', 'cosh')})"},
    ]


def inverse_utm_stages(x: str = "x", y: str = "y", zone: int = 51) -> list[dict[str, str]]:
    """Columns to add, stage by stage: the last has ``lng`` and ``lat`` in degrees."""
    wave = lambda f, g: " + ".join(f"{_n(b)} * {f}({2 * j} * v_xi) * {g}({2 * j} * v_eta)" for j, b in enumerate(BETA, 1))
    back = " + ".join(f"{_n(c)} * sin({2 * j} * v_chi)" for j, c in enumerate(DELTA, 1))
    return [
        {"v_xi": f"{y} / {_n(SCALE * _A)}", "v_eta": f"({x} - {_n(EASTING)}) / {_n(SCALE * _A)}"},
        {"w_xi": f"v_xi - ({wave('sin', 'cosh')})", "w_eta": f"v_eta - ({wave('cos', 'sinh')})"},
        {"v_chi": "atan(sin(w_xi) / sqrt(sinh(w_eta) * sinh(w_eta) + cos(w_xi) * cos(w_xi)))", "v_d": "atan2(sinh(w_eta), cos(w_xi))"},
        {"lng": f"{_n(6.0 * zone - 183)} + degrees(v_d)", "lat": f"degrees(v_chi + {back})"},
    ]


# -- linear referencing


def share_along(px: str, py: str, x1: str, y1: str, x2: str, y2: str) -> str:
    """Where on the segment (0 to 1) the point that is nearest to p lies; 0 on a segment without length."""
    length2 = f"(({x2} - {x1}) * ({x2} - {x1}) + ({y2} - {y1}) * ({y2} - {y1}))"
    dot = f"(({px} - {x1}) * ({x2} - {x1}) + ({py} - {y1}) * ({y2} - {y1}))"
    return f"(case when {length2} = 0 then 0e0 else greatest(0e0, least(1e0, {dot} / {length2})) end)"


def between(a: str, b: str, share: str) -> str:
    return f"({a} + ({b} - {a}) * {share})"
