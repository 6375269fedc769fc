"""Eigenvalues and eigenvectors of symmetric 3x3 matrices as column expressions.

The eigenvalue that lies apart from the other two comes from the closed form, where it is exact; its vector is the largest
cross product of two rows of the shifted matrix. The other two values and vectors are those of the 2x2 matrix that is left
at right angles to it. So nothing is lost where two eigenvalues coincide.

Expressions are SQL text, in order; each may use those before it. Inputs are cxx, cxy, cxz, cyy, cyz, czz.
"""

from __future__ import annotations

import re

#: Eigenvalues below this share of their sum are 0, and differences below it none: what sums of coordinates leave as noise.
FLOOR = "1e-10"

_A = {"xx": "cxx", "xy": "cxy", "xz": "cxz", "yx": "cxy", "yy": "cyy", "yz": "cyz", "zx": "cxz", "zy": "cyz", "zz": "czz"}


def _cross(a: tuple[str, str, str], b: tuple[str, str, str]) -> list[str]:
    return [f"({a[(i + 1) % 3]}) * ({b[(i + 2) % 3]}) - ({a[(i + 2) % 3]}) * ({b[(i + 1) % 3]})" for i in range(3)]


def _dot(a: tuple[str, str, str], b: tuple[str, str, str]) -> str:
    return " + ".join(f"({x}) * ({y})" for x, y in zip(a, b))


def _times(v: str) -> list[str]:
    """The matrix times a vector of columns."""
    return [" + ".join(f"{_A[r + c]} * {v}{c}" for c in "xyz") for r in "xyz"]


def steps() -> list[tuple[str, str]]:
    """(column, SQL) up to the roots of the eigenvalues _l1 >= _l2 >= _l3 and their unit vectors _v1x.._v3z."""
    out = [
        ("_t", "cxx + cyy + czz"),
        ("_m", "_t / 3"),
        ("_p", "sqrt(((cxx - _m) * (cxx - _m) + (cyy - _m) * (cyy - _m) + (czz - _m) * (czz - _m) + 2 * (cxy * cxy + cxz * cxz + cyz * cyz)) / 6)"),
        ("_q", "((cxx - _m) * ((cyy - _m) * (czz - _m) - cyz * cyz) - cxy * (cxy * (czz - _m) - cyz * cxz) + cxz * (cxy * cyz - (cyy - _m) * cxz)) / 2"),
        ("_r", "greatest(-1, least(1, _q / greatest(_p * _p * _p, 1e-300)))"),
        ("_top", "_r >= 0"),
        ("_apart", "_m + 2 * _p * cos(acos(_r) / 3 + CASE WHEN _top THEN 0 ELSE 2 * pi() / 3 END)"),
    ]
    rows = [tuple(f"{_A[r + c]} - _apart" if r == c else _A[r + c] for c in "xyz") for r in "xyz"]
    for n, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
        out += [(f"_c{n}{d}", e) for d, e in zip("xyz", _cross(rows[i], rows[j]))]
        out.append((f"_c{n}", _dot(*[(f"_c{n}x", f"_c{n}y", f"_c{n}z")] * 2)))
    out.append(("_c", "greatest(_c0, _c1, _c2)"))
    # a matrix without a direction has its first vector along x
    for d in "xyz":
        best = f"CASE WHEN _c0 = _c THEN _c0{d} WHEN _c1 = _c THEN _c1{d} ELSE _c2{d} END"
        out.append((f"_a{d}", f"CASE WHEN _c <= 1e-300 THEN {1.0 if d == 'x' else 0.0} ELSE ({best}) / sqrt(greatest(_c, 1e-300)) END"))
    flat = "sqrt(greatest(CASE WHEN abs(_ax) > abs(_ay) THEN _ax * _ax + _az * _az ELSE _ay * _ay + _az * _az END, 1e-300))"
    out.append(("_n", flat))
    for d, long, short in (("x", "-_az", "0"), ("y", "0", "_az"), ("z", "_ax", "-_ay")):
        out.append((f"_u{d}", f"(CASE WHEN abs(_ax) > abs(_ay) THEN {long} ELSE {short} END) / _n"))
    axes = {v: tuple(f"_{v}{d}" for d in "xyz") for v in "auw"}
    out += [(f"_w{d}", e) for d, e in zip("xyz", _cross(axes["a"], axes["u"]))]
    for v in "auw":
        out += [(f"_m{v}{d}", e) for d, e in zip("xyz", _times(f"_{v}"))]
    image = {v: tuple(f"_m{v}{d}" for d in "xyz") for v in "auw"}
    out += [
        ("_own", _dot(axes["a"], image["a"])),
        ("_uu", _dot(axes["u"], image["u"])),
        ("_uw", _dot(axes["u"], image["w"])),
        ("_ww", _dot(axes["w"], image["w"])),
        ("_h", "(_uu - _ww) / 2"),
        ("_g", "sqrt(_h * _h + _uw * _uw)"),
        ("_bu", f"CASE WHEN _g <= {FLOOR} * _t THEN 1.0 WHEN _h >= 0 THEN _h + _g ELSE _uw END"),
        ("_bw", f"CASE WHEN _g <= {FLOOR} * _t THEN 0.0 WHEN _h >= 0 THEN _uw ELSE _g - _h END"),
        ("_b", "sqrt(greatest(_bu * _bu + _bw * _bw, 1e-300))"),
    ]
    for d in "xyz":
        out += [(f"_hi{d}", f"(_bu * _u{d} + _bw * _w{d}) / _b"), (f"_lo{d}", f"(_bu * _w{d} - _bw * _u{d}) / _b")]
    values = ("CASE WHEN _top THEN _own ELSE (_uu + _ww) / 2 + _g END", "CASE WHEN _top THEN (_uu + _ww) / 2 + _g ELSE (_uu + _ww) / 2 - _g END", "CASE WHEN _top THEN (_uu + _ww) / 2 - _g ELSE _own END")
    for i, e in enumerate(values, 1):
        out += [(f"_e{i}", e), (f"_l{i}", f"CASE WHEN _e{i} <= {FLOOR} * _t THEN 0.0 ELSE sqrt(greatest(_e{i}, 0)) END")]
    for i, (top, rest) in enumerate((("_a", "_hi"), ("_hi", "_lo"), ("_lo", "_a")), 1):
        out += [(f"_v{i}{d}", f"CASE WHEN _top THEN {top}{d} ELSE {rest}{d} END") for d in "xyz"]
    return out


def feature_steps(k_min: int) -> list[tuple[str, str]]:
    """(column, SQL) of the features, from n and the columns of `steps`."""
    few = lambda e: f"CASE WHEN n < {k_min} THEN 0.0 ELSE {e} END"
    out = [(f"_s{d}", " + ".join(f"abs(_v{i}{d}) * _l{i}" for i in (1, 2, 3))) for d in "xyz"]
    # the normal points up; a level one to y, or else x
    out += [("_size", "sqrt(_sx * _sx + _sy * _sy + _sz * _sz)"), ("_up", "CASE WHEN abs(_v3z) > 1e-9 THEN sign(_v3z) WHEN abs(_v3y) > 1e-9 THEN sign(_v3y) ELSE sign(_v3x) END")]
    made = {
        "linearity": "(_l1 - _l2) / (_l1 + 1e-3)",
        "planarity": "(_l2 - _l3) / (_l1 + 1e-3)",
        "scattering": "_l3 / (_l1 + 1e-3)",
        "length": "_l1",
        "surface": "sqrt(_l1 * _l2 + 1e-6)",
        "volume": "cbrt(_l1 * _l2 * _l3 + 1e-9)",
        "curvature": "_l3 / (_l1 + _l2 + _l3 + 1e-3)",
        "verticality": "2 * _sz / greatest(_size, 1e-12)",
        **{f"n{d}": f"_up * _v3{d}" for d in "xyz"},
    }
    return out + [(name, few(e)) for name, e in made.items()]


def levels(columns: list[tuple[str, str]]) -> list[dict[str, str]]:
    """The columns in groups that need none of their own group."""
    out: list[dict[str, str]] = [{}]
    for name, e in columns:
        if set(re.findall(r"\w+", e)) & set(out[-1]):
            out.append({})
        out[-1][name] = e
    return out


def nested(source: str, columns: list[tuple[str, str]]) -> str:
    """A query over `source` with columns added one after another."""
    for level in levels(columns):
        source = f"(SELECT *, {', '.join(f'{e} AS {name}' for name, e in level.items())} FROM {source})"
    return source
