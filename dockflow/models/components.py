"""Scaling and principal components of each station as column expressions over its mean and covariance.

Eigenvectors come from cyclic Jacobi rotations: the symmetric matrix travels as an array through an ``aggregate`` over the pairs of
axes, which are turned until nothing is left off the diagonal. Only square roots and divisions are used, so another engine that does
the same steps gets the same numbers.
"""

from __future__ import annotations

import sys

from pyspark.sql import Column
from pyspark.sql import functions as F

from dockflow.schemas import DETECTOR_FEATURES

DIMS = len(DETECTOR_FEATURES)
KEPT_VARIANCE = 0.9
#: Rounds over all pairs of axes; the remainder off the diagonal shrinks quadratically.
SWEEPS = 8
PAIRS = [(p, q) for p in range(DIMS) for q in range(p + 1, DIMS)]
EPS = sys.float_info.epsilon


def triangle(i: int, j: int) -> int:
    """Place of entry (i, j) in the upper triangle, row by row."""
    i, j = min(i, j), max(i, j)
    return i * DIMS - i * (i - 1) // 2 + j - i


def _bound(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` standing for ``value``, which is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def scale_sql(mean: str, covariance: str, rows: str) -> list[str]:
    """Standard deviations; 1 for a feature that is constant but for rounding."""
    out = []
    for i in range(DIMS):
        var, slack = f"{covariance}[{triangle(i, i)}]", f"({rows} * {mean}[{i}] * {EPS!r}D)"
        out.append(f"if({var} <= {rows} * {EPS!r}D * {var} + {slack} * {slack}, 1D, sqrt({var}))")
    return out


def _rotation(m: str, x: str) -> str:
    """The rotation ``c``, ``s`` that clears entry (p, q)."""
    entry = f"{m}.a[{x}.p * {DIMS} + {x}.q]"
    theta = f"({m}.a[{x}.q * {DIMS} + {x}.q] - {m}.a[{x}.p * {DIMS} + {x}.p]) / (2 * {entry})"
    tangent = "if(th >= 0, 1D, -1D) / (abs(th) + sqrt(th * th + 1))"
    both = _bound(theta, "th", _bound(tangent, "t", _bound("1 / sqrt(t * t + 1)", "c", "named_struct('c', c, 's', t * c)")))
    return f"if({entry} = 0, named_struct('c', 1D, 's', 0D), {both})"


def _columns_turned(a: str, x: str) -> str:
    k = f"i % {DIMS}"
    return (
        f"transform({a}, (e, i) -> CASE WHEN {k} = {x}.p THEN r.c * e - r.s * {a}[i - {x}.p + {x}.q] "
        f"WHEN {k} = {x}.q THEN r.s * {a}[i - {x}.q + {x}.p] + r.c * e ELSE e END)"
    )


def _rows_turned(b: str, x: str) -> str:
    k, step = f"i div {DIMS}", f"({x}.q - {x}.p) * {DIMS}"
    return (
        f"transform({b}, (e, i) -> CASE WHEN {k} = {x}.p THEN r.c * e - r.s * {b}[int(i + {step})] "
        f"WHEN {k} = {x}.q THEN r.s * {b}[int(i - {step})] + r.c * e ELSE e END)"
    )


def principal_components(mean: str = "mean", covariance: str = "covariance", rows: str = "rows") -> Column:
    """Scaling, the leading components that together exceed 90 % of the scaled variance, and the share each axis explains.

    ``components`` holds one component's loadings after the other.
    """
    matrix = ", ".join(f"{covariance}[{triangle(i, j)}] / (sc[{i}] * sc[{j}])" for i in range(DIMS) for j in range(DIMS))
    axes = ", ".join("1D" if i == j else "0D" for i in range(DIMS) for j in range(DIMS))
    pairs = ", ".join(f"named_struct('p', {p}, 'q', {q})" for p, q in PAIRS * SWEEPS)
    turned = _bound(_columns_turned("m.a", "x"), "b", f"named_struct('a', {_rows_turned('b', 'x')}, 'v', {_columns_turned('m.v', 'x')})")
    step = _bound(_rotation("m", "x"), "r", turned)
    solved = f"aggregate(array({pairs}), named_struct('a', array({matrix}), 'v', array({axes})), (m, x) -> {step})"
    values = ", ".join(f"named_struct('value', -greatest(m.a[{i * DIMS + i}], 0D), 'axis', {i})" for i in range(DIMS))
    total = "aggregate(o, 0D, (t, e) -> t - e.value)"
    ratio = f"transform(o, e -> if({total} > 0, -e.value / {total}, 0D))"
    running = "transform(sequence(1, size(ra)), k -> aggregate(slice(ra, 1, k), 0D, (t, e) -> t + e))"
    kept = f"least(size(filter({running}, e -> e <= {KEPT_VARIANCE}D)) + 1, {DIMS})"
    loadings = f"flatten(transform(slice(o, 1, {kept}), e -> transform(sequence(0, {DIMS - 1}), i -> m.v[i * {DIMS} + e.axis])))"
    out = _bound(ratio, "ra", f"named_struct('scale', sc, 'components', {loadings}, 'explained', ra)")
    scale = f"array({', '.join(scale_sql(mean, covariance, rows))})"
    return F.expr(_bound(scale, "sc", _bound(solved, "m", _bound(f"array_sort(array({values}))", "o", out))))


def coordinates(values: str, mean: str = "mean", scale: str = "scale", components: str = "components") -> str:
    """Coordinates of an array of features along the kept components, rounded to nine places."""
    z = f"transform({values}, (e, i) -> (e - {mean}[i]) / {scale}[i])"
    along = f"aggregate(sequence(0, {DIMS - 1}), 0D, (t, i) -> t + z[i] * {components}[int(k) * {DIMS} + i])"
    return _bound(z, "z", f"transform(sequence(0, int(size({components}) div {DIMS}) - 1), k -> round({along}, 9))")
