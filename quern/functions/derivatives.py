"""Derivatives of scalar expressions by forward mode: each node is a value with its slopes, all of them columns.

``expressions.derivative`` builds another expression and forgets the inner guards; here the guards are kept: the slope of a clipped
exponential is zero outside the clip, logarithm and root have the epsilon under their slopes, and a division uses its
protected denominator. Values are shared between a node's slopes, so Catalyst computes each common part once.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.expressions import EPS, INIT, parameters, validate

Slope = Column | None  # None is zero everywhere


def _plus(a: Slope, b: Slope, sign: int = 1) -> Slope:
    if b is None:
        return a
    b = b if sign > 0 else -b
    return b if a is None else a + b


def _times(a: Slope, factor: Column) -> Slope:
    return None if a is None else a * factor


_UNARY = {
    "identity": lambda z, e: (z, F.lit(1.0)),
    "square": lambda z, e: (z * z, 2.0 * z),
    "sin": lambda z, e: (F.sin(z), F.cos(z)),
    "cos": lambda z, e: (F.cos(z), -F.sin(z)),
    "tanh": lambda z, e: (F.tanh(z), 1.0 - F.tanh(z) * F.tanh(z)),
    "exp": lambda z, e: (F.exp(F.when(z > 30.0, 30.0).when(z < -30.0, -30.0).otherwise(z)), F.when((z >= -30.0) & (z <= 30.0), F.exp(z)).otherwise(F.lit(0.0))),
    "log": lambda z, e: (F.ln(F.abs(z) + e), F.signum(z) / (F.abs(z) + e)),
    "abs": lambda z, e: (F.abs(z), F.signum(z)),
    "sqrt": lambda z, e: (F.sqrt(F.abs(z) + e), F.signum(z) / (2.0 * F.sqrt(F.abs(z) + e))),
}


def _walk(node: dict, features: list[Column], wrt: list[tuple[str, int | str]], values: dict[str, float], eps: float) -> tuple[Column, list[Slope]]:
    kind = node["type"]
    if kind in ("feature", "param", "const"):
        name = node.get("index") if kind == "feature" else node.get("name")
        value = features[name].cast("double") if kind == "feature" else F.lit(float(node["value"] if kind == "const" else values.get(name, node.get("init", INIT))))
        return value, [F.lit(1.0) if (kind, name) == w else None for w in wrt]
    if kind == "unary":
        z, inner = _walk(node["arg"], features, wrt, values, eps)
        value, outer = _UNARY[node["op"]](z, eps)
        return value, [_times(d, outer) for d in inner]
    a, da = _walk(node["left"], features, wrt, values, eps)
    b, db = _walk(node["right"], features, wrt, values, eps)
    op = node["op"]
    if op in ("add", "sub"):
        sign = 1 if op == "add" else -1
        return (a + b if sign > 0 else a - b), [_plus(x, y, sign) for x, y in zip(da, db, strict=True)]
    if op == "mul":
        return a * b, [_plus(_times(x, b), _times(y, a)) for x, y in zip(da, db, strict=True)]
    under = F.when(F.abs(b) < eps, F.when(b >= 0, F.lit(eps)).otherwise(F.lit(-eps))).otherwise(b)
    return a / under, [None if x is None and y is None else _plus(_times(x, under), _times(y, a), -1) / (under * under) for x, y in zip(da, db, strict=True)]


def dual(expr: dict, features: list[Column], wrt: list[dict], values: dict[str, float] | None = None, eps: float = EPS) -> Column:
    """A struct of ``value`` and ``slopes``: the derivatives by each of ``wrt`` (feature or parameter nodes), in their order.

    Parameters take ``values``, or what they start from. A null feature makes the value null, and each slope that needs it.
    """
    validate(expr, len(features))
    for w in wrt:
        if w["type"] not in ("feature", "param"):
            raise ValueError("a derivative is by a feature or a parameter")
    by = [("feature", int(w["index"])) if w["type"] == "feature" else ("param", w["name"]) for w in wrt]
    value, slopes = _walk(expr, features, by, values or {}, eps)
    zero = F.lit(0.0)
    listed = F.array(*(zero if s is None else s for s in slopes)) if slopes else F.array().cast("array<double>")
    return F.struct(value.cast("double").alias("value"), listed.alias("slopes"))


def jacobian(expr: dict, features: list[Column], values: dict[str, float] | None = None, eps: float = EPS) -> tuple[list[str], Column]:
    """Names of the trainable parameters, in order of their first place, and ``dual`` by them."""
    free = [p for p in parameters(expr) if p.get("trainable", True)]
    return [p["name"] for p in free], dual(expr, features, free, values, eps)


def parameter_gradient(expr: dict, features: list[Column], target: Column, values: dict[str, float] | None = None, l2: float = 0.0, eps: float = EPS) -> dict[str, Column]:
    """Aggregates of the mean squared error's gradient by trainable parameter, with the guards' slopes: one pass for all."""
    names, d = jacobian(expr, features, values, eps)
    starts = {p["name"]: p.get("init", INIT) for p in parameters(expr)}
    error = d["value"] - target
    return {n: 2 * F.avg(d["slopes"][i] * error) + F.lit(2 * l2 * (values or {}).get(n, starts[n])) for i, n in enumerate(names)}
