"""A typed scalar expression (nested dicts) turned into one Spark column, and its derivative.

Nodes: ``{"type": "feature", "index": i}``, ``{"type": "const", "value": v}``,
``{"type": "param", "name": n, "init": v, "lower": l, "upper": u}``,
``{"type": "unary", "op": o, "arg": e}``, ``{"type": "binary", "op": o, "left": e, "right": e}``.
Catalyst folds, shares and generates code for what comes out; nothing is evaluated here.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.guards import clip, protected_div

EPS = 1e-6
#: What a parameter starts from if it doesn't say.
INIT = 1.0
_UNARY = {
    "identity": lambda z: z,
    "square": lambda z: z * z,
    "sin": F.sin,
    "cos": F.cos,
    "tanh": F.tanh,
    "exp": lambda z: F.exp(clip(z, -30, 30)),
    "log": lambda z: F.ln(F.abs(z) + EPS),
    "abs": F.abs,
    "sqrt": lambda z: F.sqrt(F.abs(z) + EPS),
}
_BINARY = {"add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b, "div": lambda a, b: protected_div(a, b, EPS)}


def feature(index: int) -> dict:
    return {"type": "feature", "index": index}


def const(value: float) -> dict:
    return {"type": "const", "value": float(value)}


def un(op: str, arg: dict) -> dict:
    return {"type": "unary", "op": op, "arg": arg}


def bi(op: str, left: dict, right: dict) -> dict:
    return {"type": "binary", "op": op, "left": left, "right": right}


def children(expr: dict) -> list[dict]:
    return {"unary": lambda: [expr["arg"]], "binary": lambda: [expr["left"], expr["right"]]}.get(expr["type"], list)()


def complexity(expr: dict) -> int:
    """Number of nodes."""
    return 1 + sum(map(complexity, children(expr)))


def parameters(expr: dict) -> list[dict]:
    """Parameter nodes in order, each name once."""
    own = [expr] if expr["type"] == "param" else [p for c in children(expr) for p in parameters(c)]
    return list({p["name"]: p for p in reversed(own)}.values())[::-1]


def clamp(parameter: dict, value: float) -> float:
    low, high = parameter.get("lower"), parameter.get("upper")
    value = value if low is None else max(low, value)
    return float(value if high is None else min(high, value))


def bind(exprs: list[dict], vector: list[float], base: dict[str, float] | None = None) -> dict[str, float]:
    """Values of all parameters by name: the trainable ones from ``vector`` in order of names, within bounds.

    The others keep ``base`` or their initial values. One name with two specifications raises.
    """
    seen: dict[str, dict] = {}
    for expr in exprs:
        stack = [expr]
        while stack:
            node = stack.pop()
            stack += children(node)
            if node["type"] == "param" and seen.setdefault(node["name"], node) != node:
                raise ValueError(f"parameter {node['name']} has conflicting specifications")
    out = {n: float((base or {}).get(n, seen[n].get("init", INIT))) for n in sorted(seen)}
    free = [n for n in out if seen[n].get("trainable", True)]
    if len(free) != len(vector):
        raise ValueError(f"{len(vector)} values for {len(free)} parameters")
    return out | {n: clamp(seen[n], v) for n, v in zip(free, vector, strict=True)}


def parameterize(expr: dict, prefix: str, scale: bool = True, bias: bool = True, inner: bool = True) -> dict:
    """``expr`` with trainable scale and bias around it, and around the argument of a unary operation."""
    slot = lambda n, v: {"type": "param", "name": f"{prefix}_{n}", "init": v}
    if inner and expr["type"] == "unary":
        expr = un(expr["op"], bi("add", bi("mul", slot("arg_scale", 1.0), expr["arg"]), slot("arg_shift", 0.0)))
    if scale:
        expr = bi("mul", slot("out_scale", 1.0), expr)
    return bi("add", slot("out_bias", 0.0), expr) if bias else expr


def validate(expr: dict, n_features: int) -> None:
    kind = expr.get("type")
    if kind == "feature":
        if not 0 <= int(expr["index"]) < n_features:
            raise ValueError(f"no feature {expr['index']}")
    elif kind == "unary" and expr["op"] not in _UNARY or kind == "binary" and expr["op"] not in _BINARY:
        raise ValueError(f"unknown operation {expr['op']}")
    elif kind not in ("const", "param", "unary", "binary"):
        raise ValueError(f"unknown node {kind}")
    for child in children(expr):
        validate(child, n_features)


def to_column(expr: dict, features: list[Column], values: dict[str, float] | None = None) -> Column:
    """``expr`` over ``features``; parameters take ``values`` or their initial ones (1 if they have none) as they are.

    Bounds hold for a vector that is bound by ``bind``, not for evaluation.
    """
    validate(expr, len(features))

    def build(e: dict) -> Column:
        kind = e["type"]
        if kind == "feature":
            return features[e["index"]]
        if kind == "const":
            return F.lit(float(e["value"]))
        if kind == "param":
            return F.lit(float((values or {}).get(e["name"], e.get("init", INIT))))
        if kind == "unary":
            return _UNARY[e["op"]](build(e["arg"]))
        return _BINARY[e["op"]](build(e["left"]), build(e["right"]))

    return build(expr)


_ZERO, _ONE = const(0), const(1)


def _is(e: dict, value: float) -> bool:
    return e["type"] == "const" and e["value"] == value


def _add(a: dict, b: dict, op: str = "add") -> dict:
    if _is(b, 0):
        return a
    return b if _is(a, 0) and op == "add" else bi(op, a, b)


def _mul(a: dict, b: dict) -> dict:
    if _is(a, 0) or _is(b, 0):
        return _ZERO
    return b if _is(a, 1) else a if _is(b, 1) else bi("mul", a, b)


def derivative(expr: dict, wrt: dict) -> dict:
    """Derivative by the feature or parameter ``wrt``, as an expression.

    Inner guards (clipping, the epsilon under log, sqrt and division) count as constant.
    """
    kind = expr["type"]
    if kind == wrt["type"] and kind in ("feature", "param"):
        key = "index" if kind == "feature" else "name"
        return _ONE if expr[key] == wrt[key] else _ZERO
    if kind == "unary":
        z, inner = expr["arg"], derivative(expr["arg"], wrt)
        outer = {
            "identity": lambda: _ONE,
            "square": lambda: _mul(const(2), z),
            "sin": lambda: un("cos", z),
            "cos": lambda: _mul(const(-1), un("sin", z)),
            "tanh": lambda: _add(_ONE, un("square", un("tanh", z)), "sub"),
            "exp": lambda: un("exp", z),
            "log": lambda: bi("div", _ONE, z),
            "abs": lambda: bi("div", z, un("abs", z)),
            "sqrt": lambda: bi("div", bi("div", z, un("abs", z)), _mul(const(2), un("sqrt", z))),
        }[expr["op"]]
        return _ZERO if _is(inner, 0) else _mul(outer(), inner)
    if kind == "binary":
        a, b = expr["left"], expr["right"]
        da, db = derivative(a, wrt), derivative(b, wrt)
        if expr["op"] in ("add", "sub"):
            return _add(da, db, expr["op"])
        if expr["op"] == "mul":
            return _add(_mul(da, b), _mul(a, db))
        top = _add(_mul(da, b), _mul(a, db), "sub")
        return _ZERO if _is(top, 0) else bi("div", top, un("square", b))
    return _ZERO


def gradient(expr: dict, target: Column, features: list[Column], values: dict[str, float], l2: float = 0.0) -> dict[str, Column]:
    """Aggregates of the mean squared error's gradient by parameter: one pass for all."""
    error = to_column(expr, features, values) - target
    out = {}
    for p in parameters(expr):
        slope = to_column(derivative(expr, p), features, values)
        out[p["name"]] = 2 * F.avg(slope * error) + F.lit(2 * l2 * values.get(p["name"], p.get("init", INIT)))
    return out
