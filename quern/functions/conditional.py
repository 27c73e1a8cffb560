"""Conditional features (gates, steps, hinges, piecewise terms) lowered to plain expressions.

A specification is a dict: name, family, source (a feature's name) and, by family, threshold or cut, slope, positive,
negative, categories, direction, left, right, multiplier. What cannot be resolved gives no term.
"""

from __future__ import annotations

from quern.functions.expressions import bi, const, feature, un

SLOPE = 8.0


def ramp(z: dict) -> dict:
    """max(z, 0) without a condition."""
    return bi("mul", const(0.5), bi("add", z, un("abs", z)))


def soft_step(index: int, cut: float, slope: float = SLOPE) -> dict:
    """A smooth step from 0 to 1 at ``cut``."""
    rise = un("tanh", bi("mul", const(slope), bi("sub", feature(index), const(cut))))
    return bi("mul", const(0.5), bi("add", const(1.0), rise))


#: Modes of a piecewise term's sides, with their other names.
MODES = {
    ("identity", "linear"): lambda z: z,
    ("zero", "off", "none"): lambda z: const(0.0),
    ("abs", "absolute"): lambda z: un("abs", z),
    ("square", "sq"): lambda z: un("square", z),
    ("neg_identity", "negative", "neg"): lambda z: bi("mul", const(-1.0), z),
    ("hinge", "positive_hinge", "relu"): ramp,
    ("negative_hinge", "left_hinge"): lambda z: ramp(bi("mul", const(-1.0), z)),
}


def side(mode: str, z: dict) -> dict:
    """``z`` under a mode; unknown modes leave it as it is."""
    key = mode.strip().lower()
    return next((make(z) for names, make in MODES.items() if key in names), z)


def _between(low: float, high: float, share: dict) -> dict:
    """``low`` where ``share`` is 0, ``high`` where it is 1."""
    return bi("add", const(low), bi("mul", const(high - low), share))


def lower(specs: list[dict], names: list[str], binary: frozenset[str] = frozenset(), slope: float = SLOPE) -> list[tuple[str, dict, float, list[int]]]:
    """(name, expression, complexity, features) of each specification; equal expressions come once.

    ``binary`` names the features whose finite values are all 0 or 1: a gate at 0.5 on them needs no step.
    """
    place = {n: i for i, n in enumerate(names)}
    out: list[tuple[str, dict, float, list[int]]] = []
    for spec in specs:
        source, multiplier = spec.get("source"), spec.get("multiplier")
        if source not in place or (multiplier is not None and multiplier not in place):
            continue
        i = place[source]
        steep = max(1.0, float(spec.get("slope", slope)))
        cut = float(spec.get("cut", 0.0))
        family = spec["family"]
        shifted = bi("sub", feature(i), const(cut))
        made: list[tuple[str, dict, float]] = []
        if family == "gate_binary":
            threshold, high, low = float(spec.get("threshold", 0.5)), float(spec.get("positive", 1.0)), float(spec.get("negative", 0.0))
            plain = source in binary and abs(threshold - 0.5) <= 1e-8
            share = feature(i) if plain else soft_step(i, threshold, steep)
            made.append((spec["name"], share if plain and abs(high - 1) <= 1e-8 and abs(low) <= 1e-8 else _between(low, high, share), 2.2))
        elif family == "gate_onehot":
            for value in spec.get("categories", ()):
                try:
                    centre = float(value)
                except ValueError:
                    continue
                inside = bi("mul", soft_step(i, centre - 0.5, steep), bi("sub", const(1.0), soft_step(i, centre + 0.5, steep)))
                made.append((f"{spec['name']}:{value}", inside, 3.2))
            multiplier = None
        elif family == "piecewise_hinge":
            negative = str(spec.get("direction", "positive")).strip().lower() == "negative"
            made.append((spec["name"], ramp(bi("sub", const(cut), feature(i)) if negative else shifted), 3.5))
        elif family in ("gate_step", "gate_soft"):
            made.append((spec["name"], soft_step(i, cut, steep), 4.0 if family == "gate_step" else 4.2))
        elif family == "piecewise":
            step = soft_step(i, cut, steep)
            left, right = side(spec.get("left", "identity"), shifted), side(spec.get("right", "identity"), shifted)
            made.append((spec["name"], bi("add", bi("mul", bi("sub", const(1.0), step), left), bi("mul", step, right)), 5.0))
        for name, expr, cost in made:
            used = [i]
            if multiplier is not None:
                expr, cost, used = bi("mul", expr, feature(place[multiplier])), cost + 1, sorted({i, place[multiplier]})
            if all(expr != o[1] for o in out):
                out.append((name, expr, cost, used))
    return out
