"""Which families of primitives a pool should grow by, scored from the strengths of signals.

Strengths are maxima over tables of signals, so one small aggregate each; the plan is a table with a row for each family.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import primitives as P

# A family's score is these shares of the nonlinear, interaction and threshold strengths; the last tells what must be allowed.
WEIGHTS = {
    "poly": (1.0, 0.0, 0.0, None),
    "bounded": (0.90, 0.0, 0.0, None),
    "saturation": (0.82, 0.0, 0.18, None),
    "radial": (0.72, 0.0, 0.28, None),
    "trig": (0.55, 0.0, 0.0, "trig"),
    "safe_log": (0.85, 0.0, 0.15, "safe_log"),
    "safe_exp": (0.75, 0.0, 0.25, "safe_exp"),
    "safe_ratio": (0.60, 0.40, 0.0, "safe_ratio"),
    "interaction_basic": (0.0, 1.0, 0.0, None),
    "interaction_poly": (0.15, 0.85, 0.0, None),
    "interaction_compose": (0.30, 0.70, 0.0, None),
    "interaction_ratio": (0.0, 0.65, 0.20, "safe_ratio"),
    "interaction_saturation": (0.18, 0.72, 0.10, None),
    "interaction_radial": (0.0, 0.62, 0.38, None),
    "interaction_rational": (0.22, 0.68, 0.10, None),
    "linear_combo": (0.10, 0.50, 0.0, None),
    "gate_interaction": (0.0, 0.25, 1.0, "gates"),
}
GATE_PAIRS = ("interaction_basic", "interaction_compose", "interaction_ratio", "gate_interaction")
ALWAYS = {"unary": "poly", "pair": "interaction_basic"}
LEVELS = ("nonlinear", "interaction", "threshold")


def strengths(signals: DataFrame) -> DataFrame:
    """One row of nonlinear, interaction and threshold strengths of ``signals`` (kind: one of these, value); 0 without any.

    The nonlinear strength is of sizes, the others are plain maxima, as their signals are.
    """
    value = F.when(F.col("kind") == "nonlinear", F.abs("value")).otherwise(F.col("value"))
    return signals.agg(*(F.coalesce(F.max(F.when(F.col("kind") == k, value)), F.lit(0.0)).alias(k) for k in LEVELS))


def plan(signals: DataFrame, allow: tuple[str, ...] = ("trig", "safe_log", "safe_exp", "safe_ratio"), gates: int = 0, unary_top: int = 3, pair_top: int = 3, gate_top: int = 2, budget: dict[str, int] | None = None) -> DataFrame:
    """family, role (unary, pair or gate_pair), score, place in its role, and budget (null: none) of the chosen families.

    A family whose score is 0, whose budget is 0, or that isn't allowed is never chosen for its score; the first of ``ALWAYS`` leads its role
    if it isn't among the best, and the last of those then gives way. Equal scores go by name.
    """
    spark = signals.sparkSession
    open_ = {*allow, *(["gates"] if gates > 0 else [])}
    budget = {k: max(0, int(v)) for k, v in (budget or {}).items()}
    role = {p.family: "unary" for p in P.UNARY.values()} | {p.family: "pair" for p in P.PAIR.values()} | {"gate_interaction": "pair"}
    rows = [(f, role[f], *w[:3], w[3] is None or w[3] in open_, budget.get(f)) for f, w in WEIGHTS.items() if f in role]
    table = spark.createDataFrame(rows, "family string, role string, a double, b double, c double, allowed boolean, budget int")
    score = F.when(F.col("allowed"), F.col("a") * F.col("nonlinear") + F.col("b") * F.col("interaction") + F.col("c") * F.col("threshold")).otherwise(0.0)
    scored = F.broadcast(table).crossJoin(strengths(signals)).select("family", "role", score.alias("score"), "budget")
    able = (F.col("score") > 0) & (F.coalesce("budget", F.lit(1)) > 0)
    gate_pairs = scored.where(F.col("family").isin(*GATE_PAIRS) & F.lit(gates > 0)).withColumn("role", F.lit("gate_pair"))
    both = scored.where("family != 'gate_interaction'").unionByName(gate_pairs)
    rank = F.row_number().over(Window.partitionBy("role", able).orderBy(F.desc("score"), "family"))
    limit = F.when(F.col("role") == "unary", max(1, unary_top)).when(F.col("role") == "pair", max(1, pair_top)).otherwise(max(1, gate_top))
    ranked = both.select("*", able.alias("able"), F.when(able, rank).alias("r"), limit.alias("limit"))
    always = F.col("family") == F.when(F.col("role") == "unary", ALWAYS["unary"]).when(F.col("role") == "pair", ALWAYS["pair"])
    best = F.coalesce(F.col("able") & (F.col("r") <= F.col("limit")), F.lit(False))
    chosen = ranked.withColumn("led", F.coalesce(always & ~best, F.lit(False))).where(best | F.col("led"))
    place = F.row_number().over(Window.partitionBy("role").orderBy(F.desc("led"), "r"))
    return chosen.withColumn("place", place).where(F.col("place") <= F.col("limit")).select("family", "role", "score", "place", "budget")
