"""Relation fields, usage profiles, activation plans and bundles against plain Python."""

import random

import pytest

from quern.operators import activation, relations
from quern.sources import bundles


def values(*groups):
    out, seen = [], set()
    for v in (x.strip() for g in groups for x in g or [] if x is not None):
        if v and v.lower() not in seen:
            seen.add(v.lower())
            out.append(v)
    return out


def test_relation_fields_by_brute_force(spark):
    rng = random.Random(3)
    words = ["data.x", " Data.X ", "snapshot_ref", "model_path", "feedback", "Resource.cpu", "", None, "backend", "RESOURCE.cpu", "step"]
    rows = [(i, rng.choice(["adapter", "head", "other", None]), *([rng.choice(words) for _ in range(rng.randrange(6))] if rng.random() < 0.9 else None for _ in range(5))) for i in range(60)]
    df = spark.createDataFrame(rows, "key int, kind string, context_requires array<string>, context_provides array<string>, context_mutates array<string>, artifact_requires array<string>, meta_phase_in array<string>")
    fields = relations.relation_fields(df)
    assert set(relations.FIELDS) <= set(fields.columns)
    got = {r.key: r for r in fields.withColumn("roles", relations.roles()).collect()}
    for i, kind, requires, provides, mutates, artifacts, phase in rows:
        req, pro, mut = values(requires), values(provides), values(mutates)
        is_artifact = lambda v: any(h in v.lower() for h in relations.ARTIFACT_HINTS)
        want = {
            "context_requires": req, "context_provides": pro, "context_mutates": mut, "artifact_requires": values(artifacts, filter(is_artifact, req)),
            "artifact_provides": values(filter(is_artifact, pro + mut)), "phase_in": values(phase), "resource_refs": [v for v in values(req, pro, mut) if "resource" in v.lower()],
        }
        assert all(got[i][c] == v for c, v in want.items()), i
        text = " ".join(x for c in relations.FIELDS for x in got[i][c]).lower()
        assert got[i].roles == [role for role, marks, kinds in relations.ROLES if any(m in text for m in marks) or kind in kinds]


def test_usage_profiles_merge_in_order(spark):
    entries = relations.relation_fields(spark.createDataFrame([("a", "head", ["data.x"], ["own", "Shared"]), ("b", "none", [], None)], "key string, kind string, context_requires array<string>, use_when array<string>"))
    hints = spark.createDataFrame([("a", None, ["shared", "key hint"], [], ["adapter"], []), (None, "head", ["kind hint", "OWN"], ["w"], [], ["c"])], "key string, kind string, use_when array<string>, minimal_wiring array<string>, required_roles array<string>, config_keys array<string>")
    got = {r.key: r for r in relations.usage_profile(entries, hints).collect()}
    assert got["a"].use_when == ["own", "Shared", "key hint", "kind hint"] and got["a"].minimal_wiring == ["reads data.x; gives", "w"]
    assert got["a"].required_roles == ["adapter", "data_view", "problem"] and got["a"].config_keys == ["c"]
    assert got["b"].use_when == [] and got["b"].required_roles == ["trainer"] and got["b"].minimal_wiring == []
    assert {r.key: r.required_roles for r in relations.usage_profile(entries).collect()} == {"a": ["data_view", "problem"], "b": ["trainer"]}


def test_activation_plans(spark):
    signals = spark.createDataFrame([("nonlinear", -0.4), ("nonlinear", 0.2), ("interaction", 0.5), ("interaction", -0.9), ("threshold", 0.8)], "kind string, value double")
    got = {}
    for r in activation.plan(signals, ("trig",), gates=2, unary_top=2, pair_top=3, gate_top=2, budget={"saturation": 0, "poly": 5}).orderBy("role", "place").collect():
        got.setdefault(r.role, []).append((r.family, round(r.score, 4), r.budget))
    assert got["unary"] == [("radial", 0.512, None), ("poly", 0.4, 5)]
    assert [f for f, *_ in got["pair"]] == ["interaction_basic", "interaction_radial", "interaction_saturation"]  # the first is fourth by score
    assert got["gate_pair"] == [("gate_interaction", 0.925, None), ("interaction_basic", 0.5, None)]
    # poly isn't the best one, so it leads, and the best gives way.
    assert [r.family for r in activation.plan(signals, (), unary_top=1).where("role = 'unary'").collect()] == ["poly"]
    none = activation.plan(signals.limit(0)).collect()
    assert {(r.family, r.score) for r in none} == {("poly", 0.0), ("interaction_basic", 0.0)}


def test_bundles(spark, tmp_path):
    path = str(tmp_path / "bundle")
    with pytest.raises(KeyError):
        bundles.load(spark, path)
    weights = spark.createDataFrame([("w", [1.0, 2.0])], "name string, v array<double>")
    bundles.save(spark, path, {"weights": weights}, {"run": "one", "steps": 3})
    bundles.save(spark, path, {"weights": weights, "empty": weights.limit(0)}, {"run": "two", "tags": ["x"]})
    tables, facts = bundles.load(spark, path)
    assert facts == {"run": "two", "tags": ["x"]} and tables["weights"].first().v == [1.0, 2.0] and tables["empty"].count() == 0
    assert {(r.table, r.column) for r in bundles.describe(spark, path).collect()} == {("weights", "name"), ("weights", "v"), ("empty", "name"), ("empty", "v")}
    with pytest.raises(ValueError):
        bundles.save(spark, path, {bundles.FACTS: weights})
