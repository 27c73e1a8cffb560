"""What catalog entries require and provide, as array columns, and the roles and texts that follow from them.

All of it is expressions on an entry's own arrays, so it is one projection over any number of entries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What marks a value as an artifact, and by which words in an entry's fields, or which kinds, it needs a role.
ARTIFACT_HINTS = ("artifact", "_ref", "_path", "model_path", "snapshot", "report")
ROLES = (
    ("representation", ("unknown_state", "candidate.model", "candidate.model_spec"), ()),
    ("adapter", ("feedback",), ("adapter",)),
    ("data_view", ("data.", "numeric_view"), ()),
    ("backend", ("backend",), ()),
    ("ResourceContext", ("resource",), ()),
    ("artifact", ("artifact", "snapshot"), ()),
    ("problem", (), ("head", "codec", "representation")),
)
#: Array columns of an entry; those that it lacks count as empty. The last two are of its metadata.
INPUTS = (
    "context_requires", "context_provides", "context_mutates", "context_cache", "requires_metrics", "artifact_requires", "artifact_provides",
    "phase_in", "phase_out", "meta_phase_in", "meta_phase_out",
)
FIELDS = ("context_requires", "context_provides", "context_mutates", "context_cache", "requires_metrics", "artifact_requires", "artifact_provides", "phase_in", "phase_out", "resource_refs")


def unique(*arrays: Column) -> Column:
    """The trimmed values of all arrays in order, without blank and null ones, each once whatever its case."""
    trimmed = F.filter(F.transform(F.flatten(F.array(*arrays)), lambda v: F.trim(v)), lambda v: v.isNotNull() & (v != ""))
    # The concatenation is bound once; a value stays where its lower-cased form comes first.
    first = F.transform(F.array(trimmed), lambda vs: F.filter(vs, lambda v, i: F.array_position(F.transform(vs, F.lower), F.lower(v)) == i + 1))
    return F.element_at(first, 1)


def looks_like_artifact(value: Column) -> Column:
    low = F.lower(F.trim(value))
    hit = F.lit(False)
    for hint in ARTIFACT_HINTS:
        hit = hit | F.contains(low, F.lit(hint))
    return hit


def relation_fields(entries: DataFrame) -> DataFrame:
    """``entries`` with the ten arrays of ``FIELDS`` in place of the inputs: artifacts are also found among contexts, phases also in metadata."""
    none = F.array().cast("array<string>")
    given = {c: unique(F.coalesce(F.col(c), none)) if c in entries.columns else none for c in INPUTS}
    rows = entries.select(*(c for c in entries.columns if c not in INPUTS), *(v.alias(c) for c, v in given.items()))
    c = F.col
    made = {
        "artifact_requires": unique(c("artifact_requires"), F.filter("context_requires", looks_like_artifact)),
        "artifact_provides": unique(c("artifact_provides"), F.filter(F.concat("context_provides", "context_mutates"), looks_like_artifact)),
        "phase_in": unique(c("phase_in"), c("meta_phase_in")),
        "phase_out": unique(c("phase_out"), c("meta_phase_out")),
        "resource_refs": F.filter(unique(c("context_requires"), c("context_provides"), c("context_mutates")), lambda v: F.contains(F.lower(v), F.lit("resource"))),
    }
    return rows.withColumns(made).drop("meta_phase_in", "meta_phase_out")


def field_text(*names: str) -> Column:
    """The values of the relation fields, joined by spaces and lower-cased: what relation searches look at."""
    return F.lower(F.concat_ws(" ", *(names or FIELDS)))


def roles(kind: str = "kind") -> Column:
    """Roles that an entry with relation fields needs, in the order of ``ROLES``."""
    text = field_text()
    found = []
    for role, words, kinds in ROLES:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(text, F.lit(w))
        found.append(F.when(hit | F.coalesce(F.col(kind).isin(*kinds), F.lit(False)) if kinds else hit, F.lit(role)))
    return F.array_compact(F.array(*found))


def usage_profile(entries: DataFrame, hints: DataFrame | None = None, kind: str = "kind", key: str = "key") -> DataFrame:
    """key, use_when, minimal_wiring, required_roles and config_keys of each entry, merged in order.

    ``entries`` has relation fields and may have the array columns use_when, minimal_wiring, required_roles and config_keys of its own; those
    come first. ``hints`` has key or kind (the other null) and the same arrays: those for the key come next, then what follows from the
    fields, then those for the kind. Without any role the role is ``trainer``. Hints are unique by key and by kind.
    """
    names = ("use_when", "minimal_wiring", "required_roles", "config_keys")
    none = F.array().cast("array<string>")
    rows = entries
    for by, prefix in ((key, "_k_"), (kind, "_g_")):
        if hints is not None:
            part = hints.where(F.col(by).isNotNull()).select(by, *(F.col(n).alias(f"{prefix}{n}") for n in names))
            rows = rows.join(part, by, "left")
        else:
            rows = rows.withColumns({f"{prefix}{n}": none for n in names})
    own = {n: F.coalesce(F.col(n), none) if n in entries.columns else none for n in names}
    reads, gives = F.concat_ws(", ", "context_requires"), F.concat_ws(", ", unique(F.col("context_provides"), F.col("context_mutates"), F.col("artifact_provides")))
    wiring = F.when((reads != "") | (gives != ""), F.array(F.concat(F.lit("reads "), reads, F.lit("; gives "), gives))).otherwise(none)
    derived = {"use_when": none, "minimal_wiring": wiring, "required_roles": roles(kind), "config_keys": none}
    merged = {n: unique(own[n], F.coalesce(F.col(f"_k_{n}"), none), derived[n], F.coalesce(F.col(f"_g_{n}"), none)) for n in names}
    merged["required_roles"] = F.when(F.size(merged["required_roles"]) > 0, merged["required_roles"]).otherwise(F.array(F.lit("trainer")))
    return rows.select(key, *(c.alias(n) for n, c in merged.items()))
