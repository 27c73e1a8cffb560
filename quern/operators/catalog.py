"""Search over catalog-like tables: token and tag filters, facets, relations, experiment logs, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.runtime import materialize


def tokens(query: str) -> list[str]:
    return query.lower().split()


def search(entries: DataFrame, query: str = "", kind: str | None = None, tags: tuple[str, ...] = (), fields: dict[str, list[str]] | None = None, limit: int | None = None) -> DataFrame:
    """Entries (key, kind, search_text, tags array, fields map) that fit all filters, by kind and key.

    Every query token must be in the text, all tags in the entry, and each field must have one of its
    values. ``limit`` comes last.
    """
    out = entries
    if kind:
        out = out.where(F.lower("kind") == kind.lower())
    for token in tokens(query):
        out = out.where(F.contains(F.lower("search_text"), F.lit(token)))
    lower = F.transform("tags", F.lower)
    for tag in tags:
        out = out.where(F.array_contains(lower, tag.lower()))
    for name, values in (fields or {}).items():
        out = out.where(F.coalesce(F.lower(F.try_element_at("fields", F.lit(name))).isin([v.lower() for v in values]), F.lit(False)))
    out = out.orderBy("kind", "key")
    return out if limit is None else out.limit(limit)


def facets(found: DataFrame) -> DataFrame:
    """Counts by kind and by tag of a result."""
    by_kind = found.groupBy(F.col("kind").alias("value")).agg(F.count("*").alias("n")).select(F.lit("kind").alias("facet"), "value", "n")
    by_tag = found.select(F.explode("tags").alias("value")).groupBy("value").agg(F.count("*").alias("n"))
    return by_kind.unionByName(by_tag.select(F.lit("tag").alias("facet"), "value", "n"))


def valid_entries(entries: DataFrame) -> DataFrame:
    return entries.where((F.trim("key") != "") & (F.trim("kind") != ""))


def later_wins(entries: DataFrame, key: str, precedence: str) -> DataFrame:
    """One row for each key: the last by ``precedence``, picked by a partial aggregate."""
    return entries.groupBy(key).agg(F.max_by(F.struct(*entries.columns), precedence).alias("_last")).select("_last.*")


def first_wins(entries: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row for each combination of keys: the first by ``order``."""
    return entries.groupBy(*keys).agg(F.min_by(F.struct(*entries.columns), order).alias("_first")).select("_first.*")


def summary(entries: DataFrame, group: str, counted: str) -> DataFrame:
    """Entries and distinct values of ``counted`` by group."""
    return entries.groupBy(group).agg(F.count("*").alias("n"), F.countDistinct(counted).alias("distinct"))


def summary_payload(entries: DataFrame) -> DataFrame:
    """One row: total, a map of counts by kind, and the distinct tags in order. Kinds and tags are vocabularies, so small."""
    kinds = entries.groupBy("kind").agg(F.count("*").alias("n")).agg(F.sum("n").alias("total"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("kind", "n")))).alias("by_kind"))
    tags = distinct_values(entries, "tags").agg(F.sort_array(F.collect_list("value")).alias("tags"))
    return kinds.crossJoin(F.broadcast(tags))


def distinct_values(entries: DataFrame, field: str, lower: bool = False) -> DataFrame:
    """Distinct values of an array field."""
    return entries.select(F.explode(F.transform(field, F.lower) if lower else F.col(field)).alias("value")).distinct()


def scalar_index(entries: DataFrame, scope: str, field: str) -> DataFrame:
    """Distinct (scope, lower-cased value) of an array field."""
    return entries.select(scope, F.explode(F.transform(field, F.lower)).alias("value")).distinct()


def has_all_tags(tags: Column, wanted: list[str]) -> Column:
    return F.size(F.array_except(F.array(*map(F.lit, wanted)), tags)) == 0


def tagged_union(tables: dict[str, DataFrame], name: str = "origin") -> DataFrame:
    """All tables one below the other, each row with its table's name; columns that one lacks are null."""
    out = None
    for origin, table in tables.items():
        part = table.withColumn(name, F.lit(origin))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def missing_companions(wanted: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Keys that are asked for and that no entry has."""
    return wanted.select(key).distinct().join(known.select(key), key, "left_anti")


#: Arms of an entry's neighbourhood: name, the array field it starts from, and the field that must share a value.
ARMS = (
    ("context_up", "requires", "provides"),
    ("context_down", "provides", "requires"),
    ("artifact_up", "artifacts_in", "artifacts_out"),
    ("artifact_down", "artifacts_out", "artifacts_in"),
)


def neighbours(entries: DataFrame, roles: int = 12) -> DataFrame:
    """key, arm and other of each entry: by context and artifacts up and down, role companions (the first of the
    same kind), explicit companions, missing ones, and entries that name it.

    ``entries`` has key (unique), kind, companions (array of keys) and the array fields of ``ARMS``. All arms are equi-joins on
    exploded values; values that very many entries hold give as many rows as the answer has.
    """
    none = F.array().cast("array<string>")
    field = lambda f: F.coalesce(F.col(f), none) if f in entries.columns else none
    parts = []
    for arm, own, other in ARMS:
        left = entries.select("key", F.explode(F.array_distinct(F.transform(field(own), F.lower))).alias("_v"))
        right = entries.select(F.col("key").alias("other"), F.explode(F.array_distinct(F.transform(field(other), F.lower))).alias("_v"))
        parts.append(left.join(right, "_v").where("key != other").select("key", F.lit(arm).alias("arm"), "other").distinct())
    # The first of each kind as one short list, so an entry is one row until its own peers are taken: none is sorted by key again.
    first = entries.select("kind", F.col("key").alias("other"), F.row_number().over(Window.partitionBy("kind").orderBy("key")).alias("_r")).where(F.col("_r") <= roles + 1)
    lists = first.groupBy("kind").agg(F.sort_array(F.collect_list("other")).alias("_first"))
    peers = F.slice(F.filter("_first", lambda x: x != F.col("key")), 1, roles)
    parts.append(entries.select("key", "kind").join(lists, "kind").select("key", F.lit("role_companion").alias("arm"), F.explode(peers).alias("other")))
    named = entries.select("key", F.explode(F.array_distinct(field("companions"))).alias("other"))
    known = entries.select(F.col("key").alias("other"))
    parts.append(named.join(known, "other", "left_semi").select("key", F.lit("companion").alias("arm"), "other"))
    parts.append(named.join(known, "other", "left_anti").select("key", F.lit("missing_companion").alias("arm"), "other"))
    parts.append(named.join(known, "other", "left_semi").select(F.col("other").alias("key"), F.lit("linked_by").alias("arm"), F.col("key").alias("other")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def usage_matrix(entries: DataFrame, near: DataFrame) -> DataFrame:
    """key, kind and the number of neighbours of each arm; 0 where there is none."""
    names = [*(a[0] for a in ARMS), "role_companion", "companion", "missing_companion", "linked_by"]
    counts = near.groupBy("key").agg(*(F.count(F.when(F.col("arm") == n, 1)).alias(n) for n in names))
    return entries.select("key", "kind").join(counts, "key", "left").na.fill(0, names)


def entry(entries: DataFrame, key: str) -> DataFrame:
    """The entry of a key; KeyError if there is none."""
    found = entries.where(F.col("key") == key)
    if found.isEmpty():
        raise KeyError(key)
    return found


def edge_counters(log: DataFrame, success: Column, score: Column) -> DataFrame:
    """Counters by namespace, source, operation, expression and target: edges of a search graph."""
    return counters(log, ["namespace", "src", "op", "expr", "dst"], success, score)


def field_values(entries: DataFrame, field: Column, limit: int) -> DataFrame:
    """Most frequent values of a field; ties by lower-cased value. A top-k, so no full sort."""
    out = entries.select(field.alias("value")).where(F.col("value").isNotNull()).groupBy("value").agg(F.count("*").alias("n"))
    return out.orderBy(F.desc("n"), F.lower("value")).limit(limit)


def relations(entries: DataFrame, provides: str, requires: str) -> DataFrame:
    """source, target and number of values that one entry provides and another requires.

    An equi-join on the exploded values; hot values are split by adaptive execution. An entry
    is never related to itself.
    """
    out = entries.select(F.col("key").alias("source"), F.explode(F.array_distinct(F.transform(provides, F.lower))).alias("value"))
    into = entries.select(F.col("key").alias("target"), F.explode(F.array_distinct(F.transform(requires, F.lower))).alias("value"))
    return out.join(into, "value").where("source != target").groupBy("source", "target").agg(F.count("*").alias("shared"))


def value_usage(entries: DataFrame, provides: str, requires: str) -> DataFrame:
    """For each value how many entries provide and require it."""
    side = lambda c, n: entries.select(F.explode(F.array_distinct(F.transform(c, F.lower))).alias("value"), F.lit(n).alias("side"))
    both = side(provides, 1).unionByName(side(requires, 0))
    return both.groupBy("value").agg(F.sum("side").alias("producers"), F.sum(1 - F.col("side")).alias("consumers"))


def link_counts(entries: DataFrame, provides: str, requires: str) -> DataFrame:
    """key and, over the values it requires, the number of other entries that provide each.

    Counted by value and joined back from a table, so the work is linear however many entries hold one
    value: no pair is made, and adaptive execution splits a hot value's rows.
    """
    side = lambda c: entries.select("key", F.explode(F.array_distinct(F.transform(c, F.lower))).alias("value"))
    held = materialize(side(provides).groupBy("value").agg(F.count("*").alias("n")), "providers")
    own = F.array_contains(F.transform(provides, F.lower), F.col("value")).cast("long")
    needs = entries.select("key", provides, F.explode(F.array_distinct(F.transform(requires, F.lower))).alias("value")).select("key", "value", own.alias("own"))
    counts = needs.join(held, "value", "left").groupBy("key").agg(F.sum(F.coalesce("n", F.lit(0)) - F.coalesce("own", F.lit(0))).alias("links"))
    return entries.select("key").join(counts, "key", "left").select("key", F.coalesce("links", F.lit(0)).alias("links"))


def companions(entries: DataFrame, group: str, key: str, limit: int) -> DataFrame:
    """The first ``limit`` other entries of the same group, for each group."""
    return entries.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(key))).where(F.col("place") <= limit).select(group, key, "place")


def experiments(log: DataFrame, run: str | None = None, event: str | None = None, min_step: int | None = None, max_step: int | None = None, payload: str = "", limit: int = 200) -> DataFrame:
    """Records (seq, run_name, event, step, payload) in order; a step bound leaves out rows without a step."""
    out = log
    for column, value in (("run_name", run), ("event", event)):
        out = out if value is None else out.where(F.col(column) == value)
    out = out if min_step is None else out.where(F.col("step") >= min_step)
    out = out if max_step is None else out.where(F.col("step") <= max_step)
    out = out.where(F.contains("payload", F.lit(payload))) if payload else out
    return out.orderBy("seq").limit(max(limit, 0))


def summarize(log: DataFrame) -> DataFrame:
    """Total, by event and by run, in one pass of grouping sets."""
    out = log.groupingSets([[], ["event"], ["run_name"]], "event", "run_name").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    facet = F.when(F.col("g") == 3, "total").when(F.col("g") == 1, "event").otherwise("run")
    return out.select(facet.alias("facet"), F.coalesce("event", F.col("run_name").cast("string")).alias("value"), "n")


def counters(log: DataFrame, keys: list[str], success: Column, score: Column) -> DataFrame:
    """Running counters as an aggregate of an append-only log: seen, success, failure, sum of score."""
    ok = success.cast("long")
    return log.groupBy(*keys).agg(F.count("*").alias("seen"), F.sum(ok).alias("success"), F.sum(1 - ok).alias("failure"), F.sum(score).alias("score_sum"))


def prior(counts: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Accept rate of each wanted key, 0.5 without outcomes."""
    rate = F.coalesce(F.try_divide("success", F.col("success") + F.col("failure")), F.lit(0.5))
    return keys.join(counts, on, "left").select(*on, rate.alias("accept_rate"), F.coalesce("seen", F.lit(0)).alias("seen"))


def category_paths(leaf: DataFrame, levels: list[tuple[DataFrame, str, str]], name: str = "path") -> DataFrame:
    """Left joins up a category tree; the names from the top down, joined by ``>``.

    ``levels`` lists (table, key column, name column); each table also has the next level's key.
    """
    out, parts = leaf, []
    for table, key, label in levels:
        out = out.join(table, key, "left")
        parts.insert(0, F.col(label))
    return out.withColumn(name, F.concat_ws(">", *parts))


def bigram_scores(items: DataFrame, text: Column, query: str, limit: int, key: str) -> DataFrame:
    """Items by the number of the query's two-letter pieces they contain, repeats counted."""
    grams = [query[i : i + 2] for i in range(len(query) - 1)]
    total = F.lit(0)
    for g in grams:
        total = total + F.contains(text, F.lit(g)).cast("int")
    return items.withColumn("score", total).where("score > 0").orderBy(F.desc("score"), key).limit(limit)


def in_profile(tags: Column, others: list[str]) -> Column:
    """Whether an entry belongs to the core: it has none of the tags of other profiles."""
    return ~F.coalesce(F.arrays_overlap(tags, F.array(*map(F.lit, others))), F.lit(False))


def require_profile(entries: DataFrame, profile: str) -> DataFrame:
    """The entries of a profile; KeyError if it has none."""
    found = entries.where(F.col("profile") == profile)
    if found.isEmpty():
        raise KeyError(profile)
    return found


def stages(entries: DataFrame, kinds: dict[str, str], order: list[str], default: str) -> DataFrame:
    """stage, its place, the stage after it, and its number of entries: a flow in a line. Kinds without a stage are ``default``."""
    stage = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in kinds.items() for x in kv)), F.lower("kind")), F.lit(default))
    listed = F.array(*map(F.lit, order))
    counts = entries.groupBy(stage.alias("stage")).agg(F.count("*").alias("n"))
    place = F.array_position(listed, F.col("stage")).cast("int")
    return counts.select("stage", place.alias("place"), F.get(listed, place).alias("next"), "n")
