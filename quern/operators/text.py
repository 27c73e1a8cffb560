"""Word tokenisation, vocabularies and fixed-length id sequences, all in built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPECIALS = ("<pad>", "<unk>", "<bos>", "<eos>")
PATTERN = r"(?U)(\w+|[^\w\s])"


def tokenize(text: Column, lowercase: bool = True) -> Column:
    text = F.coalesce(text, F.lit(""))
    return F.regexp_extract_all(F.lower(text) if lowercase else text, F.lit(PATTERN), F.lit(1))


def vocabulary(df: DataFrame, column: str, min_frequency: int = 1) -> DataFrame:
    """token, n and id: frequent tokens in order behind the four specials.

    Counting is a partial aggregate; numbering is by ranges of tokens.
    """
    from quern.operators.metrics import running

    counts = df.select(F.explode(tokenize(F.col(column))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    kept = counts.where(F.col("n") >= min_frequency).withColumn("_one", F.lit(1).cast("long"))
    return running(kept, "token", {"id": "_one"}).select("token", "n", (F.col("id") + len(SPECIALS) - 1).alias("id"))


def encode(df: DataFrame, key: str, column: str, vocab: DataFrame, max_length: int, add_bos: bool = False, add_eos: bool = False) -> DataFrame:
    """key and ids of fixed length: specials, cut, padded; unknown tokens are 1.

    Tokens meet the vocabulary in a join, so neither has to fit one task.
    """
    tokens = df.select(key, F.posexplode(F.slice(tokenize(F.col(column)), 1, max_length)).alias("pos", "token"))
    listed = vocab.select(F.col("token"), F.col("id").alias("_id"))
    found = tokens.join(listed, "token", "left").select(key, F.struct("pos", F.coalesce("_id", F.lit(1)).alias("_id")).alias("t"))
    own = found.groupBy(key).agg(F.transform(F.sort_array(F.collect_list("t")), lambda t: t["_id"]).alias("ids"))
    rows = df.select(key).distinct().join(own, key, "left")
    none = F.array().cast("array<bigint>")
    mark = lambda use, i: F.array(F.lit(i).cast("long")) if use else none
    whole = F.slice(F.concat(mark(add_bos, 2), F.coalesce("ids", none), mark(add_eos, 3)), 1, max_length)
    return rows.select(key, F.concat(whole, F.array_repeat(F.lit(0).cast("long"), max_length - F.size(whole))).alias("ids"))


def camel_to_snake(name: Column) -> Column:
    """Words of a camel-cased name in lower case, runs of other characters as one underscore; ``component`` without any."""
    once = F.regexp_replace(name, r"(.)([A-Z][a-z]+)", "$1_$2")
    twice = F.regexp_replace(once, r"([a-z0-9])([A-Z])", "$1_$2")
    plain = F.lower(F.regexp_replace(F.regexp_replace(twice, r"[^a-zA-Z0-9]+", "_"), r"^_+|_+$", ""))
    return F.when(F.coalesce(plain, F.lit("")) == "", F.lit("component")).otherwise(plain)


def token_dataset(df: DataFrame, key: str, column: str, target: str | None, max_length: int = 128, valid_ratio: float = 0.0, seed: int = 42, min_frequency: int = 1) -> DataFrame:
    """key, ids (a vocabulary of the texts, end marked, cut and padded), attention_mask, label and split.

    The label is 0 where there is no target or it is null. The ratio is kept within 0 and 0.95; at 0, or
    with one row, all rows train.
    """
    found = encode(df, key, column, vocabulary(df, column, min_frequency), max_length, add_eos=True)
    label = F.coalesce(F.col(target).cast("double"), F.lit(0.0)) if target else F.lit(0.0)
    rows = df.select(key, label.alias("label")).join(found, key)
    rows = rows.withColumn("attention_mask", F.transform("ids", lambda i: (i != 0).cast("long")))
    ratio = max(0.0, min(0.95, valid_ratio))
    if ratio > 0 and df.count() > 1:
        from quern.operators.prep import train_valid_split

        split = train_valid_split(df.select(key), key, ratio, seed)
        return rows.join(split, key)
    return rows.withColumn("split", F.lit("train"))


def category_path(*levels: Column) -> Column:
    """Names from the top down joined by ``>``, without any at the ends."""
    return F.regexp_replace(F.concat_ws(">", *(F.coalesce(c, F.lit("")) for c in levels)), "^>+|>+$", "")


def deep_link(path: str, parameters: dict[str, Column]) -> Column:
    """A link with its parameters percent-encoded; empty and null ones are left out."""
    parts = [F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{n}="), F.url_encode(c))) for n, c in parameters.items()]
    query = F.concat_ws("&", *parts)
    return F.when(query == "", F.lit(path)).otherwise(F.concat(F.lit(f"{path}?"), query))


def query_parameters(url: Column) -> Column:
    """Map of a link's parameters, decoded; of repeated ones the last holds."""
    text = F.regexp_replace(F.regexp_extract(url, r"\?([^#]*)", 1), "\\+", "%20")
    pairs = F.filter(F.transform(F.split(text, "&"), lambda p: F.split(p, "=", 2)), lambda p: (F.size(p) == 2) & (F.get(p, F.lit(0)) != ""))
    entries = F.transform(pairs, lambda p: F.struct(F.url_decode(F.get(p, F.lit(0))).alias("k"), F.url_decode(F.get(p, F.lit(1))).alias("v")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda o: o["k"] == e["k"]))
    return F.map_from_entries(last)


def field_filters(parameters: Column, prefix: str = "field.") -> Column:
    """Map of the parameters named ``field.x``, by x in lower case; the others are left out."""
    named = F.map_filter(parameters, lambda k, v: k.startswith(prefix) & (v != ""))
    return F.transform_keys(named, lambda k, v: F.lower(F.substr(k, F.lit(len(prefix) + 1))))


def tag_list(text: Column) -> Column:
    """Tags of a comma-separated list, trimmed, in lower case and each once; empty ones go."""
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda t: F.lower(F.trim(t))), lambda t: t != ""))


def parse_budget(text: Column) -> Column:
    """Map of ``family:n`` items; items without a number go, negative ones count as 0."""
    items = F.transform(F.split(text, ","), lambda s: F.split(F.trim(s), ":"))
    good = F.filter(items, lambda p: (F.size(p) == 2) & F.get(p, F.lit(1)).try_cast("int").isNotNull())
    pairs = F.transform(good, lambda p: F.struct(F.trim(F.get(p, F.lit(0))).alias("k"), F.greatest(F.get(p, F.lit(1)).try_cast("int"), F.lit(0)).alias("v")))
    return F.map_from_entries(pairs)


def keyword_score(text: Column, words: list[str], synonyms: dict[str, list[str]] | None = None) -> Column:
    """How many of the words, and of the other words listed for them, a text contains."""
    words = [w for word in words for w in (word, *(synonyms or {}).get(word, ()))]
    total = F.lit(0)
    for w in words:
        total = total + F.contains(F.lower(text), F.lit(w.lower())).cast("int")
    return total


def fingerprint(*columns: Column) -> Column:
    """SHA-256 of the columns' JSON."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def top_tokens(df: DataFrame, by: str, column: str, k: int) -> DataFrame:
    """The ``k`` most frequent tokens of each group; counts are pre-aggregated before the ranking."""
    counts = df.select(by, F.explode(tokenize(F.col(column))).alias("token")).groupBy(by, "token").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), "token"))
    return counts.withColumn("place", rank).where(F.col("place") <= k)
