"""Feature preparation: every fit is one small aggregate, every transform one projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.guards import finite, isclose
from quern.runtime import materialize, remove


def split_target(df: DataFrame, target: str | None = None) -> tuple[DataFrame, list[str], str]:
    """All columns as doubles, the feature names, and the target (the last column by default)."""
    if not df.columns:
        raise ValueError("no columns")
    target = target or df.columns[-1]
    return df.select(*(F.col(c).cast("double").alias(c) for c in df.columns)), [c for c in df.columns if c != target], target


def zscore(df: DataFrame, columns: list[str], split: str | None = None, eps: float = 1e-12, with_mean: bool = True, with_std: bool = True) -> DataFrame:
    """Standardise by the mean and population deviation of the training rows (``split`` = 'train').

    A deviation of at most ``eps`` counts as 1. The statistics are one row, so broadcasting them is safe.
    """
    fit = df.where(F.col(split) == "train") if split else df
    stats = fit.agg(*(F.avg(c).alias(f"_m_{c}") for c in columns), *(F.stddev_pop(c).alias(f"_s_{c}") for c in columns))

    def scaled(c: str) -> Column:
        mean = F.col(f"_m_{c}") if with_mean else F.lit(0.0)
        std = F.when(F.abs(f"_s_{c}") > eps, F.col(f"_s_{c}")).otherwise(F.lit(1.0)) if with_std else F.lit(1.0)
        return (F.col(c) - mean) / std

    return df.crossJoin(F.broadcast(stats)).select(*((scaled(c).alias(c) if c in columns else F.col(c)) for c in df.columns))


def select_columns(df: DataFrame, indices: list[int]) -> DataFrame:
    """Columns by place, in order; none listed leaves the table as it is; repeats get a suffix."""
    if not indices:
        return df
    names: list[Column] = []
    for k, i in enumerate(indices):
        seen = indices[:k].count(i)
        names.append(F.col(df.columns[i]).alias(df.columns[i] + (f"_{seen}" if seen else "")))
    return df.select(*names)


def categories(df: DataFrame, column: str) -> list[str]:
    """Distinct values in order, found at fit; a vocabulary, so small by nature, and checked."""
    rows = df.select(F.col(column).cast("string").alias("v")).where("v is not null").distinct().limit(100_001).collect()
    if len(rows) > 100_000:
        raise ValueError(f"{column} has more than 100000 categories")
    return sorted(r.v for r in rows)


def one_hot(df: DataFrame, column: str, values: list[str] | None = None) -> DataFrame:
    """``column`` replaced by a 0/1 column for each value; unseen values and nulls give zeros."""
    values = categories(df, column) if values is None else values
    hot = [F.when(F.col(column).cast("string") == v, 1.0).otherwise(0.0).alias(f"{column}={v}") for v in values]
    return df.select(*(c for c in df.columns if c != column), *hot)


def encode_numeric(column: str) -> Column:
    return F.coalesce(F.col(column).cast("double"), F.lit(0.0))


def encode_boolean(column: str) -> Column:
    return F.coalesce(F.col(column).cast("boolean"), F.lit(False)).cast("double")


def categorical_code(df: DataFrame, column: str, name: str = "code") -> DataFrame:
    """Place of each value among the distinct values in order, from 0; joined back by value.

    Distinct values are numbered range by range, however many there are.
    """
    from quern.operators.metrics import running

    codes = df.select(column).where(F.col(column).isNotNull()).distinct().withColumn("_one", F.lit(1).cast("long"))
    codes = running(codes, column, {"_n": "_one"}).select(column, (F.col("_n") - 1).alias(name))
    return df.join(codes, column, "left")


def polynomial(df: DataFrame, columns: list[str], square: bool = True, interactions: bool = True) -> DataFrame:
    """Squares, then products of each pair in order, behind the columns."""
    out: list[Column] = [F.col(c) for c in df.columns]
    out += [(F.col(c) * F.col(c)).alias(f"{c}^2") for c in columns] if square else []
    out += [(F.col(a) * F.col(b)).alias(f"{a}*{b}") for i, a in enumerate(columns) for b in columns[i + 1 :]] if interactions else []
    return df.select(*out)


def conditioned_target(df: DataFrame, y: str, pred: str, mode: str = "residual", append_prediction: bool = False) -> DataFrame:
    """Target from a reference model's prediction: residual, correction, original or prediction."""
    target = {"residual": F.col(y) - F.col(pred), "negative_residual": F.col(pred) - F.col(y), "original": F.col(y), "prediction": F.col(pred)}[mode]
    out = df.withColumn(f"{y}.{mode}", target).drop(y)
    return out.withColumn("reference.prediction", F.col(pred)) if append_prediction else out


def blend(df: DataFrame, weights: dict[str, float], intercept: float = 0.0, name: str = "prediction") -> DataFrame:
    """Weighted sum of component predictions."""
    total = F.lit(float(intercept))
    for column, weight in weights.items():
        total = total + F.lit(float(weight)) * F.col(column)
    return df.withColumn(name, total)


def inverse_error_weights(errors: dict[str, float], uniform: bool = False) -> dict[str, float]:
    """Weights of components: equal, or by the inverse of their errors."""
    raw = {k: 1.0 if uniform else 1 / max(v, 1e-12) for k, v in errors.items()}
    total = sum(raw.values()) or 1.0
    return {k: v / total for k, v in raw.items()}


def hash_rank(key: Column, seed: int = 42) -> Column:
    """A seeded pseudo-random order by arithmetic that any SQL engine can repeat."""
    return F.pmod(key.cast("long") * F.lit(2654435761) + F.lit(int(seed)), F.lit(4294967296))


def _numbered(df: DataFrame, order: Column) -> DataFrame:
    """Rows numbered from 0 in ``order``, range by range, so that no task sees all rows."""
    from quern.operators.metrics import running

    keyed = df.withColumn("_order", order).withColumn("_one", F.lit(1).cast("long"))
    return running(keyed, "_order", {"_n": "_one"}).withColumn("_at", F.col("_n") - 1).drop("_order", "_one", "_n")


def train_valid_split(df: DataFrame, key: str, ratio: float, seed: int = 42) -> DataFrame:
    """``split`` of exactly max(1, round(ratio * n)) validation rows, in seeded order of ``key``."""
    n = df.count()
    n_valid = max(1, round(ratio * n)) if ratio > 0 and n else 0
    out = _numbered(df, F.struct(hash_rank(F.col(key), seed), F.col(key)))
    return out.withColumn("split", F.when(F.col("_at") < n_valid, "valid").otherwise("train")).drop("_at")


def batches(df: DataFrame, key: str, size: int, shuffle: bool = False, seed: int = 42, epoch: int = 0, drop_last: bool = False) -> DataFrame:
    """``batch_id`` of each row, in order of ``key`` or shuffled by seed and epoch."""
    order = F.struct(hash_rank(F.col(key), seed + epoch), F.col(key)) if shuffle else F.struct(F.col(key))
    out = _numbered(df, order).withColumn("batch_id", F.floor(F.col("_at") / size).cast("long")).drop("_at")
    return out.where(F.col("batch_id") < df.count() // size) if drop_last else out


def k_fold(df: DataFrame, key: str, folds: int, seed: int = 42) -> DataFrame:
    """``fold`` of each row; sizes differ by one at most, larger ones first."""
    n = df.count()
    base, extra = divmod(n, folds)
    cut = extra * (base + 1)
    out = _numbered(df, F.struct(hash_rank(F.col(key), seed), F.col(key)))
    late = F.lit(extra) + F.floor((F.col("_at") - cut) / max(base, 1))
    fold = F.when(F.col("_at") < cut, F.floor(F.col("_at") / (base + 1))).otherwise(late)
    return out.withColumn("fold", fold.cast("long")).drop("_at")


def route_by_thresholds(value: Column, thresholds: list[float]) -> Column:
    """How many of the thresholds the value has reached."""
    total = F.lit(0)
    for t in thresholds:
        total = total + (value >= t).cast("int")
    return total


def piecewise(route: Column, branches: dict[int, Column], default: Column) -> Column:
    out = None
    for key, branch in branches.items():
        out = F.when(route == key, branch) if out is None else out.when(route == key, branch)
    return default if out is None else out.otherwise(default)


def quantile_buckets(df: DataFrame, column: str, cuts: list[float], name: str = "bucket") -> DataFrame:
    """A row for each quantile range that holds it, ends included, so cut rows are in two."""
    from quern.operators.quantiles import quantiles

    bounds = quantiles(df, F.col(column), cuts).withColumnRenamed("q", "_q")
    ranges = F.transform(F.sequence(F.lit(0), F.lit(len(cuts) - 2)), lambda i: F.struct(i.alias("i"), F.get("_q", i).alias("lo"), F.get("_q", i + 1).alias("hi")))
    out = df.crossJoin(F.broadcast(bounds)).withColumn("_r", F.explode(ranges))
    out = out.where((F.col(column) >= F.col("_r.lo")) & (F.col(column) <= F.col("_r.hi")))
    return out.withColumn(name, F.col("_r.i")).drop("_q", "_r")


def drop_incomplete(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows whose numbers are all there and finite: infinities and NaN count as missing."""
    used = columns or df.columns
    kinds = dict(df.dtypes)
    out = df
    for c in used:
        fine = F.col(c).isNotNull()
        out = out.where(fine & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))) if kinds[c] in ("double", "float") else fine)
    return out


def binary_like(df: DataFrame, columns: dict[str, Column], tolerance: float = 1e-9) -> DataFrame:
    """One row: whether all finite values of each column are 0 or 1; false without any."""
    like = lambda c: F.coalesce(F.bool_and((F.abs(finite(c)) <= tolerance) | (F.abs(finite(c) - 1) <= tolerance)), F.lit(False))
    return df.agg(*(like(c.cast("double")).alias(n) for n, c in columns.items()))


def target_code(value: Column, classes: int) -> Column:
    """A number as the nearest of the codes 0 .. classes - 1, halves to the even one."""
    return F.greatest(F.lit(0.0), F.least(F.lit(float(classes - 1)), F.bround(value, 0))).cast("int")


def recombine(df: DataFrame, split: str = "split") -> DataFrame:
    """Training rows and validation rows as one table again, without the split."""
    return df.where(F.col(split) == "train").unionByName(df.where(F.col(split) == "valid")).drop(split)


def numeric_plan(schema: list[dict], target: str) -> list[dict]:
    """The columns that a schema's features become: name, source, kind and, for one value of a vocabulary, value.

    A feature has a key and a dtype, and may have an encoder and a vocab. Categories without a vocabulary stay
    pending until ``fit_numeric``.
    """
    kinds = {"category": "onehot", "categorical": "onehot", "str": "onehot", "string": "onehot", "bool": "boolean", "boolean": "boolean"}
    names = {"numeric": "numeric", "identity": "numeric", "float": "numeric", "bool": "boolean", "boolean": "boolean", "onehot": "onehot", "one_hot": "onehot", "categorical": "onehot"}
    out = []
    for feature in schema:
        key, encoder = feature["key"], feature.get("encoder", "auto")
        kind = kinds.get(str(feature.get("dtype", "float")).lower(), "numeric") if encoder == "auto" else names.get(encoder)
        if kind is None:
            raise ValueError(f"unsupported encoder for feature {key}: {encoder}")
        if kind != "onehot":
            out.append({"name": key, "source": key, "kind": kind})
        elif feature.get("vocab"):
            out += [{"name": f"{key}={v}", "source": key, "kind": "onehot", "value": str(v)} for v in feature["vocab"]]
        else:
            out.append({"name": key, "source": key, "kind": "pending"})
    return [*out, {"name": target, "source": target, "kind": "target"}]


def fit_numeric(df: DataFrame, plan: list[dict]) -> list[dict]:
    """The plan with the vocabularies that were pending, in order; a null counts as the empty string."""
    out = []
    for c in plan:
        if c["kind"] == "pending":
            seen = df.select(F.coalesce(F.col(c["source"]).cast("string"), F.lit("")).alias("v"))
            out += [{"name": f"{c['source']}={v}", "source": c["source"], "kind": "onehot", "value": v} for v in categories(seen, "v")]
        else:
            out.append(c)
    return out


def transform_numeric(df: DataFrame, plan: list[dict], keep: list[str] | None = None) -> DataFrame:
    """One projection of all planned columns as doubles; features that are missing count as 0, a missing target raises."""
    columns = []
    for c in plan:
        if c["kind"] == "pending":
            raise ValueError(f"fit the vocabulary of {c['source']} first")
        if c["kind"] == "target" and c["source"] not in df.columns:
            raise KeyError(c["source"])
        there = F.col(f"`{c['source']}`") if c["source"] in df.columns else F.lit(None)
        if c["kind"] == "onehot":
            value = (F.coalesce(there.cast("string"), F.lit("")) == c["value"]).cast("double")
        elif c["kind"] == "boolean":
            value = F.coalesce(there.cast("boolean"), F.lit(False)).cast("double")
        else:
            value = there.cast("double") if c["kind"] == "target" else F.coalesce(there.cast("double"), F.lit(0.0))
        columns.append(value.alias(c["name"]))
    if df.isEmpty():
        raise ValueError("no rows to transform")
    return df.select(*(keep or []), *columns)


class BatchSchedule:
    """A replayable schedule of training batches: epoch and cursor are all its state.

    Batch ids come from ``batches`` by seed and epoch, so a checkpoint needs no generator's state, and
    restoring one skips no rows and repeats none. An epoch's rows are numbered once, as a table in the order of their batches: reading
    a batch skips the row groups of the others. The tables of the last two epochs are kept.
    """

    def __init__(self, df: DataFrame, key: str, size: int, shuffle: bool = False, drop_last: bool = False, seed: int = 42):
        self.df, self.key = df, key
        self.config = {"batch_size": max(1, size), "shuffle": shuffle, "drop_last": drop_last, "seed": seed}
        self.rows = df.count()
        if not self.rows:
            raise ValueError("a schedule needs at least one row")
        self.epoch, self.cursor = 0, 0
        self._numbered: list[tuple[int, DataFrame]] = []

    def _table(self) -> DataFrame:
        """The rows of this epoch with their batch ids."""
        if not self._numbered or self._numbered[-1][0] != self.epoch:
            c = self.config
            numbered = batches(self.df, self.key, min(c["batch_size"], self.rows), c["shuffle"], c["seed"], self.epoch, c["drop_last"])
            self._numbered.append((self.epoch, materialize(numbered.sortWithinPartitions("batch_id"), "schedule")))
            while len(self._numbered) > 2:  # batches of the epoch before may still be read
                _, old = self._numbered.pop(0)
                for folder in {f.rpartition("/")[0] for f in old.inputFiles()}:
                    remove(self.df.sparkSession, folder)
        return self._numbered[-1][1]

    def _last(self) -> int:
        size = self.config["batch_size"]
        whole = self.rows // size
        return max(1, whole if self.config["drop_last"] else -(-self.rows // size))

    def next(self) -> DataFrame:
        """The rows of the next batch, with epoch and batch_id."""
        out = self._table().where(F.col("batch_id") == self.cursor).withColumn("epoch", F.lit(self.epoch))
        self.cursor += 1
        if self.cursor >= self._last():
            self.epoch, self.cursor = self.epoch + 1, 0
        return out

    def state(self) -> dict:
        return {"epoch": self.epoch, "cursor": self.cursor, "rows": self.rows, "config": dict(self.config)}

    def restore(self, state: dict) -> None:
        if state["rows"] != self.rows:
            raise ValueError("the checkpoint is of a table with other rows")
        if state.get("config") and state["config"] != self.config:
            raise ValueError("the checkpoint is of another schedule")
        if state["epoch"] < 0 or not 0 <= state["cursor"] < self._last():
            raise ValueError("invalid cursor")
        self.epoch, self.cursor = state["epoch"], state["cursor"]


#: Comparisons by sign; equality is within floating-point tolerance.
COMPARE = {
    ">": lambda c, v: c > v,
    ">=": lambda c, v: c >= v,
    "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v,
    "==": lambda c, v: isclose(c, F.lit(float(v))),
    "!=": lambda c, v: ~isclose(c, F.lit(float(v))),
}


def predicate(spec: dict, column: Column, key: Column | None = None) -> Column:
    """A branch's condition: kind all, indices (of ``key``), threshold (op, value) or range (low, high, ends included)."""
    kind = spec.get("kind", "all")
    if kind == "all":
        return F.lit(True)
    if kind == "indices":
        return key.isin(list(spec["indices"]))
    if kind == "threshold":
        if spec["op"] not in COMPARE:
            raise ValueError(f"unknown operator {spec['op']}")
        return COMPARE[spec["op"]](column, spec["value"])
    if kind == "range":
        return (column >= spec["low"]) & (column <= spec["high"])
    raise ValueError(f"unknown kind {kind}")


def annotate(df: DataFrame, groups: dict[str, str]) -> DataFrame:
    """Columns marked with their feature group as metadata; data stay as they are."""
    out = df
    for column, group in groups.items():
        out = out.withMetadata(column, {**df.schema[column].metadata, "group": group})
    return out


def check_features(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` if it has all columns, as numbers; an error names those that are missing or of another type."""
    kinds = dict(df.dtypes)
    bad = [c for c in columns if kinds.get(c, "").split("(")[0] not in ("double", "float", "int", "bigint", "smallint", "tinyint", "decimal")]
    if bad:
        raise TypeError(f"not numeric: {', '.join(bad)}")
    return df


def sparsemax(values: Column) -> Column:
    """The nearest point of the probability simplex to an array: small entries become 0."""
    down = F.reverse(F.array_sort(values))
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n"), F.lit(0.0).alias("cut"))

    def step(acc: Column, v: Column) -> Column:
        total, n = acc["sum"] + v, acc["n"] + 1
        inside = 1 + n * v > total
        return F.struct(total.alias("sum"), n.alias("n"), F.when(inside, (total - 1) / n).otherwise(acc["cut"]).alias("cut"))

    cut = F.aggregate(down, start, step)["cut"]
    return F.transform(values, lambda v: F.greatest(v - cut, F.lit(0.0)))


def masked_mean(df: DataFrame, by: str, value: str, mask: str) -> DataFrame:
    """Mean of each group's values where the mask is set; 0 for groups without any."""
    return df.groupBy(by).agg(F.coalesce(F.try_divide(F.sum(F.when(F.col(mask), F.col(value))), F.count_if(F.col(mask)).cast("double")), F.lit(0.0)).alias("mean"))


def normalized_edges(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """src, dst and weight 1 / sqrt(degree x degree) of a graph's edges with each node linked to itself once."""
    loops = edges.select(F.explode(F.array(src, dst)).alias(src)).distinct().select(src, F.col(src).alias(dst))
    every = edges.where(F.col(src) != F.col(dst)).select(src, dst).distinct().unionByName(loops)
    degree = every.groupBy(src).agg(F.count("*").alias("_n"))
    other = degree.select(F.col(src).alias(dst), F.col("_n").alias("_m"))
    return every.join(degree, src).join(other, dst).select(src, dst, (1 / F.sqrt(F.col("_n").cast("double") * F.col("_m"))).alias("weight"))
