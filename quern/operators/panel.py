"""Cross-sectional panels of assets by date: features, walk-forward folds, rank correlation, portfolios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.guards import average_rank, safe_corr
from quern.operators.prep import categorical_code


def wide_to_long(df: DataFrame, date: str, assets: list[str]) -> DataFrame:
    """date, ticker, ret from a column for each asset; infinite values and rows with gaps go."""
    clean = df
    for a in assets:
        clean = clean.where(F.col(a).isNotNull() & ~F.isnan(a) & (F.abs(a) < F.lit(float("inf"))))
    return clean.unpivot([date], assets, "ticker", "ret")


def features(panel: DataFrame, date: str, asset: str, ret: str, horizon: int = 1, short: int = 5, long: int = 20) -> DataFrame:
    """Target, last return, means over ``short`` and ``long`` rows, sample deviation, market and relative strength.

    Rows without full windows or a target go. Windows are by asset; the market is an aggregate by date.
    ``features_full`` has the lagged and market windows and the asset's code besides.
    """
    w = Window.partitionBy(asset).orderBy(date)
    over = lambda n: w.rowsBetween(1 - n, 0)
    full = lambda c, n: F.when(F.count(ret).over(over(n)) == n, c.over(over(n)))
    market = panel.groupBy(date).agg(F.avg(ret).alias("market_ret"))
    rows = panel.select(
        date,
        asset,
        F.lead(ret, horizon).over(w).alias("target"),
        F.col(ret).alias("ret_1"),
        full(F.avg(ret), short).alias("mom_short"),
        full(F.avg(ret), long).alias("mom_long"),
        full(F.stddev_samp(ret), long).alias("vol_long"),
    ).join(market, date)
    rows = rows.withColumn("rel_mom", F.col("ret_1") - F.col("market_ret"))
    return rows.dropna()


def features_full(panel: DataFrame, date: str, asset: str, ret: str, horizon: int = 1, short: int = 5, long: int = 20) -> DataFrame:
    """target, ret_lag_1 and 2, mom_5 and 20, vol_20, market_ret_1, market_mom_5, relative_mom_20 and ticker_code.

    The names are those of the default windows. Market windows run over dates, one row each; a date's market is the mean of its assets.
    """
    w, by_date = Window.partitionBy(asset).orderBy(date), Window.orderBy(date)
    def mean(c: str, n: int, over) -> Column:
        rows = over.rowsBetween(1 - n, 0)
        return F.when(F.count(c).over(rows) == n, F.avg(c).over(rows))

    market = panel.groupBy(date).agg(F.avg(ret).alias("market_ret_1"))
    market = market.select(date, "market_ret_1", mean("market_ret_1", short, by_date).alias("market_mom_5"), mean("market_ret_1", long, by_date).alias("_market_long"))
    full = w.rowsBetween(1 - long, 0)
    rows = panel.select(
        date, asset, F.lead(ret, horizon).over(w).alias("target"), F.col(ret).alias("ret_lag_1"), F.lag(ret, 1).over(w).alias("ret_lag_2"),
        mean(ret, short, w).alias("mom_5"), mean(ret, long, w).alias("mom_20"), F.when(F.count(ret).over(full) == long, F.stddev_samp(ret).over(full)).alias("vol_20"),
    )
    rows = rows.join(market, date).withColumn("relative_mom_20", F.col("mom_20") - F.col("_market_long")).drop("_market_long")
    return categorical_code(rows.dropna(), asset, "ticker_code").withColumn("ticker_code", F.col("ticker_code").cast("double"))


def drawdown(df: DataFrame, ret: Column, order: str, by: list[str]) -> DataFrame:
    """Every row with the fall of its series' compounded returns from their highest point so far."""
    w = Window.partitionBy(*by).orderBy(order)
    level = df.withColumn("_level", F.sum(F.log1p(ret)).over(w))
    return level.withColumn("drawdown", F.exp(F.col("_level") - F.max("_level").over(w)) - 1).drop("_level")


#: What a walk-forward run is summed up by.
RUN_METRICS = ("test_rmse", "direction_accuracy", "rank_ic", "hit_rate", "net_sharpe", "max_drawdown_abs", "turnover")


def run_summary(folds: DataFrame, names: tuple[str, ...] = RUN_METRICS) -> DataFrame:
    """Mean of each metric over the folds, the population deviation of rank_ic, and the number of folds; what is missing counts as 0."""
    value = lambda n: F.coalesce(F.col(n).cast("double"), F.lit(0.0))
    means = [F.coalesce(F.avg(value(n)), F.lit(0.0)).alias(f"{n}_mean") for n in names]
    return folds.agg(*means, F.coalesce(F.stddev_pop(value("rank_ic")), F.lit(0.0)).alias("rank_ic_std"), F.count("*").alias("folds"))


def cap_dates(dates: DataFrame, date: str, assets: int, rows: int, from_tail: bool) -> DataFrame:
    """The last or first dates that hold at most ``rows`` rows of ``assets`` each, one date at least; all without a cap."""
    if rows <= 0:
        return dates
    return dates.orderBy(F.desc(date) if from_tail else F.asc(date)).limit(max(1, rows // max(1, assets)))


def walk_forward_folds(panel: DataFrame, date: str, min_train: int, test: int, step: int, mode: str = "expanding", train_window: int = 0, max_folds: int = 2) -> DataFrame:
    """fold, split and date: the dates of every fold's training and test part.

    Folds are rows of arithmetic on the dates' ranks; no date list leaves the executors.
    """
    dates = panel.select(date).distinct().withColumn("_at", F.row_number().over(Window.orderBy(date)) - 1)
    n = dates.agg(F.count("*").alias("_n"))
    folds = n.select(F.explode(F.sequence(F.lit(0), F.lit(max_folds - 1))).alias("fold"), "_n")
    start = F.lit(min_train) + F.col("fold") * step
    folds = folds.select("fold", start.alias("_cut"), F.least(start + test, F.col("_n")).alias("_end")).where(F.col("_cut") + test <= F.col("_n"))
    low = F.lit(0) if mode == "expanding" else F.greatest(F.lit(0), F.col("_cut") - train_window)
    both = folds.crossJoin(dates).where((F.col("_at") >= low) & (F.col("_at") < F.col("_end")))
    return both.select("fold", F.when(F.col("_at") < F.col("_cut"), "train").otherwise("test").alias("split"), date)


def daily_rank_ic(panel: DataFrame, date: str, pred: str, target: str, least: int = 3) -> DataFrame:
    """Spearman correlation of prediction and target on each date with enough rows."""
    ranked = panel.select(date, average_rank(F.col(pred), date).alias("rp"), average_rank(F.col(target), date).alias("rt"))
    daily = ranked.groupBy(date).agg(F.count("*").alias("n"), safe_corr(F.col("rp"), F.col("rt")).alias("ic"))
    return daily.where(F.col("n") >= least)


def portfolio(panel: DataFrame, date: str, asset: str, pred: str, target: str, top: int, cost: float = 0.0005) -> DataFrame:
    """By date: gross and net return of the ``top`` predictions, turnover, equity and drawdown.

    The picks of a date are few (``top``), so arrays of them are small; the date series itself is
    short, one row a date.
    """
    rank = F.row_number().over(Window.partitionBy(date).orderBy(F.desc(pred), asset))
    picks = panel.withColumn("_r", rank).where(F.col("_r") <= top)
    daily = picks.groupBy(date).agg(F.avg(target).alias("gross"), F.array_sort(F.collect_set(asset)).alias("held"))
    w = Window.orderBy(date)
    before = F.lag("held").over(w)
    shared, united = F.size(F.array_intersect("held", "_before")), F.size(F.array_union("held", "_before"))
    daily = daily.withColumn("_before", before)
    daily = daily.withColumn("turnover", F.when(F.col("_before").isNull(), 1.0).otherwise(1 - shared / united))
    daily = daily.withColumn("net", F.col("gross") - cost * F.col("turnover"))
    equity = F.exp(F.sum(F.log1p("net")).over(w))
    daily = daily.withColumn("equity", equity)
    daily = daily.withColumn("drawdown", F.col("equity") / F.max("equity").over(w) - 1)
    return daily.select(date, "gross", "turnover", "net", "equity", "drawdown")


def portfolio_summary(daily: DataFrame) -> DataFrame:
    """Annualised Sharpe proxy, worst drawdown, mean turnover and hit rate."""
    sharpe: Column = F.coalesce(F.try_divide(F.avg("net"), F.stddev_pop("net")) * F.sqrt(F.lit(252.0)), F.lit(0.0))
    return daily.agg(
        sharpe.alias("sharpe"),
        F.min("drawdown").alias("max_drawdown"),
        F.avg("turnover").alias("turnover"),
        F.avg((F.col("net") > 0).cast("double")).alias("hit_rate"),
    )


def direction_accuracy(panel: DataFrame, pred: str, target: str) -> DataFrame:
    return panel.agg(F.avg((F.signum(pred) == F.signum(target)).cast("double")).alias("direction_accuracy"))
