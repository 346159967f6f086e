"""Factor research: forward returns, rank correlations, cross-sectional ranks and signals, folds, leakage and multiple-testing checks, regimes."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .portfolio import solved
from .scans import numbered, rank_correlation, tiled


def by_symbol() -> Window:
    return Window.partitionBy("symbol").orderBy("date")



def forward_return(h: int, price: str = "close") -> Column:
    """The price h rows on, against this one."""
    return F.try_divide(F.lead(price, h).over(by_symbol()), price) - 1


def average_rank(value: Column, *partition: str) -> Column:
    """Ranks with ties at their mean; null values have none."""
    # nulls form a partition part of their own, so they don't shift ranks
    own = Window.partitionBy(*partition, value.isNull())
    return F.when(value.isNotNull(), F.rank().over(own.orderBy(value)) + (F.count("*").over(Window.partitionBy(*partition, value)) - 1) / 2)


def percent_rank(value: Column, *partition: str) -> Column:
    """Average rank over the number of non-null values (pandas' rank(pct=True))."""
    return average_rank(value, *partition) / F.count(value).over(Window.partitionBy(*partition))


def spearman(df: DataFrame, x: str, y: str, *by: str) -> DataFrame:
    """Rank correlation of non-null pairs in each group, 0 where undefined. Ranks are counted in range blocks, so a few large groups don't lie in a few tasks."""
    return rank_correlation(df, x, y, list(by))


def _ranks(windows: np.ndarray) -> np.ndarray:
    """Average ranks within each row."""
    order = np.argsort(windows, axis=1)  # ties share a rank, in whatever order
    ordered = np.take_along_axis(windows, order, axis=1)
    n = windows.shape[1]
    new = np.ones(windows.shape, bool)
    new[:, 1:] = ordered[:, 1:] != ordered[:, :-1]
    at = np.arange(n)
    first = np.maximum.accumulate(np.where(new, at, 0), axis=1)
    end = np.ones(windows.shape, bool)
    end[:, :-1] = new[:, 1:]
    last = np.minimum.accumulate(np.where(end, at, n)[:, ::-1], axis=1)[:, ::-1]
    out = np.empty(windows.shape)
    np.put_along_axis(out, order, (first + last) / 2, axis=1)
    return out


def rolling_rank_ic(long: DataFrame, window: int = 60) -> DataFrame:
    """(feature, horizon, symbol, date, ic) of rows (feature, horizon, symbol, date, x, y).

    Ranks are taken inside each window, so this is a grouped pass over a symbol's rows, of which each feature and horizon is a series of its own; a panel
    that is partitioned by symbol isn't shuffled again. Windows never cross symbols, and the last row ends none. Pairs with a null are left out first.
    """
    kind = dict(long.dtypes)["symbol"]

    def centred(v: np.ndarray, known: list) -> tuple[np.ndarray, np.ndarray]:
        """Ranks within each window less their mean, and their sums of squares; those of a series that begins with this one serve again."""
        for w, ranks, sizes in known:
            if len(v) <= len(w) and np.array_equal(v, w[: len(v)]):
                return ranks[: len(v) - window], sizes[: len(v) - window]
        views = np.lib.stride_tricks.sliding_window_view(v, window)[:-1]  # windows end at rows window - 1 .. n - 2
        ranks = np.concatenate([_ranks(views[at : at + 4096]) for at in range(0, len(views), 4096)])
        ranks -= ranks.mean(axis=1, keepdims=True)
        known.append((v, ranks, np.einsum("ij,ij->i", ranks, ranks)))
        return known[-1][1:]

    def run(tab: pa.Table) -> pa.Table:
        tab = tab.sort_by([(c, "ascending") for c in ("feature", "horizon", "date")])
        f, h = np.asarray(tab["feature"]), np.asarray(tab["horizon"])
        ends = [*(np.flatnonzero((f[1:] != f[:-1]) | (h[1:] != h[:-1])) + 1), len(f)]
        x, y = (np.asarray(tab[c], float) for c in ("x", "y"))
        rows, ics, known = [], [], ([], [])
        for at, end in zip([0, *ends[:-1]], ends, strict=True):
            if end - at > window:
                (a, aa), (b, bb) = centred(x[at:end], known[0]), centred(y[at:end], known[1])
                size = np.sqrt(aa * bb)
                ics.append(np.divide(np.einsum("ij,ij->i", a, b), size, out=np.full(len(a), np.nan), where=size > 0))
                rows.append(np.arange(at + window - 1, end - 1))
        out = tab.select(["feature", "horizon", "symbol", "date"]).take(pa.array(np.concatenate([*rows, np.empty(0, np.int64)]).astype(np.int64)))
        return out.append_column("ic", pa.array(np.concatenate([*ics, np.empty(0)]), pa.float64()))

    pairs = long.where("x is not null and y is not null").select("feature", "horizon", "symbol", "date", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    return pairs.groupBy("symbol").applyInArrow(run, f"feature string, horizon int, symbol {kind}, date date, ic double").withColumn("ic", F.when(~F.isnan("ic"), F.col("ic")))


def ic_summary(ics: DataFrame) -> DataFrame:
    """Mean, population deviation (at least 1e-8), information ratio and size, per feature and horizon."""
    std = F.greatest(F.stddev_pop("ic"), F.lit(1e-8))
    return ics.where("ic is not null").groupBy("feature", "horizon").agg(F.avg("ic").alias("mean_ic"), std.alias("std_ic"), (F.avg("ic") / std).alias("ir"), F.count("*").alias("n"))


def classify(ic: Column) -> Column:
    """Strength of a signal by |IC|."""
    a = F.abs(ic)
    return F.when(a >= 0.05, "strong").when(a >= 0.03, "moderate").when(a >= 0.02, "weak").otherwise("none")


def rank_signal(prediction: str, top: float) -> Column:
    """1.0 for the top share of each date's names (at least one), by prediction, then symbol."""
    w = Window.partitionBy("date")
    n = F.greatest(F.lit(1), F.ceil(F.count("*").over(w) * F.lit(top)))
    return F.when(F.row_number().over(w.orderBy(F.desc_nulls_last(prediction), "symbol")) <= n, 1.0).otherwise(0.0)


def threshold_signal(prediction: str, t: float) -> Column:
    return F.when(F.col(prediction) >= t, 1.0).otherwise(0.0)


def zscore(x: str, *partition: str) -> Column:
    """Distance from the date's mean in sample deviations; 0 where these aren't positive."""
    w = Window.partitionBy(*partition)
    sd = F.stddev_samp(x).over(w)
    return F.when(F.col(x).isNotNull(), F.when(sd > 1e-12, (F.col(x) - F.avg(x).over(w)) / sd).otherwise(0.0))


def fold_table(n: int, folds: int, test: int, purge: int = 0, expanding: bool = True, train: int = 0) -> list[tuple[int, int, int, int, int]]:
    """(fold, train_start, train_end, test_start, test_end) as inclusive row numbers from 1; the last fold takes the remainder."""
    out = []
    first = n - folds * test
    for k in range(folds):
        start = first + k * test + 1
        end = start + test - 1 if k < folds - 1 else n
        last = start - 1 - purge
        out.append((k + 1, 1 if expanding else max(1, last - train + 1), last, start, end))
    return out


def with_folds(df: DataFrame, folds: list[tuple[int, int, int, int, int]], days: DataFrame | None = None) -> DataFrame:
    """Rows of each fold with role train or test, by the number of their date among all dates (`days`, where these are at hand)."""
    days = df.select("date").distinct() if days is None else days
    numbered = days.withColumn("day", F.row_number().over(Window.orderBy("date")))  # one row a date
    plan = df.sparkSession.createDataFrame(folds, "fold int, train_start int, train_end int, test_start int, test_end int")
    held = F.broadcast(numbered.crossJoin(F.broadcast(plan)).where("day between train_start and train_end or day between test_start and test_end").select("date", "fold", F.when(F.expr("day between test_start and test_end"), "test").otherwise("train").alias("role")))
    return df.join(held, "date")


#: Screen -> (feature, descending, only positive values, only names that were priced in the week before).
SCREENS = {
    "momentum": ("momentum_20d", True, False, True), "unusual-volume": ("volume_ratio", True, False, True), "oversold": ("rsi_14d", False, False, True), "strong-trend": ("adx_14d", True, False, True),
    "above-trend": ("price_to_sma_200d", True, True, True), "low-volatility": ("volatility_20d", False, True, True), "value": ("pe_ratio", False, True, False), "dividends": ("dividend_yield", True, True, False),
}


def screened(newest: DataFrame, continuous: Column, top: int = 25, screens: dict[str, tuple[str, bool, bool, bool]] = SCREENS) -> DataFrame:
    """(screen, rank, symbol, value) of all screens in one pass over a row a symbol with all features; ties go to the smaller symbol.

    Each row gives one entry for every screen it qualifies for, with the value's sign turned where the largest come first. Of these each task keeps the
    `top` of each screen before anything is shuffled (a group limit below the exchange), so what meets at the end is screens x top x tasks.
    """
    entries = []
    for name, (feature, down, positive, held) in screens.items():
        v = F.col(feature)
        fits = v.isNotNull() & (v > 0 if positive else F.lit(True)) & (continuous if held else F.lit(True))
        entries.append(F.when(fits, F.struct(F.lit(name).alias("screen"), v.cast("double").alias("value"), (-v if down else v).cast("double").alias("__key"))))
    each = newest.select("symbol", F.explode(F.array_compact(F.array(*entries))).alias("e")).select("symbol", "e.*")
    rank = F.row_number().over(Window.partitionBy("screen").orderBy("__key", "symbol"))
    return each.withColumn("rank", rank).where(F.col("rank") <= top).select("screen", "rank", "symbol", "value")


def after_embargo(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """Test rows without the first `rows` of each group, in order of date and symbol; a group that has no more than these keeps all."""
    sizes = df.groupBy(*by).agg(F.count("*").alias("__n"))
    d = numbered(df, list(by), ["date", "symbol"], "__i").join(F.broadcast(sizes), list(by))  # a row a group
    return d.where((F.col("__i") > rows) | (F.col("__n") <= rows)).drop("__i", "__n")


def fold_metrics(df: DataFrame, y: str, p: str, *by: str) -> DataFrame:
    """Mse, mae, r2 and rank IC of non-null pairs."""
    pairs = written(df.where(F.col(y).isNotNull() & F.col(p).isNotNull()).select(*by, y, p), "pairs")
    err = F.col(y) - F.col(p)
    base = pairs.groupBy(*by).agg(F.avg(err * err).alias("mse"), F.avg(F.abs(err)).alias("mae"), (1 - F.try_divide(F.sum(err * err), F.var_pop(y) * F.count("*"))).alias("r2"), F.count("*").alias("n"))
    return base.join(spearman(pairs, y, p, *by).drop("n"), list(by))


def binned_information(df: DataFrame, x: str, y: str, bins: int, *by: str) -> DataFrame:
    """Mutual information of quantile bins, from counts; bins by row numbers in range blocks."""
    cell = written(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, "date", "symbol", x, y), "pairs")
    for c, b in ((x, "bx"), (y, "by_")):
        cell = tiled(cell, list(by), [c, "date", "symbol"], bins, b)
    cell = cell.groupBy(*by, "bx", "by_").agg(F.count("*").alias("n"))
    all_, wx, wy = Window.partitionBy(*by), Window.partitionBy(*by, "bx"), Window.partitionBy(*by, "by_")
    term = F.col("n") / F.sum("n").over(all_) * F.log(F.col("n") * F.sum("n").over(all_) / (F.sum("n").over(wx) * F.sum("n").over(wy)))
    return cell.withColumn("term", term).groupBy(*by).agg(F.sum("term").alias("information"))


def refit_predictions(df: DataFrame, features: list[str], y: str, lookback: int, every: int, horizon: int, ridge: float = 0.0, least: int = 50) -> DataFrame:
    """(symbol, date, refit_date, prediction): ridge models refitted every `every` dates on the `lookback` dates before, carried forward between.

    The last `horizon` training dates are left out, as their targets reach beyond the refit. Sums of cross-products are taken once per date; a refit's are
    window sums over these, one row a date, so no row of the panel is read again for another refit. A symbol without all features on the refit date
    has no prediction until the next; a refit of fewer than `least` rows makes none.
    """
    m, x = len(features), [F.col(f) for f in features]
    ok = F.col(y).isNotNull()
    for c in x:
        ok = ok & c.isNotNull()
    pick = lambda c: F.sum(F.when(ok, c).otherwise(0.0))
    sums = {"n": F.count_if(ok).cast("double"), "y": pick(F.col(y)), **{f"x{i}": pick(x[i]) for i in range(m)}, **{f"p{i}": pick(x[i] * F.col(y)) for i in range(m)}, **{f"q{i}_{j}": pick(x[i] * x[j]) for i in range(m) for j in range(i, m)}}
    daily = df.groupBy("date").agg(*[v.alias(k) for k, v in sums.items()])
    w = Window.orderBy("date")  # one row a date
    daily = daily.withColumn("day", F.row_number().over(w) - 1)
    back = w.rowsBetween(-lookback, -1 - horizon)
    rolled = daily.select("date", "day", *[F.sum(k).over(back).alias(k) for k in sums]).where((F.col("day") >= lookback) & ((F.col("day") - lookback) % every == 0) & (F.col("n") >= least))
    q = lambda i, j: F.col(f"q{min(i, j)}_{max(i, j)}") - F.col(f"x{i}") * F.col(f"x{j}") / F.col("n") + (ridge if i == j else 0.0)
    fitted = solved(rolled, [[q(i, j) for j in range(m)] for i in range(m)], [F.col(f"p{i}") - F.col(f"x{i}") * F.col("y") / F.col("n") for i in range(m)], [f"__b{i}" for i in range(m)])
    fitted = fitted.select(F.col("date").alias("refit_date"), *[f"__b{i}" for i in range(m)], ((F.col("y") - sum((F.col(f"__b{i}") * F.col(f"x{i}") for i in range(m)), F.lit(0.0))) / F.col("n")).alias("__b"))
    score = F.col("__b") + sum((F.col(f"__b{i}") * x[i] for i in range(m)), F.lit(0.0))
    on_refit = df.select("symbol", "date", *features).join(fitted, F.col("date") == F.col("refit_date")).select("symbol", "refit_date", score.alias("prediction")).where("prediction is not null")
    carried = F.last(F.when((F.col("day") >= lookback) & ((F.col("day") - lookback) % every == 0), F.col("date")), ignorenulls=True).over(w)
    plan = daily.select("date", carried.alias("refit_date")).where("refit_date is not null")
    return df.select("symbol", "date").join(plan, "date").join(on_refit, ["symbol", "refit_date"]).select("symbol", "date", "refit_date", "prediction")


def cross_products(df: DataFrame, features: list[str], y: str, *by: str) -> DataFrame:
    """(by, n, mean, my, gram, moment): of the rows without nulls, the features' means, their centred cross-products and those with y, by one aggregation."""
    m = len(features)
    d = df.where(" and ".join(f"`{c}` is not null" for c in (*features, y)))
    x = [F.col(f) for f in features]
    pairs = [(i, j) for i in range(m) for j in range(i, m)]
    g = d.groupBy(*by).agg(F.count("*").cast("double").alias("n"), F.array(*[F.avg(c) for c in x]).alias("mean"), F.avg(y).alias("my"), *[(F.covar_pop(x[i], x[j]) * F.count("*")).alias(f"__g{i}_{j}") for i, j in pairs], *[(F.covar_pop(x[i], F.col(y)) * F.count("*")).alias(f"__m{i}") for i in range(m)])
    at = lambda i, j: F.col(f"__g{min(i, j)}_{max(i, j)}")
    return g.select(*by, "n", "mean", "my", F.array(*[F.array(*[at(i, j) for j in range(m)]) for i in range(m)]).alias("gram"), F.array(*[F.col(f"__m{i}") for i in range(m)]).alias("moment"))


def penalised(sums: DataFrame, alpha: str | float, l1_ratio: str | float, sweeps: int = 200) -> DataFrame:
    """cross_products() with `beta` and `intercept` of the least sum of squares / 2n + alpha * (l1_ratio * |beta| + (1 - l1_ratio) / 2 * beta^2): lasso for a
    ratio of 1, ridge for 0, elastic net between. alpha and l1_ratio may be columns.

    Coordinate descent on the cross-products alone: each step of a fold over one array of coefficients, so rows of the panel are read once, for any number of
    folds and penalties. A feature that doesn't vary has coefficient 0.
    """
    a, ratio = (F.col(v) if isinstance(v, str) else F.lit(float(v)) for v in (alpha, l1_ratio))
    m = F.size("moment")

    def step(beta, k):
        j = (k % m).cast("int")
        row = F.get("gram", j)
        dot = F.aggregate(F.zip_with(row, beta, lambda g, b: g * b), F.lit(0.0), lambda u, v: u + v)
        pull = (F.get("moment", j) - dot + F.get(row, j) * F.get(beta, j)) / F.col("n")
        soft = F.signum(pull) * F.greatest(F.abs(pull) - a * ratio, F.lit(0.0))
        new = F.coalesce(F.try_divide(soft, F.get(row, j) / F.col("n") + a * (1 - ratio)), F.lit(0.0))
        return F.transform(beta, lambda b, i: F.when(i == j, new).otherwise(b))

    beta = F.aggregate(F.sequence(F.lit(0), m * sweeps - 1), F.transform("moment", lambda _: F.lit(0.0)), step)
    fitted = sums.withColumn("beta", beta)
    return fitted.withColumn("intercept", F.col("my") - F.aggregate(F.zip_with("beta", "mean", lambda b, x: b * x), F.lit(0.0), lambda u, v: u + v))


def sharpe_decay(train: Column, test: Column) -> Column:
    """Share of the training Sharpe that is lost out of sample: 1 where the test's is negative, 0 where the training's isn't positive."""
    return F.when(test < 0, 1.0).when(train <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), (train - test) / train))


def leakage(corr: Column, name: Column) -> Column:
    """Severity of a feature's correlation with the target, or of its name."""
    return F.when(F.abs(corr) >= 0.95, "critical").when(F.abs(corr) >= 0.85, "warning").when(F.lower(name).rlike(r"future|next|forward|lead|target|t\+\d"), "name").otherwise("ok")


def corrected(p_values: DataFrame, key: str, alpha: float = 0.05) -> DataFrame:
    """Bonferroni, and Benjamini-Hochberg step-up: all tests up to the last that passes its rank's level."""
    w = Window.orderBy("p", key)  # one row a test
    ranked = p_values.withColumn("rank", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy()))
    last = F.max(F.when(F.col("p") <= F.col("rank") * alpha / F.col("n"), F.col("rank"))).over(Window.partitionBy())
    return ranked.select(key, "p", "rank", (F.col("p") <= alpha / F.col("n")).alias("bonferroni"), (F.col("rank") <= F.coalesce(last, F.lit(0))).alias("bh"))


def regime(volatility: str, price: str, average: str, calm: float = 0.18) -> Column:
    """Low or high volatility, bull or bear."""
    return F.when(F.col(volatility).isNotNull() & F.col(average).isNotNull(), F.concat(F.when(F.col(volatility) < calm, "low_vol").otherwise("high_vol"), F.when(F.col(price) > F.col(average), F.lit("_bull")).otherwise(F.lit("_bear"))))


def runs(df: DataFrame, label: str, key: str = "symbol", at: str = "date") -> DataFrame:
    """Stretches of equal labels: start, end and length."""
    w = Window.partitionBy(key).orderBy(at)
    island = F.sum(F.when(F.col(label).eqNullSafe(F.lag(label).over(w)) & F.lag(at).over(w).isNotNull(), 0).otherwise(1)).over(w)
    return df.withColumn("island", island).groupBy(key, "island", label).agg(F.min(at).alias("start"), F.max(at).alias("end"), F.count("*").alias("length")).drop("island")


def holds(kind: str, params: list[str], value: float = 0.0, upper: float | None = None) -> Column:
    """Whether a row's parameters satisfy a constraint of one of the fourteen kinds; a missing parameter is 0."""
    p = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in params]
    total, product = sum(p, F.lit(0.0)), F.lit(1.0)
    for c in p:
        product = product * c
    nonzero = sum((F.when(c != 0, 1).otherwise(0) for c in p), F.lit(0))
    near = lambda a, b: F.abs(a - b) <= 1e-8 + 1e-5 * F.abs(b)
    within = lambda c: (c >= value) if upper is None else (c >= value) & (c <= upper)
    every = lambda cs: F.lit(True) if not cs else F.forall(F.array(*cs), lambda x: x)
    second = p[1] if len(p) > 1 else F.lit(None).cast("double")
    return {
        "sum_equals": lambda: near(total, F.lit(float(value))), "max_total": lambda: total <= value, "min_total": lambda: total >= value,
        "difference_min": lambda: F.coalesce(p[0] - second >= value, F.lit(True)), "difference_max": lambda: F.coalesce(p[0] - second <= value, F.lit(True)),
        "ratio_bound": lambda: F.coalesce(within(F.try_divide(p[0], second)), F.lit(True)), "exclusion": lambda: nonzero <= 1, "range_bound": lambda: within(p[0]),
        "product_max": lambda: product <= value, "product_min": lambda: product >= value,
        "same_sign": lambda: ~(F.exists(F.array(*p), lambda x: x > 0) & F.exists(F.array(*p), lambda x: x < 0)) if len(p) > 1 else F.lit(True),
        "step_multiple": lambda: every([near(c % value, F.lit(0.0)) | near(c % value, F.lit(float(value))) for c in p] if value else []),
        "monotonic_increasing": lambda: every([a < b for a, b in zip(p, p[1:], strict=False)]), "at_least_n_nonzero": lambda: nonzero >= int(value),
    }[kind]()


def checked(combos: DataFrame, constraints: dict[str, Column]) -> DataFrame:
    """Combinations with `broken`, the names of the constraints that they violate; valid ones have none."""
    return combos.withColumn("broken", F.array_compact(F.array(*[F.when(~c, name) for name, c in constraints.items()])))


def combinations(params: dict[str, list[float]], constraints: dict[str, Column], spark) -> DataFrame:
    """The product of a caller's few parameter values, checked."""
    rows = [tuple(float(v) for v in vals) for vals in itertools.product(*params.values())]
    return checked(spark.createDataFrame(rows, ", ".join(f"{name} double" for name in params)), constraints)
