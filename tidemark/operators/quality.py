"""Data quality: anomalies, completeness, gaps, staleness, row and reference constraints, retention, duplicates, health scores, provenance hashes.

Checks return issues (check, symbol, date, severity, detail) as rows of one shape, so that a report is their union.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import tasks


def by_symbol() -> Window:
    return Window.partitionBy("symbol").orderBy("date")


def issues(df: DataFrame, check: str, severity: Column, date: str = "date", detail: Column | None = None) -> DataFrame:
    return df.select(F.lit(check).alias("check"), "symbol", F.col(date).alias("date"), severity.alias("severity"), (F.lit(None).cast("double") if detail is None else detail.cast("double")).alias("detail"))


def price_anomalies(prices: DataFrame, actions: DataFrame, threshold: float = 0.5, critical: float = 0.9) -> DataFrame:
    """Q01: day-on-day moves beyond the threshold without a corporate action that day. Actions are an anti join after the lag, so two on a day add no rows."""
    moved = prices.withColumn("pct", F.try_divide("close", F.lag("close").over(by_symbol())) - 1).where(F.abs("pct") > threshold)
    moved = moved.repartition(tasks(prices), "symbol", "date").join(actions.select("symbol", "date").distinct(), ["symbol", "date"], "left_anti")
    return issues(moved, "price_anomaly", F.when(F.abs("pct") > critical, "critical").otherwise("warning"), detail=F.col("pct"))


def missing_on(active: DataFrame, prices: DataFrame, day: str) -> DataFrame:
    """Q02: active symbols without a price on the day."""
    return active.select("symbol").distinct().join(prices.where(F.col("date") == F.lit(day).cast("date")).select("symbol"), "symbol", "left_anti")


def gaps(prices: DataFrame, calendar: DataFrame, share: float = 0.8, critical: int = 10) -> DataFrame:
    """Q03: symbols with fewer than `share` of the sessions but the last; n_missing and the first five missing dates. The calendar is one row a session."""
    sessions = calendar.select("date").distinct()
    last = sessions.agg(F.max("date").alias("last"))
    every = sessions.join(F.broadcast(last), F.col("date") < F.col("last")).agg(F.array_sort(F.collect_list("date")).alias("sessions"))  # one row: a calendar
    own = prices.groupBy("symbol").agg(F.collect_set("date").alias("own"))  # a symbol's days, at most the calendar's
    missing = F.array_except("sessions", "own")
    flagged = own.join(F.broadcast(every)).select("symbol", F.size("sessions").cast("long").alias("expected"), missing.alias("missing")).withColumn("n_missing", F.size("missing").cast("long"))
    flagged = flagged.where((F.col("n_missing") > 0) & (F.col("expected") - F.col("n_missing") < F.floor(share * F.col("expected"))))
    return flagged.select("symbol", "expected", "n_missing", F.slice("missing", 1, 5).alias("first_missing"), F.when(F.col("n_missing") > critical, "critical").otherwise("warning").alias("severity"))


def stale(active: DataFrame, prices: DataFrame, day: str, days: int = 3, critical: int = 7) -> DataFrame:
    """Q04: active symbols whose newest price is missing or older than `days`."""
    last = prices.groupBy("symbol").agg(F.max("date").alias("last_date"))
    age = F.date_diff(F.lit(day).cast("date"), F.col("last_date"))
    own = active.select("symbol").distinct().join(last, "symbol", "left").withColumn("age", age).where("last_date is null or age > %d" % days)
    return own.withColumn("severity", F.when(F.col("last_date").isNull() | (F.col("age") > critical), "critical").otherwise("warning"))


def volume_anomalies(prices: DataFrame, factor: float = 10.0) -> DataFrame:
    """Q05: no volume (warning), or more than `factor` times the mean of the 20 rows before (info)."""
    mean = F.avg("volume").over(by_symbol().rowsBetween(-20, -1))
    v = prices.withColumn("mean", mean)
    kind = F.when(F.col("volume").isNull() | (F.col("volume") == 0), "warning").when(F.col("volume") > factor * F.col("mean"), "info")
    return issues(v.withColumn("kind", kind).where("kind is not null"), "volume_anomaly", F.col("kind"), detail=F.col("volume"))


def row_checks(prices: DataFrame) -> DataFrame:
    """Q06: how many rows break each rule, in one pass."""
    rules = {
        **{f"null_{c}": F.col(c).isNull() for c in ("open", "high", "low", "close", "volume")},
        "close_not_positive": F.col("close") <= 0,
        "high_below_low": F.col("high") < F.col("low"),
        "close_outside_range": (F.col("close") > F.col("high")) | (F.col("close") < F.col("low")),
        "volume_zero": F.col("volume") == 0,
        "volume_negative": F.col("volume") < 0,
    }
    return counted(prices, rules)


def counted(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, n) of each rule, counted in one pass."""
    one = df.agg(*[F.count_if(c).alias(k) for k, c in rules.items()])
    return one.unpivot([], list(rules), "rule", "n")


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str, name: str) -> DataFrame:
    """Q08: child rows whose key (not null) has no parent."""
    lost = child.where(F.col(child_key).isNotNull()).join(parent.select(F.col(parent_key).alias(child_key)).distinct(), child_key, "left_anti")
    return lost.agg(F.count("*").alias("n")).select(F.lit(name).alias("rule"), "n")


def symbol_master(*tables: DataFrame, existing: DataFrame) -> DataFrame:
    """Q09: distinct symbols of all tables that the master lacks."""
    out = tables[0].select("symbol")
    for t in tables[1:]:
        out = out.union(t.select("symbol"))
    return out.distinct().join(existing.select("symbol"), "symbol", "left_anti")


def readiness(prices: DataFrame, least: int, column: str = "close") -> DataFrame:
    """Q10: rows and share of nulls per symbol, ready with enough rows, warned of above a tenth of nulls."""
    per = prices.groupBy("symbol").agg(F.count("*").alias("n_rows"), F.count_if(F.col(column).isNull()).alias("n_null"))
    return per.select("symbol", "n_rows", "n_null", (F.col("n_rows") >= least).alias("ready"), (F.col("n_null") > 0.1 * F.col("n_rows")).alias("null_warning"))


def missing_metrics(facts: DataFrame, metrics: list[str]) -> DataFrame:
    """Q11: per symbol and report, which metrics are absent, and how many values are null."""
    per = facts.groupBy("symbol", "report_date").agg(F.collect_set("metric").alias("have"), F.count_if(F.col("value").isNull()).alias("n_null"))
    return per.select("symbol", "report_date", F.array_sort(F.array_except(F.array(*map(F.lit, metrics)), "have")).alias("missing"), "n_null")


def health(found: DataFrame, by: list[str]) -> DataFrame:
    """Q12: issues by severity, and the score max(0, 100 - min(60, 20 critical) - min(30, 5 warnings))."""
    n = found.groupBy(*by).agg(F.count_if(F.col("severity") == "critical").alias("n_critical"), F.count_if(F.col("severity") == "warning").alias("n_warning"), F.count_if(F.col("severity") == "info").alias("n_info"))
    score = F.greatest(F.lit(0), 100 - F.least(F.lit(60), 20 * F.col("n_critical")) - F.least(F.lit(30), 5 * F.col("n_warning")))
    return n.withColumn("score", score.cast("long")).withColumn("passed", F.col("n_critical") == 0)


def trend(scores: DataFrame, key: str, at: str, last: int = 7) -> DataFrame:
    """Q13: of each key's last 7 scores, the mean of the last three against that of the first three: improving, declining or stable."""
    new = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(at)))
    recent = scores.withColumn("rn", new).where(F.col("rn") <= last).withColumn("n", F.count("*").over(Window.partitionBy(key)))
    per = recent.groupBy(key).agg(F.avg(F.when(F.col("rn") > F.col("n") - 3, F.col("score"))).alias("first3"), F.avg(F.when(F.col("rn") <= 3, F.col("score"))).alias("last3"), F.count("*").alias("n"))
    move = F.col("last3") - F.col("first3")
    return per.select(key, "first3", "last3", F.when(F.col("n") < 2, "stable").when(move > 5, "improving").when(move < -5, "declining").otherwise("stable").alias("trend"))


def retention(df: DataFrame, date: str, cutoff: str) -> DataFrame:
    """Q15: rows kept and dropped by a cutoff."""
    keep = F.col(date) >= F.lit(cutoff)
    return df.agg(F.count_if(keep).alias("kept"), F.count_if(~keep).alias("dropped"))


def first_of_minute(events: DataFrame) -> DataFrame:
    """Q16: of events of one type, hypothesis, experiment, actor and minute (null equals null) the least lineage_id, and how many there were."""
    return events.groupBy("event_type", "hypothesis_id", "experiment_id", "actor", F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("at")).agg(F.min("lineage_id").alias("lineage_id"), F.count("*").alias("n"))


def run_summary(log: DataFrame, *by: str) -> DataFrame:
    """Q18: of ingestion runs (status, completed_at): how many, the percentage that completed, in any case of letters, and when one did last."""
    ok = F.lower("status") == "completed"
    return log.groupBy(*by).agg(F.count("*").alias("runs"), (F.count_if(ok) * 100.0 / F.count("*")).alias("success_rate"), F.max(F.when(ok, F.col("completed_at"))).alias("last_success"))


def partition_digests(rows: DataFrame, part: str) -> DataFrame:
    """Q19: (part, n, d1 to d4) of rows with a SHA-256 `hash`: sums of its four leading words, the same in whatever order or file the rows stand."""
    word = lambda k: F.sum(F.conv(F.substring("hash", 8 * k + 1, 8), 16, 10).cast("long")).alias(f"d{k + 1}")
    return rows.groupBy(part).agg(F.count("*").alias("n"), *[word(k) for k in range(4)])


def differing(left: DataFrame, right: DataFrame, left_digests: DataFrame, right_digests: DataFrame, part: str, key: str) -> DataFrame:
    """Q19: (part, key, kind): rows (part, key, hash) of two stores that are not the same: `changed`, or `left` or `right` where only that one has it.

    Digests of partitions, a row each, are compared first; rows are read of those partitions only whose digests differ: a literal list, so the files of the
    others are pruned. Parts and keys are not null.
    """
    sums = ["n", "d1", "d2", "d3", "d4"]
    one, two = (d.select(F.col(part).alias("__p"), F.struct(*sums).alias(name)) for d, name in ((left_digests, "__l"), (right_digests, "__r")))
    parts = [r[0] for r in one.join(two, "__p", "full_outer").where(~F.col("__l").eqNullSafe(F.col("__r"))).select("__p").collect()]  # partitions, not rows
    a, b = (d.where(F.col(part).isin(parts)).select(part, key, F.col("hash").alias(h)).toDF(part, key, h) for d, h in ((left, "__a"), (right, "__b")))
    kind = F.when(F.col("__b").isNull(), "left").when(F.col("__a").isNull(), "right").otherwise("changed")
    return a.join(b, [part, key], "full_outer").where(~F.col("__a").eqNullSafe(F.col("__b"))).select(part, key, kind.alias("kind"))


def provenance_hash(df: DataFrame, columns: list[str]) -> DataFrame:
    """Q19: sha256 of the row's canonical text: sorted columns, as name=value pairs."""
    text = F.concat_ws("|", *[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("null"))) for c in sorted(columns)])
    return df.withColumn("hash", F.sha2(text, 256))
