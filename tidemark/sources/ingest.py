"""Sources and sinks: normalising landed files, merging, keyed upserts, statement facts, stream messages, store statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import exists, written

REPORT_LAG_DAYS = 45
MESSAGE = "ev string, sym string, s long, o double, h double, l double, c double, v long, vw double, n long"


def read_bars(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Vendor daily bars (Date, Open, ..., Adj Close, Volume, Symbol) with a fixed schema."""
    schema = "Symbol string, Date string, Open double, High double, Low double, Close double, `Adj Close` double, Volume long"
    reader = spark.read.option("header", True) if fmt == "csv" else spark.read
    return normalise_bars(reader.schema(schema).format(fmt).load(path), source=fmt)


def normalise_bars(vendor: DataFrame, source: str) -> DataFrame:
    return vendor.select(
        F.upper(F.trim(F.col("Symbol"))).alias("symbol"), F.to_date("Date").alias("date"), *[F.col(c).cast("double").alias(c.lower()) for c in ("Open", "High", "Low", "Close")], F.coalesce(F.col("Adj Close"), F.col("Close")).cast("double").alias("adj_close"), F.col("Volume").cast("long").alias("volume"), F.lit(source).alias("source")
    )


def with_fallback(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """Primary rows, and the fallback's rows of symbols that have no primary row at all; fallback_used says which."""
    have = primary.select("symbol").distinct()
    return primary.withColumn("fallback_used", F.lit(False)).unionByName(fallback.join(have, "symbol", "left_anti").withColumn("fallback_used", F.lit(True)))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], seq: str | None = None, at: Column | None = None) -> DataFrame:
    """New rows replace old ones of the same key; of new rows of one key the last by `seq` wins. Old columns that new rows lack become null.

    `at` stamps the new rows as ingested_at; the old ones keep theirs.
    """
    if at is not None:
        new = new.withColumn("ingested_at", at)
    a = old.withColumn("__new", F.lit(0)).withColumn("__seq", F.lit(0).cast("long"))
    b = new.withColumn("__new", F.lit(1)).withColumn("__seq", F.col(seq).cast("long") if seq else F.lit(0).cast("long"))
    both = a.unionByName(b, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(F.desc("__new"), F.desc("__seq"), *[F.desc(c) for c in both.columns if c not in {*keys, "__new", "__seq"}])
    return both.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn", "__new", "__seq")


def write_touched(df: DataFrame, path: str, by: str) -> None:
    """Overwrites only the partitions of `by` that df has."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def upsert_files(new: DataFrame, path: str, keys: list[str], by: str, seq: str | None = None, at: Column | None = None) -> list:
    """S03 on files: merges rows into the store at `path`, whose partitions `by` (a column that follows from the keys) are folders; returns the touched ones.

    Only partitions that the new rows fall into are read, by partition pruning, and written again; files of all others stay as they are. Old rows whose key
    comes anew leave by an anti-join, which needs no shuffle of the old side where the new rows are few. The merged partitions are written to the shared
    folder first, so a failure before the last step leaves the store as it was. `at` stamps the new rows.
    """
    spark = new.sparkSession
    if at is not None:
        new = new.withColumn("ingested_at", at)
    last = Window.partitionBy(*keys).orderBy(*([F.desc(seq)] if seq else []), *[F.desc(c) for c in new.columns if c not in keys])
    new = written(new.withColumn("__rn", F.row_number().over(last)).where("__rn = 1").drop("__rn"), "upsert")
    touched = [r[0] for r in new.select(by).distinct().collect()]  # partitions, not rows
    if not touched:
        return []
    both = new
    if exists(spark, path):
        old = spark.read.parquet(path)
        wanted = F.col(by).isin([t for t in touched if t is not None]) | (F.col(by).isNull() if None in touched else F.lit(False))
        both = new.unionByName(old.where(wanted).join(new.select(*keys), keys, "left_anti"), allowMissingColumns=True)
    write_touched(written(both, "upsert"), path, by)
    return touched


def membership_changes(raw: DataFrame) -> DataFrame:
    """Clean change-log rows; bad dates and other actions are skipped, repeats kept once."""
    clean = raw.select(F.try_to_date("effective_date", "yyyy-MM-dd").alias("effective_date"), F.upper(F.trim("symbol")).alias("symbol"), F.upper(F.trim("action")).alias("action"))
    return clean.where("effective_date is not null and symbol <> '' and action in ('ADDED', 'REMOVED')").distinct()


def insert_absent(store: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    return store.unionByName(rows.join(store.select(*keys).distinct(), keys, "left_anti"))


def statement_facts(wide: DataFrame, metrics: list[str], lag_days: int = REPORT_LAG_DAYS) -> DataFrame:
    """Statements as facts (symbol, period_end, metric, value, report_date), null values dropped."""
    long = wide.select("symbol", "period_end", *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(["symbol", "period_end"], metrics, "metric", "value")
    return long.where("value is not null").withColumn("report_date", F.date_add("period_end", lag_days))


def first_line(*columns: str) -> Column:
    """The first available of several statement lines."""
    return F.coalesce(*[F.col(c) for c in columns])


def valid_facts(facts: DataFrame) -> DataFrame:
    """Facts whose period ends by the report."""
    return facts.where("period_end <= report_date")


def snapshot_features(wide: DataFrame, names: list[str], version: str = "v1") -> DataFrame:
    """A snapshot row per symbol and date as feature rows."""
    long = wide.select("symbol", "date", *[F.col(n).cast("double").alias(n) for n in names]).unpivot(["symbol", "date"], names, "feature_name", "value")
    return long.where("value is not null").withColumn("version", F.lit(version))


def normalise_actions(raw: DataFrame) -> DataFrame:
    """One row for each split (factor to / from, 1.0 if from is 0) and each dividend (factor is the cash amount)."""
    split = raw.where("split_to is not null").select("symbol", "date", F.lit("split").alias("action_type"), F.coalesce(F.try_divide("split_to", "split_from"), F.lit(1.0)).alias("factor"))
    cash = raw.where("cash > 0").select("symbol", "date", F.lit("dividend").alias("action_type"), F.col("cash").alias("factor"))
    return split.unionByName(cash)


def parse_messages(raw: DataFrame, column: str = "value") -> DataFrame:
    """Minute aggregates of JSON messages; other events and messages without symbol or start are skipped."""
    m = raw.select(F.from_json(F.col(column).cast("string"), MESSAGE).alias("m"), *[c for c in raw.columns if c != column]).where("m.ev = 'AM' and m.sym is not null and m.s is not null")
    return m.select(F.col("m.sym").alias("symbol"), F.timestamp_millis("m.s").alias("ts"), F.col("m.o").alias("open"), F.col("m.h").alias("high"), F.col("m.l").alias("low"), F.col("m.c").alias("close"), F.coalesce("m.v", F.lit(0)).alias("volume"), F.col("m.vw").alias("vwap"), F.col("m.n").alias("trades"), *[c for c in raw.columns if c != column])


def store_stats(df: DataFrame, date: str, by: str) -> DataFrame:
    """Rows, first and last date and distinct dates per value of `by`, and over all (null). Both rest on rows per value and date, so no date is kept twice."""
    per = df.groupBy(by, date).agg(F.count("*").alias("n"))
    days = df.groupBy(date).agg(F.count("*").alias("n"))  # a calendar
    aggs = [F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count(date).alias("n_dates"), F.min(date).alias("first_date"), F.max(date).alias("last_date")]
    return per.groupBy(by).agg(*aggs).unionByName(days.agg(*aggs).withColumn(by, F.lit(None).cast(df.schema[by].dataType)))


def range_read(df: DataFrame, column: str, start: str, end: str, **equals: list) -> DataFrame:
    """Rows of a range and IN-lists; both reach the scan."""
    out = df.where(F.col(column).between(F.lit(start), F.lit(end)))
    for c, v in equals.items():
        out = out.where(F.col(c).isin(v))
    return out


def pending(requested: DataFrame, completed: DataFrame, key: str = "symbol") -> DataFrame:
    """What has been requested and isn't completed."""
    return requested.select(key).distinct().join(completed.select(key).distinct(), key, "left_anti")
