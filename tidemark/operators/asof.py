"""Point-in-time joins: facts carried to the dates that may know them, by one shuffle on the key and a running last value; never facts x dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import tasks


def asof_join(probes: DataFrame, facts: DataFrame, keys: list[str], probe_ts: str, fact_ts: str, carry: list[str], order: list[str] | None = None, tolerance_days: int | None = None) -> DataFrame:
    """Every probe row with the `carry` columns of the latest fact at or before it, null where there is none.

    The whole fact row is carried, so a null in the latest fact is not filled from an older one. `order` breaks ties between facts of one time (the
    last wins). Null keys match nothing but stay.
    """
    order = order or []
    struct = F.struct(*[F.col(c) for c in carry], F.col(fact_ts).alias("__at"))
    p = probes.select(F.struct(*probes.columns).alias("__row"), *keys, F.col(probe_ts).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(facts.select(struct.alias("s")).schema["s"].dataType).alias("__fact"), *[F.lit(None).cast(facts.schema[c].dataType).alias(f"__o{i}") for i, c in enumerate(order)])
    f = facts.select(F.lit(None).cast(p.schema["__row"].dataType).alias("__row"), *keys, F.col(fact_ts).alias("__t"), F.lit(0).alias("__side"), struct.alias("__fact"), *[F.col(c).alias(f"__o{i}") for i, c in enumerate(order)])
    w = Window.partitionBy(*keys).orderBy("__t", "__side", *[f"__o{i}" for i in range(len(order))]).rowsBetween(Window.unboundedPreceding, 0)
    both = p.unionByName(f)
    got = both.repartition(tasks(both), *keys).withColumn("__last", F.last("__fact", ignorenulls=True).over(w)).where("__side = 1")
    ok = F.lit(True)
    for k in keys:
        ok = ok & F.col(k).isNotNull()
    if tolerance_days is not None:
        ok = ok & (F.date_diff("__t", F.col("__last")["__at"]) <= tolerance_days)
    return got.select("__row.*", *[F.when(ok, F.col("__last")[c]).alias(c) for c in carry])


def next_after(probes: DataFrame, events: DataFrame, keys: list[str], probe_ts: str, event_ts: str, carry: dict[str, str]) -> DataFrame:
    """Every probe row with columns of the key's first event strictly after it (`carry`: event column -> name), null where none follows.

    The mirror of asof_join: one union per key, read backwards in time with a running last value, so neither side is multiplied by the other. An event at
    the probe's own time doesn't follow it. Of several events at one time the least (by the carried columns, in order) counts. Null keys and times match nothing but stay.
    """
    found = F.struct(F.col(event_ts).alias("__at"), *[F.col(c).alias(n) for c, n in carry.items()])
    kind = events.select(found.alias("s")).schema["s"].dataType
    p = probes.select(F.struct(*probes.columns).alias("__row"), *keys, F.col(probe_ts).alias("__t"), F.lit(0).alias("__side"), F.lit(None).cast(kind).alias("__event"))
    e = events.where(F.col(event_ts).isNotNull()).select(F.lit(None).cast(p.schema["__row"].dataType).alias("__row"), *keys, F.col(event_ts).alias("__t"), F.lit(1).alias("__side"), found.alias("__event"))
    back = Window.partitionBy(*keys).orderBy(F.col("__t").desc_nulls_last(), "__side", F.desc("__event")).rowsBetween(Window.unboundedPreceding, 0)
    got = p.unionByName(e).withColumn("__next", F.last("__event", ignorenulls=True).over(back)).where("__side = 0")
    ok = F.col("__t").isNotNull()
    for k in keys:
        ok = ok & F.col(k).isNotNull()
    return got.select("__row.*", *[F.when(ok, F.col("__next")[n]).alias(n) for n in carry.values()])


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def facts_as_of(facts: DataFrame, day: str) -> DataFrame:
    """Newest value per symbol and metric reported by `day`."""
    known = facts.where(F.col("report_date") <= F.lit(day).cast("date"))
    return latest(known, ["symbol", "metric"], [F.desc("report_date"), F.desc("period_end")])


def universe_as_of(snapshots: DataFrame, day: str) -> DataFrame:
    """Symbols whose newest snapshot by `day` has them in; none before the first snapshot."""
    known = snapshots.where(F.col("date") <= F.lit(day).cast("date"))
    return latest(known, ["symbol"], [F.desc("date")]).where("in_universe")


def members_from_log(log: DataFrame, day: str) -> DataFrame:
    """Symbols whose last event by `day` is ADDED; of one day's events REMOVED counts last."""
    known = log.where(F.col("effective_date") <= F.lit(day).cast("date"))
    return known.groupBy("symbol").agg(F.max_by("action", F.struct("effective_date", "action")).alias("last"), F.max("effective_date").alias("since")).where("last = 'ADDED'").drop("last")


def transitions(snapshots: DataFrame) -> DataFrame:
    """Added, removed and readded between successive snapshots."""
    w = Window.partitionBy("symbol").orderBy("date")
    was, ever = F.lag("in_universe").over(w), F.coalesce(F.max("in_universe").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    kind = F.when(F.col("in_universe") & ~F.coalesce(was, F.lit(False)), F.when(ever, "readded").otherwise("added")).when(~F.col("in_universe") & was, "removed")
    return snapshots.withColumn("transition", kind).where("transition is not null")


def exclusion(sector: Column, industry: Column, price: Column, sectors: list[str]) -> Column:
    """P10: why a symbol is left out, null if it isn't."""
    slug = F.regexp_replace(F.lower(sector), "[^a-z0-9]+", "_")
    return F.when(sector.isin(sectors), F.concat(F.lit("excluded_sector:"), slug)).when(F.upper(industry).contains("REIT"), F.lit("excluded_sector:reit")).when(price < 5, F.lit("penny_stock:price_below_5.00"))


def sentiment_category(score: Column) -> Column:
    return F.when(score >= 0.3, "positive").when(score <= -0.3, "negative").when(score.isNotNull(), "neutral")


def snap(dates: DataFrame, calendar: DataFrame, days: int = 10) -> DataFrame:
    """Each row (date, ...) with the session at or before its date and at or after it, at most `days` away; a null date has none.

    Distinct dates and sessions, one row a day each, take the last and next session by a running value; rows then join their date.
    """
    own = dates.select("date").where("date is not null").distinct().select("date", F.lit(None).cast("date").alias("__s"))
    days_of = own.unionByName(calendar.select("date", F.col("date").alias("__s")).distinct()).groupBy("date").agg(F.max("__s").alias("__s"))
    w = Window.orderBy("date")  # one row a day
    before, after = F.last("__s", ignorenulls=True).over(w), F.first("__s", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    near = days_of.select(F.col("date").alias("__d"), before.alias("__p"), after.alias("__n"))
    near = near.select("__d", F.when(F.date_diff("__d", "__p") <= days, F.col("__p")).alias("previous_session"), F.when(F.date_diff("__n", "__d") <= days, F.col("__n")).alias("next_session"))
    return dates.join(near, dates["date"] == near["__d"], "left").drop("__d")


def in_range(calendar: DataFrame, start: str, end: str) -> DataFrame:
    """The first and last session of a range, and how many it has."""
    own = calendar.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).select("date").distinct()
    return own.agg(F.min("date").alias("first_session"), F.max("date").alias("last_session"), F.count("*").alias("sessions"))
