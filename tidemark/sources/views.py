"""Domain tables from the star schema: bars, symbols, facts, actions, universe, trades, events. Each has its DuckDB text beside it for the checks.

Doubles are rounded in queries after adding a small epsilon, on both sides alike, so that ties and the order of sums don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import tasks

EPS = 1.7e-8


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r(c: Column | str, digits: int = 4) -> Column:
    """c rounded for comparison."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c + F.lit(EPS), digits)


def sql_r(text: str, digits: int = 4) -> str:
    return f"round(({text}) + {EPS!r}, {digits})"


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars per symbol. Partitioned by symbol at once, so that the grouping and all windows per symbol share one shuffle, with tasks by the size of the input."""
    li = read(spark, sf_dir, "lineitem")
    n = tasks(li, 4)
    li = li.select(
        F.col("l_suppkey").alias("symbol"), F.to_date("l_shipdate").alias("date"), F.try_divide("l_extendedprice", "l_quantity").alias("p"), "l_quantity", F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice").alias("k")
    )
    return li.repartition(n, "symbol").groupBy("symbol", "date").agg(
        F.min_by("p", "k").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "k").alias("close"), F.max_by("p", "k").alias("adj_close"), F.sum("l_quantity").cast("long").alias("volume")
    )


_KEY = "l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice"
BARS = f"""bars AS (SELECT l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS date,
  first(l_extendedprice / l_quantity ORDER BY {_KEY}) AS open, max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
  last(l_extendedprice / l_quantity ORDER BY {_KEY}) AS close, last(l_extendedprice / l_quantity ORDER BY {_KEY}) AS adj_close,
  CAST(sum(l_quantity) AS BIGINT) AS volume FROM lineitem GROUP BY ALL)"""


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, name, industry, sector, market_cap."""
    s, n, g = (read(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    dims = n.join(g, n["n_regionkey"] == g["r_regionkey"]).select("n_nationkey", F.col("n_name").alias("industry"), F.col("r_name").alias("sector"))  # a few rows
    return s.join(dims, s["s_nationkey"] == dims["n_nationkey"]).select(F.col("s_suppkey").alias("symbol"), F.col("s_name").alias("name"), "industry", "sector", F.col("s_acctbal").alias("market_cap"))


SYMBOLS = """symbols AS (SELECT s_suppkey AS symbol, s_name AS name, n_name AS industry, r_name AS sector, s_acctbal AS market_cap
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarterly statement rows: symbol, period_end, revenue, discounts, taxes, units (wide, in exact cents)."""
    li = read(spark, sf_dir, "lineitem")
    end = F.last_day(F.add_months(F.trunc("l_shipdate", "quarter"), 2))
    cents = lambda c: F.sum(F.round(c * 100).cast("long"))
    return li.groupBy(F.col("l_suppkey").alias("symbol"), end.alias("period_end")).agg(
        cents(F.col("l_extendedprice")).alias("revenue"), cents(F.col("l_extendedprice") * F.col("l_discount")).alias("discounts"), cents(F.col("l_extendedprice") * F.col("l_tax")).alias("taxes"), F.sum("l_quantity").cast("long").alias("units")
    )


STATEMENTS = """statements AS (SELECT l_suppkey AS symbol, CAST(last_day(date_trunc('quarter', l_shipdate) + INTERVAL 2 MONTH) AS DATE) AS period_end,
  CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS revenue, CAST(sum(CAST(round(l_extendedprice * l_discount * 100) AS BIGINT)) AS BIGINT) AS discounts,
  CAST(sum(CAST(round(l_extendedprice * l_tax * 100) AS BIGINT)) AS BIGINT) AS taxes, CAST(sum(l_quantity) AS BIGINT) AS units FROM lineitem GROUP BY ALL)"""


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corporate actions: returned lines of high discount; split_from and split_to, or a cash amount."""
    li = read(spark, sf_dir, "lineitem")
    n = tasks(li)
    li = li.where("l_returnflag = 'R' and l_discount >= 0.08").withColumns({"symbol": F.col("l_suppkey"), "date": F.to_date("l_shipdate")})
    return li.repartition(n, "symbol", "date").groupBy("symbol", "date").agg(F.max("l_quantity").alias("split_to"), F.min("l_linenumber").cast("double").alias("split_from"), F.max("l_tax").alias("cash"))


ACTIONS = """actions AS (SELECT l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS date, max(l_quantity) AS split_to, CAST(min(l_linenumber) AS DOUBLE) AS split_from, max(l_tax) AS cash
  FROM lineitem WHERE l_returnflag = 'R' AND l_discount >= 0.08 GROUP BY ALL)"""


def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarterly snapshots: a symbol is in while its quarter's units reach the average of its quarters."""
    w = Window.partitionBy("symbol")
    s = statements(spark, sf_dir)
    return s.select("symbol", F.col("period_end").alias("date"), (F.col("units") * F.count("*").over(w) >= F.sum("units").over(w)).alias("in_universe"))


UNIVERSE = STATEMENTS + """, universe AS (SELECT symbol, period_end AS date, units * count(*) OVER (PARTITION BY symbol) >= sum(units) OVER (PARTITION BY symbol) AS in_universe FROM statements)"""


def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ADDED and REMOVED events: the transitions of the snapshots."""
    w = Window.partitionBy("symbol").orderBy("date")
    u = universe(spark, sf_dir).withColumn("was", F.coalesce(F.lag("in_universe").over(w), F.lit(False)))
    return u.where("was <> in_universe").select("symbol", F.col("date").alias("effective_date"), F.when(F.col("in_universe"), "ADDED").otherwise("REMOVED").alias("action"))


CHANGES = UNIVERSE + """, changes AS (SELECT symbol, date AS effective_date, CASE WHEN in_universe THEN 'ADDED' ELSE 'REMOVED' END AS action FROM
  (SELECT *, coalesce(lag(in_universe) OVER (PARTITION BY symbol ORDER BY date), false) AS was FROM universe) WHERE was <> in_universe)"""


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filing sentiment: labelled documents as filings of a symbol, type and date, with a score in [-1, 1]."""
    d, lab = read(spark, sf_dir, "documents").select("doc_id"), read(spark, sf_dir, "labels")
    n = read(spark, sf_dir, "supplier").agg(F.count("*").alias("n"))
    kind = F.element_at(F.array(F.lit("10-K"), F.lit("10-Q"), F.lit("8-K")), (F.pmod("doc_id", F.lit(3)) + 1).cast("int"))
    score = (F.col("quality") * 0.5 - F.col("toxic") * 0.75 + F.pmod("doc_id", F.lit(7)) * 0.125 - 0.25).cast("double")
    return d.join(lab, "doc_id").crossJoin(F.broadcast(n)).select((F.pmod("doc_id", "n") + 1).alias("symbol"), kind.alias("filing_type"), F.date_add(F.lit("1995-01-15").cast("date"), F.pmod(F.col("doc_id") * 13, F.lit(2200)).cast("int")).alias("filing_date"), "doc_id", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), score)).alias("score"))


FILINGS = """filings AS (SELECT doc_id % (SELECT count(*) FROM supplier) + 1 AS symbol, ['10-K', '10-Q', '8-K'][CAST(doc_id % 3 + 1 AS INTEGER)] AS filing_type,
  CAST(DATE '1995-01-15' + CAST(doc_id * 13 % 2200 AS INTEGER) AS DATE) AS filing_date, doc_id,
  CAST(greatest(-1.0, least(1.0, quality * 0.5 - toxic * 0.75 + (doc_id % 7) * 0.125 - 0.25)) AS DOUBLE) AS score FROM documents JOIN labels USING (doc_id))"""


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recommendations from orders: symbol, model, entry and close, status; closed ones have an outcome."""
    n = read(spark, sf_dir, "supplier").agg(F.count("*").alias("n"))
    o = read(spark, sf_dir, "orders").crossJoin(F.broadcast(n))
    day = F.to_date("o_orderdate")
    return o.select(
        F.col("o_orderkey").alias("id"), (F.pmod("o_custkey", "n") + 1).alias("symbol"), F.col("o_orderpriority").alias("model"), day.alias("entry_date"), F.date_add(day, (F.pmod("o_orderkey", F.lit(40)) + 2).cast("int")).alias("close_date"),
        F.col("o_totalprice").alias("entry_price"), (F.col("o_totalprice") * (1 + (F.pmod(F.col("o_orderkey") * 7, F.lit(41)) - 20) / 100.0)).alias("close_price"), F.element_at(F.create_map(*[F.lit(x) for x in ("F", "closed", "O", "open", "P", "stopped")]), F.col("o_orderstatus")).alias("status"), (F.pmod("o_orderkey", F.lit(10)) + 1).alias("quantity"), (F.pmod(F.col("o_orderkey") * 3, F.lit(23)) - 11).cast("double").alias("prediction"),
    )


TRADES = """trades AS (SELECT o_orderkey AS id, o_custkey % (SELECT count(*) FROM supplier) + 1 AS symbol, o_orderpriority AS model, CAST(o_orderdate AS DATE) AS entry_date,
  CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 40 + 2 AS INTEGER) AS DATE) AS close_date, o_totalprice AS entry_price, o_totalprice * (1 + (o_orderkey * 7 % 41 - 20) / CAST(100.0 AS DOUBLE)) AS close_price,
  CASE o_orderstatus WHEN 'F' THEN 'closed' WHEN 'O' THEN 'open' WHEN 'P' THEN 'stopped' END AS status, o_orderkey % 10 + 1 AS quantity, CAST(o_orderkey * 3 % 23 - 11 AS DOUBLE) AS prediction FROM orders)"""


def intraday(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of the event stream: symbol, ts, event_id, close, volume."""
    e = read(spark, sf_dir, "events")
    return e.select(F.concat("event_type", F.lit("-"), F.pmod("user_id", F.lit(10)).cast("string")).alias("symbol"), "ts", "event_id", F.col("value").alias("close"), (F.pmod("event_id", F.lit(97)) * 10).alias("volume"))


INTRADAY = """intraday AS (SELECT event_type || '-' || CAST(user_id % 10 AS VARCHAR) AS symbol, ts, event_id, value AS close, event_id % 97 * 10 AS volume FROM events)"""


def lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event log: parents by an integer rule, so that chains are of logarithmic depth."""
    e = read(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("lineage_id"), "event_type", F.concat(F.lit("user:"), "user_id").alias("actor"), "ts", F.when(F.col("event_id") > 0, F.floor(F.col("event_id") / 2)).cast("long").alias("parent_id"), F.pmod("event_id", F.lit(31)).alias("hypothesis_id"), F.col("props").alias("details"))


LINEAGE = """lineage AS (SELECT event_id AS lineage_id, event_type, 'user:' || user_id AS actor, ts, CASE WHEN event_id > 0 THEN event_id // 2 END AS parent_id, event_id % 31 AS hypothesis_id, props AS details FROM events)"""
