"""Model drift from histograms and rank correlations, and lineage: event chains, dependency graphs, histories in JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .research import spearman


def histogram_drift(long: DataFrame, bins: int, least: int = 100) -> DataFrame:
    """KL divergence and PSI per feature of rows (feature, side 'reference' or 'new', x), all features in one job.

    Edges are a row a feature and broadcast: a join by the feature would send all of its values to one task. Equal-width bins span the reference; new values outside are ignored. 1e-10 is added to each bin's density before shares are taken.
    """
    long = written(long.where("x is not null").select("feature", "side", "x"), "sides")
    edges = long.where("side = 'reference'").groupBy("feature").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("n_ref"))
    width = (F.col("hi") - F.col("lo")) / bins
    placed = long.join(F.broadcast(edges), "feature").where("hi > lo and x between lo and hi").withColumn("width", width)
    bin_ = F.least(F.floor((F.col("x") - F.col("lo")) / F.col("width")).cast("int"), F.lit(bins - 1))
    counts = placed.groupBy("feature", "width", bin_.alias("bin")).agg(F.count_if(F.col("side") == "reference").alias("p"), F.count_if(F.col("side") == "new").alias("q"))
    every = counts.select("feature", "width").distinct().select("feature", "width", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    full = every.join(counts.drop("width"), ["feature", "bin"], "left").fillna(0, ["p", "q"])
    w = Window.partitionBy("feature")
    share = lambda c: F.try_divide(F.col(c), F.sum(c).over(w) * F.col("width")) + 1e-10
    d = full.withColumn("dp", share("p")).withColumn("dq", share("q")).withColumn("n_ref", F.sum("p").over(w)).withColumn("n_new", F.sum("q").over(w))
    d = d.withColumn("sp", F.col("dp") / F.sum("dp").over(w)).withColumn("sq", F.col("dq") / F.sum("dq").over(w))
    ratio = F.log(F.col("sp") / F.col("sq"))
    return d.groupBy("feature").agg(F.first("n_ref").alias("n_ref"), F.first("n_new").alias("n_new"), F.sum(F.col("sp") * ratio).alias("kl"), F.sum((F.col("sp") - F.col("sq")) * ratio).alias("psi")).where((F.col("n_ref") >= least) & (F.col("n_new") >= least))


def concept_drift(df: DataFrame, y: str, p: str, reference_ic: DataFrame, *by: str) -> DataFrame:
    """Relative change of the rank IC against the reference's."""
    now = spearman(df, y, p, *by)
    return now.join(reference_ic.select(*by, F.col("ic").alias("reference_ic")), list(by)).withColumn("change", F.try_divide(F.abs(F.col("reference_ic") - F.col("ic")), F.abs("reference_ic")))


def reached(start: DataFrame, edges: DataFrame) -> DataFrame:
    """(origin, node, depth): nodes that each origin reaches over `edges` (node, to), at their least depth; `start` has (origin, node) at depth 0.

    Rounds of a join from the newest rows only, less what is known, until a round finds nothing: any depth, cycles and diamonds included, no path twice.
    Each round's rows are a written table.
    """
    fresh = known = written(start.distinct().withColumn("depth", F.lit(0)), "reached")
    k = 0
    while not fresh.isEmpty():
        k += 1
        to = fresh.join(edges, "node").select("origin", F.col("to").alias("node")).where("node is not null").distinct()
        fresh = written(to.join(known.select("origin", "node"), ["origin", "node"], "left_anti").withColumn("depth", F.lit(k)), "reached")
        known = known.unionByName(fresh) if k % 8 else written(known.unionByName(fresh), "reached")
    return known


def event_chain(lineage: DataFrame, hypothesis: int) -> DataFrame:
    """(lineage_id, depth) of a hypothesis' events and all their ancestors."""
    events = lineage.where(F.col("hypothesis_id") == hypothesis).select(F.lit(0).alias("origin"), F.col("lineage_id").alias("node"))
    parents = lineage.where("parent_id is not null").select(F.col("lineage_id").alias("node"), F.col("parent_id").alias("to"))
    known = lineage.select(F.col("lineage_id").alias("node"))
    return reached(events, parents).join(known, "node", "left_semi").groupBy(F.col("node").alias("lineage_id")).agg(F.min("depth").alias("depth"))


def deployment_trace(lineage: DataFrame, hypothesis: int, kinds: list[str]) -> DataFrame:
    """The chain's events of the kinds that a deployment decision rests on, in order of time."""
    chain = event_chain(lineage, hypothesis)
    return lineage.where(F.col("event_type").isin(kinds)).join(chain.select("lineage_id"), "lineage_id", "left_semi")


def events_between(lineage: DataFrame, first: int, last: int) -> DataFrame:
    """Events from one event's time to another's, both included, whichever is earlier; none where one is missing."""
    ends = lineage.where(F.col("lineage_id").isin(first, last)).agg(F.min("ts").alias("__lo"), F.max("ts").alias("__hi"), F.countDistinct("lineage_id").alias("__n"))
    return lineage.join(F.broadcast(ends), F.col("ts").between(F.col("__lo"), F.col("__hi"))).where(F.col("__n") == len({first, last})).drop("__lo", "__hi", "__n")  # one row


def appended(history: Column, kind: Column, params: Column, at: Column) -> Column:
    """A JSON array of steps with one more."""
    step = "array<struct<type:string,params:map<string,string>,timestamp:string>>"
    return F.to_json(F.concat(F.coalesce(F.from_json(history, step), F.array().cast(step)), F.array(F.struct(kind.alias("type"), params.alias("params"), at.alias("timestamp")))))


def key_set(checks: Column, name: Column, value: Column) -> Column:
    """A JSON map with one key set, new or not."""
    old = F.coalesce(F.from_json(checks, "map<string,string>"), F.create_map().cast("map<string,string>"))
    return F.to_json(F.map_concat(F.map_filter(old, lambda k, v: k != name), F.create_map(name, value)))


def dependency_edges(definitions: DataFrame) -> DataFrame:
    """(feature, input) edges of feature definitions whose inputs are a JSON array."""
    return definitions.select("feature", F.explode(F.from_json("inputs", "array<string>")).alias("input"))


def closure(edges: DataFrame) -> DataFrame:
    """(feature, input, depth) over all steps of `edges` (feature, input)."""
    steps = edges.where("feature is not null and input is not null")
    start = steps.select(F.col("feature").alias("origin"), F.col("input").alias("node"))
    found = reached(start, steps.select(F.col("feature").alias("node"), F.col("input").alias("to")))
    return found.select(F.col("origin").alias("feature"), F.col("node").alias("input"), (F.col("depth") + 1).alias("depth"))
