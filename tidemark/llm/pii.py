"""Personal data: typed base patterns, and identifiers they miss by bootstrapped contextual extraction. DataFrame functions only.

Base spans are seeds. The words around seeds induce lexical patterns; patterns and the digit- or @-bearing tokens they surround form a graph that is
scored in rounds: a pattern by the share of its distinct tokens that are known to be of a kind, a token by the patterns that surround it. Tokens that
confident patterns agree on become known, everywhere they stand. Base spans always stay.

Nulls are empty texts; repeated rows and ids are documents of their own; extra columns are ignored; all patterns are possessive, so texts without
spaces or of any length take linear time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import clean_text, table, written

KINDS = ("email", "ip", "card", "phone")
# The contract's patterns, made possessive; a match can only begin where a run of its first class does, or where the last match ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a kind's text must hold for its pattern to be tried.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
#: Tokens with a digit or @, joined where they follow each other by one space.
TOKEN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+(?:\x20[^\s0-9@]*+[0-9@]\S*+)*+"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(d: Column) -> Column:
    n = F.length(d)
    at = lambda i: F.substring(d, n - i + 1, F.lit(1)).cast("int")
    worth = lambda i: F.when(i % 2 == 1, at(i)).when(at(i) > 4, 2 * at(i) - 9).otherwise(2 * at(i))
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda total, i: total + worth(i)) % 10 == 0


def _valid(kind: Column, m: Column) -> Column:
    d = _digits(m)
    part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
    return (
        F.when(kind == "ip", m.rlike(rf"^(?:{part}\.){{3}}{part}$"))
        .when(kind == "card", F.length(d).between(13, 19) & F.when(F.length(d).between(13, 19), _luhn(d)).otherwise(False))
        .when(kind == "phone", F.length(d).between(9, 15))
        .otherwise(True)
    )


def _hits(text: Column, kind: str, pattern: str, needs: str) -> Column:
    """Matches in order, each with the gap before it: its length and, for tokens, its first and last characters. One more row holds the last gap.

    A lambda sees its element only: an outer expression in it would be evaluated anew for each element.
    """
    context = kind == "token"
    head, tail = (lambda g: F.substring(g, 1, 40), lambda g: F.substring(g, -60, 60)) if context else (lambda g: F.lit(""), lambda g: F.lit(""))
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.struct(F.length(g).alias("gap"), head(g).alias("head"), tail(g).alias("tail")))
    both = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), gaps.alias("g"))
    rows = F.transform(both, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), x["m"].alias("m"), x["g"]["gap"].alias("gap"), x["g"]["head"].alias("head"), x["g"]["tail"].alias("tail")))
    return F.when(text.rlike(needs), rows).otherwise(F.array().cast("array<struct<kind:string,i:int,m:string,gap:int,head:string,tail:string>>"))


def spans(docs: DataFrame, id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(rid, id) of each row, and its matches (rid, kind, start, end, m, left2, left, right): the four kinds' valid base spans, and all tokens."""
    text = F.col("text")
    hits = [_hits(text, k, PATTERNS[k], NEEDS[k]) for k in KINDS] + [_hits(text, "token", TOKEN, "[0-9@]")]
    rows = written(clean_text(docs, id_col).select(F.monotonically_increasing_id().alias("rid"), id_col, F.concat(*hits).alias("hits")), "pii-hits")
    flat = rows.select("rid", F.explode("hits").alias("h")).select("rid", "h.*")
    w = Window.partitionBy("rid", "kind").orderBy("i")
    end = F.sum(F.col("gap") + F.length("m")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    placed = flat.withColumn("end", end).withColumn("next", F.lead("head").over(w)).where("m is not null").where(_valid(F.col("kind"), F.col("m")))
    before = r"(?:(\S++)\s++)?(\S++)\s*+$"
    around = (F.lower(F.regexp_extract("tail", before, 1)).alias("left2"), F.lower(F.regexp_extract("tail", before, 2)).alias("left"), F.lower(F.regexp_extract("next", r"^\s*+(\S++)", 1)).alias("right"))
    return rows.select("rid", id_col), written(placed.select("rid", "kind", (F.col("end") - F.length("m")).alias("start"), "end", "m", *around), "pii-spans")


def bootstrapped(found: DataFrame, rounds: int = 3, support: int = 5, precise: float = 0.7, accept: float = 0.8, doubt: float = 0.25) -> DataFrame:
    """Spans (rid, kind, start, end) of identifiers that no base pattern found.

    A token has the form of a kind if its shape (runs of digits and letters masked) is one that the kind's known tokens have, or it has letters and as
    many runs as one of them, one more or less, or none and about as many digits. A pattern (kind, words around) needs `support` distinct known tokens, which must be
    `precise` of all distinct tokens it surrounds; tokens not known yet that have the kind's form speak against it only by `doubt` each, all others
    fully. A token of the kind's form is accepted when the chance that all of its patterns err is at most 1 - accept. Counts are over all documents;
    patterns and tokens are tables, never collected.
    """
    base = found.where("kind <> 'token'")
    tokens = found.where("kind = 'token'").select("rid", "start", "end", F.regexp_replace("m", r"^[\p{Punct}&&[^+(@]]+|[\p{Punct}&&[^)]]+$", "").alias("token"), "left2", "left", "right", F.length("m").alias("len"))
    # a token lies over a span of a kind if of the kind's spans that begin before it ends, the last end comes after its start: one running value per document
    token, nothing = F.struct(*tokens.columns), F.lit(None)
    line = tokens.select("rid", F.col("end").alias("at"), F.lit(0).alias("side"), token.alias("t"), nothing.cast("string").alias("kind"), nothing.cast(base.schema["end"].dataType).alias("until"))
    line = line.unionByName(base.select("rid", F.col("start").alias("at"), F.lit(1).alias("side"), nothing.cast(tokens.select(token.alias("t")).schema["t"].dataType).alias("t"), "kind", F.col("end").alias("until")))
    so_far = Window.partitionBy("rid").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    last = [F.max(F.when(F.col("kind") == k, F.col("until"))).over(so_far).alias(f"until_{k}") for k in KINDS]
    seed = F.coalesce(*[F.when(F.col(f"until_{k}") > F.col("t")["start"], F.lit(k)) for k in KINDS])
    tokens = written(line.select("side", "t", *last).where("side = 0").select("t.*", seed.alias("seed")), "pii-tokens")
    cues = F.array(F.concat(F.lit("l:"), "left"), F.concat(F.lit("ll:"), "left2", F.lit(" "), "left"), F.concat(F.lit("lr:"), "left", F.lit(" "), "right"), F.concat(F.lit("r:"), "right"))
    shape = F.regexp_replace(F.regexp_replace("token", "[0-9]+", "9"), r"\p{L}+", "a")
    runs = F.regexp_count("token", F.lit(r"[\p{L}0-9]+"))
    masked = lambda *off: F.when(F.col("token").rlike(r"\p{L}"), F.array(shape, *[F.concat(F.lit("L"), runs + o) for o in off])).otherwise(F.array(shape, F.concat(F.lit("#"), F.floor(F.length(_digits(F.col("token"))) / 3))))
    form, known_form = masked(0), masked(-1, 0, 1)
    edges = written(tokens.select("token", "seed", F.explode(cues).alias("cue")).where(~F.col("cue").rlike(r"^\w+: ?$")).groupBy("token", "cue").agg(F.max("seed").alias("seed")), "pii-graph")
    fits = written(tokens.where("seed is not null").select(F.col("seed").alias("kind"), F.explode(known_form).alias("form")).distinct(), "pii-shapes")
    can = edges.select("token").distinct().withColumn("form", F.explode(form)).join(fits, "form").groupBy("token").agg(F.collect_set("kind").alias("can"))  # of four kinds
    graph = written(edges.join(can, "token", "left").withColumn("can", F.coalesce("can", F.array().cast("array<string>"))), "pii-forms")
    known = None  # (token, kind) accepted so far
    for _ in range(rounds):
        g = graph.withColumn("kind", F.col("seed"))
        if known is not None:
            g = graph.join(known.withColumnRenamed("kind", "learned"), "token", "left").withColumn("kind", F.coalesce("seed", "learned"))
        may = lambda k: F.count_if(F.col("kind").isNull() & F.array_contains("can", k))
        counts = g.groupBy("cue").agg(F.count("*").alias("n"), *[F.count_if(F.col("kind") == k).alias(k) for k in KINDS], *[may(k).alias(f"may_{k}") for k in KINDS])
        pairs = counts.select("cue", "n", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("hits"), F.col(f"may_{k}").alias("may")) for k in KINDS])).alias("p"))
        pairs = pairs.select("cue", "p.kind", "p.hits", ((F.col("p.hits") + 0.5) / (F.col("n") - (1 - doubt) * F.col("p.may") + 1)).alias("conf"))
        good = pairs.where((F.col("hits") >= support) & (F.col("conf") >= precise)).withColumnRenamed("kind", "as_kind")
        fresh = g.where("kind is null").join(good, "cue").where(F.array_contains("can", F.col("as_kind"))).groupBy("token", "as_kind").agg((1 - F.exp(F.sum(F.log(1 - F.least("conf", F.lit(0.999)))))).alias("score"))
        fresh = fresh.where(F.col("score") >= accept).groupBy("token").agg(F.max_by("as_kind", F.struct("score", "as_kind")).alias("kind"))
        fresh = written(fresh, "pii-known")
        if fresh.isEmpty():
            break
        known = fresh if known is None else known.unionByName(fresh)
    if known is None:
        return base.select("rid", "kind", "start", "end").where("false")
    return tokens.where("seed is null").join(known, "token").select("rid", "kind", "start", "end")


def detect(docs: DataFrame, id_col: str = "doc_id", **learning) -> DataFrame:
    """(id, base, added): arrays of (kind, start, end) in order of kind, then start; code points, end exclusive."""
    rows, found = spans(docs, id_col)
    base = found.where("kind <> 'token'").select("rid", "kind", "start", "end", F.lit(True).alias("is_base"))
    every = base.unionByName(bootstrapped(found, **learning).withColumn("is_base", F.lit(False)))
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    per = every.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct(rank.alias("k"), "start", "end", "kind", "is_base"))).alias("s"))
    s = F.coalesce("s", F.array().cast("array<struct<k:bigint,start:bigint,end:bigint,kind:string,is_base:boolean>>"))
    return rows.join(per, "rid", "left").select(id_col, F.filter(s, lambda x: x["is_base"]).alias("base"), F.filter(s, lambda x: ~x["is_base"]).alias("added"), s.alias("all"))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect(table(spark, sf_dir, "documents"))
    text = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(text(F.col("base")), 256).alias("base_sha256"), text(F.col("all")).alias("spans"), F.size("added").cast("long").alias("n_added"))
