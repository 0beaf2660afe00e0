"""Mixing sources to target weights.

Every source has a target share of the tokens of the mix and a cap on how often a document is repeated.  A source
contributes complete epochs (every document once) and a fraction of one more, drawn without replacement with
probabilities scaled by the documents' quality: each document gets the key -ln(u) / quality with u from a hash of
its id (Efraimidis-Spirakis in its exponential form), documents are taken in order of the key, and a prefix sum of
their tokens is cut at the source's budget.

No source, however large, is sorted in one task.  The place in the order where the budget ends is narrowed down first:
tokens are added up per source and interval of keys, the intervals before the end are taken whole, and the one in which
the budget ends is divided again until it holds few documents; only these are sorted.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def budgets(available: dict[str, int], weights: dict[str, tuple[float, int]], total: int | None = None) -> dict[str, int]:
    """Tokens to take from each source.

    ``weights``: (target share, cap) per source. Sources without tokens give nothing and their share is divided
    among the others in proportion. With ``total`` each source gets its share of it; one that would exceed its cap stops
    there and falls short. Without, the mix is as large as it can be with every share exact (the source that reaches its
    cap first decides).
    """
    live = {s: (w, cap) for s, (w, cap) in weights.items() if w > 0 and cap > 0 and available.get(s, 0) > 0}
    whole = sum(w for w, _ in live.values())
    if not live:
        return {}
    if total is None:
        total = min(cap * available[s] * whole / w for s, (w, cap) in live.items())
    return {s: min(int(total * w / whole + 1e-9), cap * available[s]) for s, (w, cap) in live.items()}


@dataclass
class Edge:
    """The interval of keys, both ends included, in which a source's budget ends; ``before``: tokens of the lesser keys."""

    low: float
    high: float
    before: int
    n_docs: int


def edges(keyed: DataFrame, rest: dict[str, int], bins: int = 256, most_sorted: int = 100_000, max_rounds: int = 64) -> dict[str, Edge]:
    """Where the budget ``rest`` of each source ends in ``keyed`` (src, key, n). A round is one aggregation to at most ``bins``
    rows a listed source; an interval is divided until it holds at most ``most_sorted`` documents or a single key."""
    spark = keyed.sparkSession
    ends = keyed.where(F.col("src").isin(*rest)).groupBy("src").agg(F.min("key").alias("low"), F.max("key").alias("high"), F.count(F.lit(1)).alias("n")) if rest else None
    found = {r.src: Edge(r.low, r.high, 0, r.n) for r in ends.collect()} if rest else {}
    for _ in range(max_rounds):
        wide = [(s, e.low, e.high) for s, e in found.items() if e.n_docs > most_sorted and e.high > e.low]
        if not wide:
            break
        within = keyed.join(F.broadcast(spark.createDataFrame(wide, "src string, low double, high double")), "src").where("key between low and high")
        at = F.least(F.floor((F.col("key") - F.col("low")) / (F.col("high") - F.col("low")) * bins), F.lit(bins - 1))
        rows = within.groupBy("src", at.alias("bin")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("docs"), F.min("key").alias("low"), F.max("key").alias("high")).collect()
        for s, *_ in wide:
            before = found[s].before
            for r in sorted((r for r in rows if r.src == s), key=lambda r: r.bin):
                if before + r.n > rest[s]:
                    found[s] = Edge(r.low, r.high, before, r.docs)
                    break
                before += r.n
    return found


def mix(sized: DataFrame, weights: DataFrame, doc: str, source: str, n_tokens: str, quality: str, total: int | None = None, seed: int = 0, least_quality: float = 0.05, **narrowing) -> tuple[DataFrame, DataFrame]:
    """(documents drawn, with ``copies``; report per source).

    ``sized`` should be a written table, as it is read several times. ``weights``: source, target_share,
    max_repeats, one row per source (of several, shares add up and the least cap holds); a null cap is 1. ``total``: tokens
    of the mix, by default those of all usable documents together; the report has what each source was to give of it
    (``n_target``) and what it fell short by, which only its cap (or a last document that no longer fits) can cause.
    Documents of unlisted or null sources and documents without tokens are never used. Null or low quality counts
    as ``least_quality``. The same ids and seed give the same mix. Rows with the same id are documents of their own with the
    same key. Sources are a list given by ``weights``, so their totals, one row each, are computed with on the driver.
    """
    spark = sized.sparkSession
    listed = (
        weights.where(F.col("source").isNotNull())
        .groupBy(F.col("source").alias("__source"))
        .agg(F.sum(F.coalesce("target_share", F.lit(0.0))).alias("target_share"), F.min(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats"))
    )
    rows = {r["__source"]: r for r in listed.collect()}
    docs = sized.where((F.col(n_tokens) > 0) & F.col(source).isin(*rows)) if rows else sized.where(F.lit(False))
    docs = docs.select(F.col(doc).alias("doc"), F.col(source).alias("src"), F.col(n_tokens).cast("long").alias("n"), F.greatest(F.coalesce(F.col(quality), F.lit(0.0)), F.lit(least_quality)).alias("q"))
    sizes = {r.src: (r.docs, int(r.n)) for r in docs.groupBy("src").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("n")).collect()}
    available, caps = {s: n for s, (_, n) in sizes.items()}, {s: (r.target_share, r.max_repeats) for s, r in rows.items()}
    total = sum(available.values()) if total is None else total
    budget = budgets(available, caps, total)
    wanted = budgets(available, {s: (w, 1 << 40 if cap > 0 else 0) for s, (w, cap) in caps.items()}, total)

    u = (F.xxhash64(F.lit(seed), "doc").bitwiseAND(F.lit((1 << 53) - 1)) + F.lit(0.5)) / F.lit(float(1 << 53))
    keyed = docs.withColumn("key", -F.log(u) / F.col("q"))
    found = edges(keyed, {s: b % sizes[s][1] for s, b in budget.items() if b % sizes[s][1]}, **narrowing)
    none = Edge(float("inf"), float("-inf"), 0, 0)
    plan = [(s, b // sizes[s][1], b % sizes[s][1], e.low, e.high, e.before) for s, b in budget.items() for e in [found.get(s, none)]]
    plan = F.broadcast(spark.createDataFrame(plan, "src string, epochs long, rest long, low double, high double, before long"))  # one row a listed source
    placed = keyed.join(plan, "src")
    sure = placed.where("rest = 0 or key < low or key > high").withColumn("more", F.expr("rest > 0 and key < low"))
    prefix = F.sum("n").over(Window.partitionBy("src").orderBy("key", "doc").rowsBetween(Window.unboundedPreceding, 0))
    edge = placed.where("rest > 0 and key between low and high").withColumn("more", F.col("before") + prefix <= F.col("rest"))
    chosen = sure.unionByName(edge).withColumn("copies", F.col("epochs") + F.col("more").cast("long")).where("copies > 0")
    chosen = chosen.select(F.col("doc").alias(doc), F.col("src").alias(source), F.col("n").alias(n_tokens), "copies")

    facts = [(s, r.target_share, int(r.max_repeats), *sizes.get(s, (0, 0)), wanted.get(s, 0)) for s, r in rows.items()]
    facts = spark.createDataFrame(facts, "source string, target_share double, max_repeats int, n_documents long, n_available long, n_target long")
    used = chosen.groupBy(F.col(source).alias("source")).agg(
        F.sum(F.col(n_tokens) * F.col("copies")).alias("n_used"), F.count(F.lit(1)).alias("n_documents_used"), F.max("copies").alias("most_copies")
    )
    report = facts.join(used, "source", "left").na.fill(0, ["n_used", "n_documents_used", "most_copies"])
    everything = F.sum("n_used").over(Window.partitionBy())  # one row a listed source
    report = report.withColumn("n_short", F.col("n_target") - F.col("n_used")).withColumn("share_reached", F.when(everything > 0, F.col("n_used") / everything).otherwise(F.lit(0.0)))
    return chosen, report
