"""Mixing sources to target weights over a domain - language - source tree.

A budget of tokens flows down the tree by weight. A node can take no more than its documents hold over the allowed epochs;
what it cannot take goes to its siblings by weight, and only what a whole family cannot take goes to the family's own
siblings. Each level is solved in closed form: siblings sorted by capacity / weight fill up in that order, so one window
over the (small) table of tree nodes finds the water level. A leaf's documents are ordered by a seeded hash, an own order
for each epoch; whole epochs are taken first, then the longest prefix of the next order that fits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut

LEVELS = ("domain", "lang", "source")


def default_domain() -> Column:
    """documents has no domain column: each source belongs to one of four domains by its MD5."""
    return F.concat(F.lit("domain"), (F.conv(F.substring(F.md5(F.col("source").cast("binary")), 1, 8), 16, 10).cast("long") % 4).cast("string"))


def word_count() -> Column:
    return F.regexp_count(F.col("text"), F.lit(WORD)).cast("long")


def weight_of(level: str, weights: dict[str, float], other: float) -> Column:
    out = F.lit(float(other))
    for name, w in weights.items():
        out = F.when(F.col(level) == name, F.lit(float(w))).otherwise(out)
    return out


def fill(nodes: DataFrame, parent: list[str], budget: str, out: str) -> DataFrame:
    """Splits each parent's budget among its children (columns cap, weight) in proportion to weight, none above cap."""
    order = Window.partitionBy(*parent).orderBy(F.col("cap") / F.col("weight"), "node") if parent else Window.orderBy(F.col("cap") / F.col("weight"), "node")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = nodes.withColumn("_level", (F.col(budget) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    full = F.col("_level") * F.col("weight") >= F.col("cap")
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = level.withColumn("_open", F.max(F.when(~full, F.col("_level"))).over(every))
    share = F.when(F.col("_open").isNull(), F.col("cap")).otherwise(F.least("cap", F.greatest(F.lit(0.0), F.col("_open") * F.col("weight"))))
    return level.withColumn(out, share).drop("_level", "_open")


def leaf_budgets(leaves: DataFrame, share: float, weights: dict[str, dict[str, float]], epochs: int, other: float = 1.0) -> DataFrame:
    """leaves: domain, lang, source, docs, tokens. Adds target (tokens by weight alone) and budget (after redistribution).
    A weight must be positive; a node that is not named has the weight `other`."""
    caps = leaves.withColumn("cap", (F.col("tokens") * epochs).cast("double"))
    total = caps.agg((F.sum("tokens") * F.lit(float(share))).alias("total"))
    top = caps.groupBy("domain").agg(F.sum("cap").alias("cap")).withColumn("weight", weight_of("domain", weights.get("domain", {}), other)).withColumn("node", F.col("domain"))
    top = fill(top.crossJoin(F.broadcast(total)), ["total"], "total", "b1").select("domain", "b1")  # total: one row
    mid = caps.groupBy("domain", "lang").agg(F.sum("cap").alias("cap")).withColumn("weight", weight_of("lang", weights.get("lang", {}), other)).withColumn("node", F.col("lang"))
    mid = fill(mid.join(top, "domain"), ["domain"], "b1", "b2").select("domain", "lang", "b2")
    low = caps.withColumn("weight", weight_of("source", weights.get("source", {}), other)).withColumn("node", F.col("source"))
    return fill(low.join(mid, ["domain", "lang"]), ["domain", "lang"], "b2", "b3").withColumn("budget", F.floor(F.col("b3") + 1e-6).cast("long")).select(*LEVELS, "docs", "tokens", "budget")


def mix(
    docs: DataFrame, share: float = 0.5, weights: dict[str, dict[str, float]] | None = None, epochs: int = 2, seed: str = "mix-1", domain: Column | None = None, tokens: Column | None = None, slice_rows: int = 1000
) -> DataFrame:
    """doc_id, domain, lang, source, tokens, leaf_budget, copies (how often the document is taken) of every row.

    share: the budget as a share of all tokens. Null sources, languages and texts count as '' (no tokens); a document
    without tokens costs nothing and is taken in an epoch when its turn comes before the budget is spent. Ties of the
    seeded hash and repeated rows are ordered by doc_id and then share their place: they are taken together or not at all.
    A leaf of any size is cut into slices of about slice_rows documents by its hash, so no task sorts a whole leaf; totals
    of slices are what is summed for the whole leaf."""
    blank = F.lit("")
    base = docs.select(
        "doc_id", F.coalesce(domain if domain is not None else default_domain(), blank).alias("domain"), F.coalesce("lang", blank).alias("lang"),
        F.coalesce("source", blank).alias("source"), F.coalesce(tokens if tokens is not None else word_count(), F.lit(0).cast("long")).alias("tokens"),
    )
    base = cut(base)
    leaves = base.groupBy(*LEVELS).agg(F.count("*").alias("docs"), F.sum("tokens").alias("tokens"))
    budgets = cut(leaf_budgets(leaves, share, weights or {}, epochs))
    plan = budgets.select(
        *LEVELS, F.col("budget").alias("leaf_budget"), F.when(F.col("tokens") > 0, F.least(F.lit(epochs), F.floor(F.col("budget") / F.col("tokens")))).otherwise(0).cast("int").alias("whole"),
        F.col("tokens").alias("_all"), F.ceil(F.col("docs") / slice_rows).cast("long").alias("_slices"),
    )
    placed = base.join(plan, list(LEVELS)).withColumn("_key", F.md5(F.concat_ws("|", F.lit(seed), F.col("whole").cast("string"), F.col("doc_id").cast("string")).cast("binary")))
    # The first 8 hexadecimal digits as a number in [0, 1) choose the slice, in the order of the key itself.
    placed = placed.withColumn("_slice", F.floor(F.conv(F.substring("_key", 1, 8), 16, 10).cast("double") / F.lit(4294967296.0) * F.col("_slices")).cast("long"))
    sums = placed.groupBy(*LEVELS, "_slice").agg(F.sum("tokens").alias("_sum"))
    base_of = sums.withColumn("_base", F.coalesce(F.sum("_sum").over(Window.partitionBy(*LEVELS).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_sum")
    inside = Window.partitionBy(*LEVELS, "_slice").orderBy("_key", "doc_id").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    done = placed.join(base_of, [*LEVELS, "_slice"]).withColumn("_to", F.col("_base") + F.sum("tokens").over(inside))
    more = (F.col("whole") < epochs) & (F.col("_to") <= F.col("leaf_budget") - F.col("whole") * F.col("_all"))
    return done.select("doc_id", *LEVELS, "tokens", "leaf_budget", (F.col("whole") + more.cast("int")).alias("copies"))


def mix_rows(docs: DataFrame, **params) -> DataFrame:
    """The rows of docs that are taken at least once, with their columns (for more than one epoch, once for each copy)."""
    # Rows that share an identifier share their fate: the most that any of them is taken.
    taken = mix(docs, **params).where("copies > 0").groupBy(F.col("doc_id").alias("__id")).agg(F.max("copies").alias("copies"))
    rows = docs.join(taken, docs["doc_id"].eqNullSafe(taken["__id"]))
    return rows.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*[docs[c] for c in docs.columns])
