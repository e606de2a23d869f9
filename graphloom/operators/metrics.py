"""Evaluation of rankings against gold nodes. A ranking is (query_id, node_id, rn), golds are (query_id, node_id)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from graphloom.functions.vectors import discounted_gain
from graphloom.sources.shared import cut

KS = (1, 5, 10, 20, 50, 100)


def hits(ranking: DataFrame, golds: DataFrame, pool: DataFrame | None = None) -> DataFrame:
    """query_id, g (golds), a (golds in the pool, or in the ranking), ranks (of the golds found, sorted)."""
    inside = (pool if pool is not None else ranking).select("query_id", "node_id").distinct().withColumn("_in", F.lit(1))
    j = golds.join(ranking.select("query_id", "node_id", "rn"), ["query_id", "node_id"], "left").join(inside, ["query_id", "node_id"], "left")
    return j.groupBy("query_id").agg(F.count("*").alias("g"), F.count("_in").alias("a"), F.sort_array(F.collect_list("rn")).alias("ranks"))


def at(k: int) -> Column:
    return F.size(F.filter("ranks", lambda r: r <= k))


def gain(k: int) -> Column:
    return F.aggregate(F.filter("ranks", lambda r: r <= k), F.lit(0.0), lambda s, r: s + 1 / F.log2(r + 1))


def basic(found: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """MRR over the whole ranking; hit, recall, full coverage and nDCG at each k."""
    cols = [F.round(F.when(F.size("ranks") > 0, 1 / F.get("ranks", F.lit(0))).otherwise(0.0), 6).alias("mrr")]
    for k in ks:
        cols += [
            (at(k) > 0).cast("double").alias(f"hit_{k}"), F.round(at(k) / F.col("g"), 6).alias(f"recall_{k}"), (at(k) == F.col("g")).cast("double").alias(f"full_{k}"),
            F.round(gain(k) / discounted_gain(F.least(F.col("g"), F.lit(k))), 6).alias(f"ndcg_{k}"),
        ]
    return found.select("query_id", *cols)


def conditional(found: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """Candidate ceiling, and the metrics among golds in the pool; NULL where a query has none there."""
    some = lambda c: F.when(F.col("a") > 0, c)
    cols = [F.round(F.col("a") / F.col("g"), 6).alias("ceiling")]
    for k in ks:
        cols += [F.round(some(at(k) / F.col("a")), 6).alias(f"cond_recall_{k}"), some((at(k) == F.col("a")).cast("double")).alias(f"cond_full_{k}"), some((at(k) > 0).cast("double")).alias(f"cond_hit_{k}")]
    return found.select("query_id", "g", "a", *cols)


def headroom(found: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """Ceilings that the pool sets: recall, what a perfect pool would allow, what is lost, nDCG."""
    cols = []
    for k in ks:
        p, g = F.least(F.col("a"), F.lit(k)), F.least(F.col("g"), F.lit(k))
        cols += [F.round(p / F.col("g"), 6).alias(f"ceiling_{k}"), F.round(g / F.col("g"), 6).alias(f"perfect_{k}"), F.round((g - p) / F.col("g"), 6).alias(f"lost_{k}"), F.round(discounted_gain(p) / discounted_gain(g), 6).alias(f"ndcg_ceiling_{k}")]
    return found.select("query_id", *cols)


def coverage(found: DataFrame) -> DataFrame:
    """Micro and macro coverage, any and all, over all queries."""
    return found.agg(F.round(F.sum("a") / F.sum("g"), 6).alias("micro"), F.round(F.avg(F.col("a") / F.col("g")), 6).alias("macro"), F.round(F.avg((F.col("a") > 0).cast("double")), 6).alias("any"), F.round(F.avg((F.col("a") == F.col("g")).cast("double")), 6).alias("all"))


def select_weight(scores: DataFrame) -> DataFrame:
    """Of (w, value) the w of largest value; ties go to the one closest to 0.5, then the smaller."""
    return scores.orderBy(F.desc("value"), F.abs(F.col("w") - 0.5), "w").limit(1)


def rank_auc(df: DataFrame, by: list[str], score: str, positive: str) -> DataFrame:
    """Mann-Whitney AUC with average ranks; NULL where a class is missing."""
    w = Window.partitionBy(*by).orderBy(score)
    r = F.rank().over(w) + (F.count("*").over(Window.partitionBy(*by, score)) - 1) / 2
    g = df.withColumn("_r", r).groupBy(*by).agg(F.sum(F.when(F.col(positive), F.col("_r"))).alias("s"), F.count(F.when(F.col(positive), 1)).alias("p"), F.count(F.when(~F.col(positive), 1)).alias("n"))
    return g.select(*by, F.round(F.when((F.col("p") > 0) & (F.col("n") > 0), (F.col("s") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * F.col("n"))), 6).alias("auc"))


def holm(tests: DataFrame) -> DataFrame:
    """Holm's step-down adjustment of (test, p); NULL and NaN are left out."""
    t = tests.where("p is not null and not isnan(p)")
    w = Window.orderBy("p", "test")
    raw = (F.count("*").over(Window.partitionBy()) - F.row_number().over(w) + 1) * F.col("p")
    return t.withColumn("_raw", raw).withColumn("adjusted", F.least(F.lit(1.0), F.max("_raw").over(w.rowsBetween(Window.unboundedPreceding, 0)))).drop("_raw")


#: 97.5 % quantiles of Student's t for 1 to 30 degrees of freedom (fixed values).
T975 = [
    12.706204736, 4.302652730, 3.182446305, 2.776445105, 2.570581836, 2.446911851, 2.364624252, 2.306004135, 2.262157163, 2.228138852,
    2.200985160, 2.178812830, 2.160368656, 2.144786688, 2.131449546, 2.119905299, 2.109815578, 2.100922040, 2.093024054, 2.085963447,
    2.079613845, 2.073873068, 2.068657610, 2.063898562, 2.059538553, 2.055529439, 2.051830516, 2.048407142, 2.045229642, 2.042272456,
]


def t_interval(df: DataFrame, by: list[str], delta: str) -> DataFrame:
    """by, n, mean, sd, t and the 95 % interval of each group of two values or more. The quantile of Student's t comes from
    T975, beyond its 30 degrees of freedom from the expansion in powers of 1 / degrees around the normal one."""
    g = df.groupBy(*by).agg(F.count(delta).alias("n"), F.avg(delta).alias("m"), F.stddev_samp(delta).alias("s")).where("n > 1")
    z, v = 1.959963984540054, F.col("n") - 1
    far = z + (z**3 + z) / (4 * v) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * v * v) + (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / (384 * F.pow(v, 3))
    q = F.coalesce(F.get(F.array(*map(F.lit, T975)), (v - 1).cast("int")), far)
    error = F.col("s") / F.sqrt("n")
    return g.select(*by, "n", F.round("m", 6).alias("mean"), F.round("s", 6).alias("sd"), F.round(F.try_divide(F.col("m"), error), 5).alias("t"), F.round(F.col("m") - q * error, 5).alias("low"), F.round(F.col("m") + q * error, 5).alias("high"))


def crossovers(gaps: DataFrame) -> DataFrame:
    """rate: of (rate, gap), one row for each screened rate, both ends and the zeros with their neighbours, or without exact
    zeros both sides of every change of sign."""
    w = Window.orderBy("rate")
    near = gaps.withColumns({"b": F.lag("gap").over(w), "a": F.lead("gap").over(w), "zeros": F.count(F.when(F.col("gap") == 0, 1)).over(Window.partitionBy())})
    zero = (F.col("gap") == 0) | F.coalesce(F.col("a") == 0, F.lit(False)) | F.coalesce(F.col("b") == 0, F.lit(False))
    sign = F.coalesce(F.col("gap") * F.col("a") < 0, F.lit(False)) | F.coalesce(F.col("gap") * F.col("b") < 0, F.lit(False))
    return near.where(F.col("a").isNull() | F.col("b").isNull() | F.when(F.col("zeros") > 0, zero).otherwise(sign)).select("rate")


def paired_deltas(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    """query_id, delta of two result tables over the same queries; a query that only one has is an error when read."""
    j = a.select("query_id", F.col(value).alias("_a")).join(b.select("query_id", F.col(value).alias("_b")), "query_id", "full")
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    return j.select("query_id", F.when(both, F.col("_a") - F.col("_b")).otherwise(F.raise_error(F.lit("queries differ")).cast("double")).alias("delta"))


def bootstrap(deltas: DataFrame, draws: int = 1000) -> DataFrame:
    """mean, low, high, positive of (query_id, delta): the mean of the draws' means (each weighs every query by a Poisson(1) count, the
    same on any partitions), their 95 % interval, and the share of draws above 0."""
    means = draw_sums(deltas, [], {"s": F.col("delta")}, draws).select(F.round(F.try_divide("s", "w"), 9).alias("m"))
    p = F.percentile("m", F.array(F.lit(0.025), F.lit(0.975)))
    return means.agg(F.avg("m").alias("mean"), F.get(p, F.lit(0)).alias("low"), F.get(p, F.lit(1)).alias("high"), F.avg((F.col("m") > 0).cast("double")).alias("positive"))


def draw_sums(df: DataFrame, by: list[str], values: dict[str, Column], draws: int) -> DataFrame:
    """by, draw (1 to draws), w, n and each value's sum over the rows of a group, weighted by poisson_weight(draw, query_id); w is
    the sum of weights, n the number of rows. A task keeps one vector of sums for each group and value, so what is shuffled is a
    row for each draw, group and task, not for each draw and query."""
    import hashlib

    import numpy as np
    import pyarrow as pa

    names, steps, zero = list(values), np.array(POISSON), ("w", "n")
    rows = df.select(*by, "query_id", *[c.cast("double").alias(n) for n, c in values.items()])
    shape = StructType([*[f for f in rows.schema.fields if f.name in by], *StructType.fromDDL("draw int, w double, n long, " + ", ".join(f"{n} double" for n in names)).fields])

    def weights(query) -> np.ndarray:
        h = [int.from_bytes(hashlib.md5(f"{d}:{query}".encode()).digest()[:4], "big") for d in range(1, draws + 1)]
        return np.searchsorted(steps, (np.array(h) + 0.5) / (1 << 32)).astype(float)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(shape)
        state: dict = {}

        def flush():
            for key, (sums, n) in state.items():
                yield pa.RecordBatch.from_arrays([*[pa.array([k] * draws, arrow.field(i).type) for i, k in enumerate(key)], pa.array(np.arange(1, draws + 1), pa.int32()), pa.array(sums[0]), pa.array([n] * draws, pa.int64()), *[pa.array(s) for s in sums[1:]]], schema=arrow)
            state.clear()

        last, w = None, None
        for batch in batches:
            col = batch.to_pydict()
            for key, query, xs in zip(zip(*(col[b] for b in by), strict=True) if by else [()] * batch.num_rows, col["query_id"], zip(*(col[n] for n in names), strict=True), strict=True):
                if w is None or query != last:
                    last, w = query, weights(query)
                sums, n = state.get(key) or (np.zeros((1 + len(names), draws)), 0)
                sums[0] += w
                for i, x in enumerate(xs, 1):
                    sums[i] += w * x
                state[key] = (sums, n + 1)
                if len(state) > 1000:
                    yield from flush()
        yield from flush()

    return rows.mapInArrow(run, shape).groupBy(*by, "draw").agg(*[F.sum(c).alias(c) for c in (*zero, *names)])


def poisson_weight(*parts: Column | str) -> Column:
    """A Poisson(1) count (at most nine) from the first 32 bits of the MD5 of the parts, joined by colons."""
    h = F.conv(F.substring(F.md5(F.concat_ws(":", *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts])), 1, 8), 16, 10).cast("long")
    u = (h + 0.5) / float(1 << 32)
    weight = F.lit(0)
    for t in POISSON:
        weight = weight + (u > t).cast("int")
    return weight


def _poisson_steps() -> list[float]:
    term, total, out = math.exp(-1), math.exp(-1), []
    for k in range(1, 10):
        out.append(total)
        term /= k
        total += term
    return out


POISSON = _poisson_steps()


def two_level_bootstrap(deltas: DataFrame, draws: int = 1000) -> DataFrame:
    """runs, mean, low, high of (run, query_id, delta): each draw takes as many runs as there are with replacement, then
    weighs each query with a Poisson(1) count that all runs share. Every run must hold the same queries.

    Queries are added up by (draw, run) in each task; the runs' draws are a table of draws x runs rows."""
    sums = cut(draw_sums(deltas, ["run"], {"s": F.col("delta")}, draws))
    placed = sums.withColumns({"place": F.row_number().over(Window.partitionBy("draw").orderBy("run")) - 1, "runs": F.count("*").over(Window.partitionBy("draw"))})
    slot = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit("run"), F.col("draw").cast("string"), F.col("slot").cast("string"))), 1, 8), 16, 10).cast("long")
    taken = placed.select("draw", "runs").distinct().withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("runs") - 1))).select("draw", (slot % F.col("runs")).alias("place"))
    same = F.when(F.min("n") == F.max("n"), F.sum("s") / F.count("*")).otherwise(F.raise_error(F.lit("runs hold different queries")).cast("double"))
    checked = placed.groupBy("draw").agg(same.alias("_same"), F.max("w").alias("all"))
    means = placed.join(taken, ["draw", "place"]).groupBy("draw").agg(F.sum("s").alias("s"), F.count("*").alias("k")).join(checked.where("_same is not null"), "draw").select(F.round(F.try_divide("s", F.col("k") * F.col("all")), 9).alias("m"))
    p = F.percentile("m", F.array(F.lit(0.025), F.lit(0.975)))
    ends = means.agg(F.get(p, F.lit(0)).alias("low"), F.get(p, F.lit(1)).alias("high"))
    return deltas.agg(F.count_distinct("run").alias("runs"), (F.round(F.avg("delta"), 6) + 0.0).alias("mean")).crossJoin(F.broadcast(ends)).select("runs", "mean", (F.round("low", 6) + 0.0).alias("low"), (F.round("high", 6) + 0.0).alias("high"))


def share_interval(values: DataFrame, draws: int = 1000) -> DataFrame:
    """measure, stat, point, low, high of (query_id, measure, base, middle, top): what middle and top gain over base, the
    share of top's gain that middle reaches, and the gap between them, with ends by nearest rank over Poisson draws. A share
    is null where top gains nothing; in the draws that counts as less than any number."""
    gains = {"top_gain": F.col("top") - F.col("base"), "middle_gain": F.col("middle") - F.col("base"), "gap": F.col("top") - F.col("middle")}
    least = F.lit(float("-inf"))
    share = F.when(F.col("top_gain") > 0, F.col("middle_gain") / F.col("top_gain")).otherwise(least)
    point = values.groupBy("measure").agg(*[F.round(F.avg(c), 9).alias(n) for n, c in gains.items()]).withColumn("share", share)
    drawn = draw_sums(values, ["measure"], gains, draws).select("measure", "draw", *[F.round(F.try_divide(n, "w"), 9).alias(n) for n in gains]).withColumn("share", share)
    names = [*gains, "share"]
    long = lambda df, *key: df.select(*key, F.explode(F.array(*[F.struct(F.lit(n).alias("stat"), F.col(n).alias("x")) for n in names])).alias("s")).select(*key, "s.*")
    at = lambda q: F.get("xs", (F.greatest(F.ceil(q * F.size("xs")), F.lit(1)) - 1).cast("int"))
    ends = long(drawn, "measure", "draw").groupBy("measure", "stat").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    shown = lambda c, name: (F.round(F.when(c > least, c), 6) + 0.0).alias(name)
    return long(point, "measure").join(ends, ["measure", "stat"]).select("measure", "stat", shown(F.col("x"), "point"), shown(at(0.025), "low"), shown(at(0.975), "high"))


def interval_labels(deltas: DataFrame, by: list[str], draws: int = 1000) -> DataFrame:
    """by, mean, low, high, label of (by, query_id, delta): SAME where every delta is 0, else ABOVE or BELOW where the 95 %
    interval of Poisson draws lies on one side of 0, else AT."""
    whole = deltas.groupBy(*by).agg((F.round(F.avg("delta"), 6) + 0.0).alias("mean"), (F.max(F.abs("delta")) == 0).alias("same"))
    means = draw_sums(deltas, by, {"s": F.col("delta")}, draws).select(*by, "draw", F.round(F.try_divide("s", "w"), 9).alias("m"))
    p = F.percentile("m", F.array(F.lit(0.025), F.lit(0.975)))
    ends = means.groupBy(*by).agg((F.round(F.get(p, F.lit(0)), 6) + 0.0).alias("low"), (F.round(F.get(p, F.lit(1)), 6) + 0.0).alias("high"))
    label = F.when(F.col("same"), "SAME").when(F.col("low") > 0, "ABOVE").when(F.col("high") < 0, "BELOW").otherwise("AT")
    return whole.join(ends, by).select(*by, "mean", "low", "high", label.alias("label"))


def adoption(labels: DataFrame, by: list[str]) -> DataFrame:
    """by, verdict: NOT_ADOPTED where any label is BELOW, else ADOPT where any is ABOVE, else NO_EFFECT."""
    some = lambda x: F.bool_or(F.col("label") == x)
    return labels.groupBy(*by).agg(F.when(some("BELOW"), "NOT_ADOPTED").when(some("ABOVE"), "ADOPT").otherwise("NO_EFFECT").alias("verdict"))
