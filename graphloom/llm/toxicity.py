"""Toxicity by maximum-scoring segments.

Token scores are log-odds under a Dirichlet prior. A linear-time scan finds all maximal scoring segments of
a document. Extreme-value statistics (E = K n exp(-lambda S)) turn a segment's score into an expected number of such
segments in clean text of that length, and a two-parameter logistic fit turns a document's evidence into a probability."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, cut, map_batches, stash

TOKEN = re.compile(r"\w+")


@dataclass
class ToxicModel:
    """odds: token -> shrunk log-odds of the toxic against the clean class, plus rest, where they are not shrunk to 0; rest:
    the (negative) score of all other tokens; scale, k: of the extreme-value law; bias, slope: of the calibration."""

    odds: dict[str, float]
    rest: float
    scale: float = 1.0
    k: float = 0.1
    bias: float = 0.0
    slope: float = 1.0


def scores(text: str | None, m: ToxicModel) -> list[float]:
    """The score of each token of a text, in order."""
    return [m.odds.get(w, m.rest) for w in TOKEN.findall(text.lower())] if text else []


def segments(found: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first token, last token, score), by one pass over the tokens with a stack of the
    positive ones: each entry keeps the running sum before and after it, and the place of the nearest earlier entry that
    starts lower, by which searches jump. Where nothing starts lower, what lies on the stack is final and leaves it."""
    done: list[tuple[int, int, float]] = []
    stack: list[tuple[int, int, float, float, int]] = []  # first, last, sum before, sum after, nearest that starts lower
    total = 0.0
    for i, score in enumerate(found):
        if score <= 0:
            total += score
            continue
        first, before, total = i, total, total + score
        lower = len(stack) - 1
        while True:
            while lower >= 0 and stack[lower][2] >= before:
                lower = stack[lower][4]
            if lower < 0 or stack[lower][3] >= total:
                break
            first, _, before, _, next_lower = stack[lower]
            del stack[lower:]
            lower = next_lower
        if lower < 0:
            done += [(a, b, y - x) for a, b, x, y, _ in stack]
            stack.clear()
        stack.append((first, i, before, total, lower))
    return done + [(a, b, y - x) for a, b, x, y, _ in stack]


def evidence(score: float, n: int, m: ToxicModel) -> float:
    """-ln of the expected number of segments with this score in n tokens of clean text."""
    return m.scale * score - math.log(m.k * max(n, 1))


def document(text: str | None, m: ToxicModel, most_expected: float = 0.05) -> tuple[float, int, list[tuple[int, int, float]]]:
    """Evidence of a document: its best segment's, plus what further significant ones add (the sum of the -ln E of all
    significant segments); with the significant segments and the number of tokens."""
    found = scores(text, m)
    n = len(found)
    parts = [(a, b, evidence(s, n, m)) for a, b, s in segments(found)]
    sig = [p for p in parts if p[2] >= -math.log(most_expected)]
    x = sum(p[2] for p in sig) if sig else max((p[2] for p in parts), default=evidence(0.0, n, m))
    return min(max(x, -20.0), 60.0), n, sig


def fit(train: DataFrame, most_tokens: int = 100_000, prior: float = 500.0, z: float = 2.5) -> ToxicModel:
    """Fits on (text, toxic) rows, a bounded sample, which is written once. Tokens are counted on the executors; the driver
    gets their counts and two numbers for each row of the sample. Rows without a label don't count.

    Every token has its own log-odds under a Dirichlet prior of `prior` tokens in proportion to the whole
    sample and half a token each, shrunk as by James and Stein: by the factor 1 - (z * standard error / log-odds) ** 2, to 0
    where that is negative. Added to each is the log-odds of all tokens that are not toxic, which is below 0, so
    that clean text scores below 0 on average. Tokens shrunk to 0 score as unseen ones do and are not sent to the
    driver; of the others at most most_tokens are, those of the largest log-odds. Without words of both classes nothing
    can be learned, and the model predicts clean for every text."""
    train = stash(train.where("toxic is not null").select(F.coalesce("text", F.lit("")).alias("text"), F.col("toxic").cast("int").alias("toxic")), "toxicity-training")

    def count(c: dict) -> dict:
        from collections import Counter

        by = (Counter(), Counter())
        for t, y in zip(c["text"], c["toxic"], strict=True):
            by[int(y > 0)].update(set(TOKEN.findall(t.lower())))  # once a document, so that one text cannot make a token
        words = list(by[0].keys() | by[1].keys())
        return {"word": words, "clean": [by[0][w] for w in words], "bad": [by[1][w] for w in words]}

    words = cut(map_batches(train, count, "word string, clean long, bad long", rows=2048).groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("bad").alias("bad")))
    sums = words.agg(F.sum("clean"), F.sum("bad"), F.count("*")).first()
    n0, n1 = float(sums[0] or 0), float(sums[1] or 0)
    if not n0 or not n1:
        return ToxicModel({}, -0.01, bias=-1.0, slope=0.0)
    own = (F.col("clean") + F.col("bad")) * F.lit(prior / (n0 + n1)) + 0.5
    b, c, all_own = F.col("bad") + own, F.col("clean") + own, prior + 0.5 * sums[2]
    odds = F.nullif(F.log(b / (n1 + all_own - b)) - F.log(c / (n0 + all_own - c)), F.lit(0.0))
    error = F.sqrt(1 / b + 1 / c)
    shrunk = odds * F.greatest(1 - F.pow(z * error / odds, 2), F.lit(0.0))
    top = words.select("word", "clean", "bad", shrunk.alias("odds")).where("odds <> 0").orderBy(F.abs("odds").desc(), "word").limit(most_tokens).collect()
    # What toxic text gives to its own words it takes from all others; their common log-odds is the drift of clean text.
    p0, p1 = ((sum(r[k] for r in top if r["odds"] > 0) + 0.5) / (n + 1) for k, n in (("clean", n0), ("bad", n1)))
    rest = min(math.log(max(1 - p1, 1e-9) / (1 - p0)), -1e-3)
    m = ToxicModel({r["word"]: r["odds"] + rest for r in top}, rest)
    m.scale = _scale([((r["clean"] + 0.5) / (n0 + 0.5 * sums[2]), r["odds"] + rest) for r in top], rest)
    # K: how many segments clean text of the sample has above a score, over what the law without K expects.
    level = 2 / m.scale

    def clean_segments(c: dict) -> dict:
        found = [scores(t, m) for t, y in zip(c["text"], c["toxic"], strict=True) if not y]
        return {"n": [sum(s >= level for _, _, s in segments(f)) for f in found], "tokens": [len(f) for f in found]}

    seen = map_batches(train, clean_segments, "n long, tokens long").agg(F.sum("n"), F.sum("tokens")).first()
    m.k = ((seen[0] or 0) + 0.5) / (max(seen[1] or 0, 1) * math.exp(-m.scale * level))

    def measure(c: dict) -> dict:
        return {"x": [document(t, m)[0] for t in c["text"]], "y": [int(y > 0) for y in c["toxic"]]}

    _calibrate(m, [(r["x"], r["y"]) for r in map_batches(train, measure, "x double, y int").collect()])
    return m


def _scale(freq: list[tuple[float, float]], rest: float) -> float:
    """The positive root of E[exp(scale * score)] = 1 under the clean token frequencies (share, score)."""
    other = max(1 - sum(p for p, _ in freq), 0.0)
    low, high = 1e-3, 10.0
    for _ in range(60):
        mid = (low + high) / 2
        value = other * math.exp(mid * rest) + sum(p * math.exp(min(mid * s, 700)) for p, s in freq)
        low, high = (mid, high) if value < 1 else (low, mid)
    return low


def _calibrate(m: ToxicModel, seen: list[tuple[float, int]]) -> None:
    """Two-parameter logistic regression by Newton's method, with a small ridge on the slope."""
    a, b = 0.0, 0.0
    for _ in range(50):
        ga = gb = haa = hab = hbb = 0.0
        for x, y in seen:
            p = 1 / (1 + math.exp(-max(min(a + b * x, 30), -30)))
            w = p * (1 - p)
            ga, gb, haa, hab, hbb = ga + y - p, gb + (y - p) * x, haa + w, hab + w * x, hbb + w * x * x
        gb, haa, hbb = gb - 0.01 * b, haa + 1e-6, hbb + 0.01
        d = haa * hbb - hab * hab
        if abs(d) < 1e-12:
            break
        da, db = (hbb * ga - hab * gb) / d, (haa * gb - hab * ga) / d
        step = min(1.0, 5.0 / max(abs(da), abs(db), 1e-9))
        a, b = a + step * da, b + step * db
        if abs(da) + abs(db) < 1e-7:
            break
    m.bias, m.slope = a, b


def training_rows(docs: DataFrame, labels: DataFrame, most: int = 20_000) -> DataFrame:
    """(text, toxic) of at most `most` labelled documents outside fold 0, chosen by hash of doc_id, whole texts. The chosen
    labels are bounded by `most`, so they are broadcast. Of several labels of a document the largest counts, and of rows that
    repeat a doc_id the one whose text has the smallest digest, so that the rows are bounded by `most`, too."""
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5))
    one = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = bounded_sample(one, "doc_id", most)
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id", "toxic").agg(F.min_by(F.coalesce("text", F.lit("")), F.sha2(F.coalesce("text", F.lit("")), 256)).alias("text")).select("text", "toxic")


def score_toxicity(docs: DataFrame, m: ToxicModel) -> DataFrame:
    """doc_id, score (0 to 1, higher is likelier toxic), predicted, n_tokens, passages (first and last token and evidence
    of every significant segment). Every row and whole text is scored; null and empty texts get the score of no evidence.
    Repeated rows are scored each, a null doc_id is kept, no rows give none; further columns are not carried. No shuffle."""

    def each(c: dict) -> dict:
        out = {"doc_id": c["doc_id"], "score": [], "n_tokens": [], "passages": []}
        for t in c["text"]:
            x, n, sig = document(t, m)
            out["score"].append(1 / (1 + math.exp(-max(min(m.bias + m.slope * x, 30), -30))))
            out["n_tokens"].append(n)
            out["passages"].append([{"first": a, "last": b, "evidence": e} for a, b, e in sig])
        return out

    shape = "doc_id long, score double, n_tokens long, passages array<struct<first: long, last: long, evidence: double>>"
    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), each, shape).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, m: ToxicModel) -> DataFrame:
    """The rows of docs that are not predicted toxic, with their columns; a map without shuffle. A null or empty text has no
    evidence, so it goes only if such texts are predicted toxic; repeated rows share their fate, no rows give none."""

    def judge(batches):
        import pyarrow as pa

        for b in batches:
            text = b.column(b.schema.names.index("text")).to_pylist()
            yield b.filter(pa.array([m.bias + m.slope * document(t, m)[0] < 0 for t in text], pa.bool_()))

    return docs.mapInArrow(judge, docs.schema)
