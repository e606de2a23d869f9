"""Spelling variants, hard negatives and repeated word windows against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphloom.llm import debruijn, hard_negatives, queries, spelling

DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def clashing(df, columns):
    """Extra columns with names that the operators use inside."""
    return df.withColumns({c: F.lit("x") for c in columns})


def near(a, b):
    if a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(rows, least=3, noise=97):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc}:{run}".encode())
            if noise and doc is not None and h % noise == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= least}
    out = {}
    for w, n in words.items():
        others = [v for v in words if near(w, v)]
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form = best if best is not None and words[best] >= 2 * n else None
        out[w] = [form, w, n, len(others), words[form] if form else None]
    for w in out:
        while out[out[w][1]][0]:
            out[w][1] = out[out[w][1]][0]
    return {w: tuple(v) for w, v in out.items()}


def variants(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


@pytest.fixture(scope="module")
def spelled():
    """Words of few letters and many lengths, very often and seldom, some of them chains of ever commoner forms."""
    rng = random.Random(2)
    words = ["".join(rng.choice("abÉÿC") for _ in range(rng.randint(4, 9))) for _ in range(250)]
    words += [w[:i] + rng.choice("abZ") + w[i:] for w in words for i in (0, len(w) // 2, len(w))]
    rows = [(i, rng.choice([" ", "-", "3", "ł"]).join(rng.choice(words[: rng.choice([20, 300, 900])]) for _ in range(rng.randint(1, 150)))) for i in range(120)]
    chain = ["aaaaaaa" + "b" * k for k in range(6)]
    rows += [(500 + k, " ".join([w] * 3 * 2**k)) for k, w in enumerate(chain)]
    rows += [(700, None), (701, ""), (702, "1 2 3"), (703, "a" * 20_000 + " x"), (704, "a" * 20_000), (705, "a" * 20_000 + " " + "a" * 19_999), (None, "nobody nobody nobody"), (3, rows[3][1]), (3, rows[3][1])]
    return rows


def test_variants(spark, spelled):
    short = [(d, t) for d, t in spelled if len(t or "") < 15_000]
    df = spark.createDataFrame(short, "doc_id long, text string").repartition(4)
    assert variants(spelling.group_variants(clashing(df, ["word", "n", "side", "key", "form", "blocks"]))) == brute_variants(short)
    long = variants(spelling.group_variants(spark.createDataFrame([r for r in spelled if r[0] and r[0] > 499], "doc_id long, text string")))
    assert long["a" * 20_000] == (None, "a" * 20_000, 3, 0, None)
    assert spelling.group_variants(df.limit(0)).count() == 0


@pytest.mark.parametrize(("cell", "most"), [(50, 40), (10, 1_000_000)])
def test_variant_cells(spark, spelled, cell, most):
    """Keys dealt over grids of blocks and slices, and many small cells, find the same."""
    short = [(d, t) for d, t in spelled if len(t or "") < 15_000]
    want = brute_variants(short)
    vocabulary = spark.createDataFrame([(w, v[2]) for w, v in want.items()], "word string, n long")
    got = {r["word"]: r["n_near"] for r in spelling.near_words(vocabulary, cell, most).collect()}
    assert got == {w: v[3] for w, v in want.items() if v[3]}


def test_index_states():
    """The two intervals of a state stay in step whichever way a pattern is put together."""
    words = sorted({"banana", "bananas", "bandana", "anaba", "nab", "ananas", "é"})
    index = spelling.Index(words, "".join(sorted(set("".join(words)))))
    whole = np.array([[0], [0], [index.size]])
    for pattern in ("ana", "ban", "na", "nn", "s"):
        codes = [np.array([c], np.int64) for c in index.coded(pattern)]
        ahead, back = whole, whole
        for c in codes:
            ahead = index.extend(ahead, c, True)
        for c in reversed(codes):
            back = index.extend(back, c, False)
        assert ahead[2] == back[2] == sum(w[i:].startswith(pattern) for w in words for i in range(len(w)))
        if ahead[2]:
            assert (ahead == back).all()


def brute_negatives(rows, every=50):
    able = {}
    for i, e, label in rows:
        if i is None or label is None or not e or any(v is None or not np.isfinite(v) for v in e):
            continue
        x = tuple(int(np.floor(256 * float(v))) for v in e)
        able[i] = min(able.get(i, (9e9, ())), ((label + 1) % 10 if i % 7 == 0 else label, x))
    dims = Counter(len(x) for _, x in able.values())
    d = min(dims, key=lambda k: (-dims[k], k), default=0)
    able = {i: v for i, v in able.items() if len(v[1]) == d}
    dot = lambda a, b: sum(p * q for p, q in zip(able[a][1], able[b][1], strict=True))
    out = []
    for a in sorted(i for i in able if i % every == 0):
        scored = sorted((-dot(a, b), b) for b in able if b != a)
        for s, p in [(s, b) for s, b in scored if able[b][0] == able[a][0]][:5]:
            fit = [(t, b) for t, b in scored if able[b][0] != able[a][0] and 50 * -s <= 100 * -t <= 95 * -s][:3]
            out += [(a, p, k, b, -s, -t) for k, (t, b) in enumerate(fit, 1)]
    return sorted(out)


def mined(df):
    return sorted((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in df.collect())


@pytest.mark.parametrize("small", [True, False])
def test_hard_negatives(spark, small):
    """Groups of like vectors, many equal ones, nulls, other dimensions, repeated identifiers; trees of few and many nodes."""
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(6, 8))
    rows = [(i, [float(v) for v in np.float32(middle[i % 6] + rng.normal(size=8) * 0.4)], int(rng.integers(3))) for i in range(700)]
    rows += [(1000 + i, rows[5][1], i % 2) for i in range(200)]
    rows += [(2000, None, 1), (2001, [], 1), (2002, [1.0, None] * 4, 1), (2003, [float("nan")] * 8, 1), (2004, [float("inf")] * 8, 1), (2005, rows[0][1], None), (2050, [1.0, 2.0], 1), (None, rows[1][1], 1), (50, rows[3][1], 0), (50, rows[50][1], 2), (2100, [0.0] * 8, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    kw = {"sample": 60, "fanout": 3, "leaf": 8, "block": 50, "per_slice": 4} if small else {}
    assert mined(hard_negatives.mine(clashing(df, ["leaf", "slice", "block", "x", "score"]), **kw)) == brute_negatives(rows)
    assert mined(hard_negatives.mine(df.limit(0))) == []


def test_tree_drops_leaves():
    """Far leaves are left out, none that holds a row of the window is."""
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(3000, 3)) * 50 + rng.integers(-3, 4, size=(3000, 1)) * 200)
    tree = hard_negatives.fit_tree(x[:500], float((x * x).sum(1).max()), 4, 20)
    leaf, ranges = tree.walk(x)
    for n in tree.nodes:
        n.low, n.high = np.full((len(n.points),) * 2, np.inf), np.full((len(n.points),) * 2, -np.inf)
    for (at, point, child), (a, b) in ranges.items():
        tree.nodes[at].low[point, child], tree.nodes[at].high[point, child] = a, b
    q, score = x[:40], x[:40] @ x.T
    least, most = np.percentile(score, 99, axis=1), np.percentile(score, 99.5, axis=1)
    who, found = tree.reach(q, least, most)
    need = {(i, int(leaf[j])) for i in range(40) for j in np.flatnonzero((score[i] >= least[i]) & (score[i] <= most[i]))}
    got = set(zip(who.tolist(), found.tolist(), strict=True))
    assert need <= got and len(got) < 0.7 * 40 * tree.leaves


def brute_windows(rows, k=20):
    """rows in order of place: (identifier, text)."""
    seen, out = set(), []
    for doc, text in rows:
        w = WORD.findall(text or "")
        gone = [False] * len(w)
        for i in range(len(w) - k + 1):
            t = tuple(w[i : i + k])
            if t in seen:
                gone[i : i + k] = [True] * k
            seen.add(t)
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((doc, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(out)


def windows_of(df):
    return Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in df.collect())


@pytest.fixture(scope="module")
def passages():
    rng = random.Random(5)
    words = lambda n: ["".join(rng.choice("abcdéfgh") for _ in range(rng.randint(1, 6))) for _ in range(n)]
    base = [words(rng.randint(10, 200)) for _ in range(30)]
    texts = {i: " ".join(b) for i, b in enumerate(base)}
    passage = words(60)
    for i in range(20):
        a, b = rng.choice(base), rng.choice(base)
        texts[100 + i] = "\n".join([" ".join(a[rng.randrange(len(a)) :]), "  ".join(passage[rng.randrange(30) :]), "\t".join(b[: rng.randrange(len(b))])])
    texts |= {200: None, 201: "", 202: " \n ", 203: "a " * 5000, 204: "a b " * 300, 205: "a b c d e f g h i j k l m n o p q r s t u v w " * 20, 206: texts[0] * 3, 207: " ".join(passage * 8), 208: texts[3], 209: texts[3], 210: "\0 \0 x " * 30}
    return texts


@pytest.mark.parametrize("parts", [1, 40])
def test_windows(spark, passages, parts):
    """All documents in one batch, where copies settle at once, and nearly one a batch, where they meet by anchor."""
    rows = [(i, t, "en", "s", 1) for i, t in passages.items()]
    df = clashing(spark.createDataFrame(rows, DOC).repartition(parts), ["base", "runs", "path", "start", "many", "n"])
    assert windows_of(debruijn.remove_repeats(df)) == brute_windows(sorted(passages.items()))


def test_window_stretches_and_repeats(spark, passages, monkeypatch):
    """Texts far longer than a stretch, rows given twice and more, different texts of one identifier, rows without one."""
    monkeypatch.setattr(debruijn.find_runs, "__defaults__", (200, 200_000))
    rows = [(i, t) for i, t in passages.items() if i < 130] + [(5, passages[5]), (5, passages[5]), (7, passages[9]), (7, None), (None, passages[0]), (None, passages[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    order = {r["text"]: r["h"] for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
    want = brute_windows(sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], order[r[1]])))
    n = len(WORD.findall(passages[0]))
    want[None, n, 0, hashlib.sha256(" ".join(WORD.findall(passages[0])).encode()).hexdigest()] = 2
    assert windows_of(debruijn.remove_repeats(df, most_words=37)) == want
    assert debruijn.remove_repeats(df.limit(0)).count() == 0


@pytest.mark.parametrize("small", [0, 1000])
def test_chains(spark, small):
    """Long chains, single segments and cycles, by shuffle and by broadcast."""
    rng = random.Random(6)
    order = list(range(300))
    rng.shuffle(order)
    prev, path, offset = {}, {}, {}
    size = {i: rng.randint(1, 9) for i in range(340)}
    for a, b in zip([None, *order], order, strict=False):
        prev[b], path[b], offset[b] = a, order[0], offset[a] + size[a] if a is not None else 0
    for ring in ([300 + i for i in range(7)], [320], [330, 331]):
        for i, x in enumerate(ring):
            prev[x], path[x], offset[x] = ring[i - 1], ring[0], sum(size[y] for y in ring[:i])
    prev[339], path[339], offset[339] = None, 339, 0
    df = spark.createDataFrame([(i, size[i], p) for i, p in prev.items()], "id long, size long, prev long")
    assert {r["id"]: (r["path"], r["offset"]) for r in debruijn.chains(df, small).collect()} == {i: (path[i], offset[i]) for i in prev}


def test_compact(spark):
    """Two sources share a middle: it is a path of its own, and what goes on without a branch is one path."""
    edges = [(1, 0, 3, 10, 11), (1, 3, 1, 11, 12), (1, 4, 1, 12, 13), (2, 5, 2, 20, 12), (3, 9, 1, 13, 14)]
    df = spark.createDataFrame(edges, "doc_id long, start long, many int, tail long, head long")
    got = {(r["doc_id"], r["start"]): (r["path_doc"], r["path_start"], r["offset"]) for r in debruijn.compact(df).collect()}
    assert got == {(1, 0): (1, 0, 0), (1, 3): (1, 0, 3), (1, 4): (1, 4, 0), (2, 5): (2, 5, 0), (3, 9): (1, 4, 1)}


def test_queries(spark):
    """The registered queries over the smallest tables."""
    at = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{at}/documents.parquet").collect()]
    assert variants(queries.op11_spelling(spark, at)) == brute_variants(docs)
    assert windows_of(queries.op13_word_dedup(spark, at)) == brute_windows(sorted(docs))
    vectors = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{at}/embeddings.parquet").collect()]
    assert mined(queries.op12_hard_negatives(spark, at)) == brute_negatives(vectors)


def test_cell_is_empty_without_either_side():
    t = pa.table({"side": [0], "word": ["abcde"], "n": [3], "indexed": [True], "asked": [False]})
    assert spelling.search_cell(t).num_rows == 0


def test_chains_broadcast_what_moves(spark, monkeypatch):
    """Settled segments are in no broadcast but the first, which has sizes only."""
    from pyspark.sql import functions as F

    prev = {i: (i - 1 if 0 < i < 64 else None) for i in range(400)}
    df = spark.createDataFrame([(i, 1, p) for i, p in prev.items()], "id long, size long, prev long")
    sent, real = [], F.broadcast
    monkeypatch.setattr(debruijn.F, "broadcast", lambda d: sent.append(d.count()) or real(d))
    got = {r["id"]: (r["path"], r["offset"]) for r in debruijn.chains(df).collect()}
    assert got == {i: (0, i) if i < 64 else (i, 0) for i in prev}
    assert len(sent) > 3 and sent[0] == 400 and max(sent[1:]) <= 63 and sorted(sent[1:], reverse=True) == sent[1:]


def test_chains_estimate_stays_small(spark):
    """The planned size of the state must not square each round: its digits doubled, until the driver held numbers of megabytes."""
    n = 1_500
    ring = [(i, 1, n + (i - n - 1) % 40) for i in range(n, n + 40)]
    df = spark.createDataFrame([(i, 1, i - 1 if i else None) for i in range(n)] + ring, "id long, size long, prev long")
    out = debruijn.chains(df, small=100)
    assert out._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 1 << 40
    assert {r["id"]: (r["path"], r["offset"]) for r in out.collect()} == {i: (0, i) if i < n else (n, i - n) for i in range(n + 40)}
