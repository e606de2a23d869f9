"""Neighbour graphs, posting lists, chains, assignments, bit searches and name links against plain versions."""

from __future__ import annotations

import itertools
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.operators import assignment, bitsearch, knn, linking, postings, sequences


def cosines(x):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    np.fill_diagonal(s, -np.inf)
    return s


def test_descent_recall(spark):
    """Nine tenths of the exact lists and more, on vectors without groups and on groups of near copies around a hub."""
    rng = np.random.default_rng(1)
    plain = rng.normal(size=(900, 24))
    groups = rng.normal(size=(30, 24))[rng.integers(30, size=900)] + rng.normal(size=(900, 24)) * 0.1
    groups[:300] = groups[0] + rng.normal(size=(300, 24)) * 1e-3
    for x in (plain, groups):
        df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "node_id long, vec array<double>").repartition(3)
        got = knn.descend(df, 5)
        best = np.argsort(-cosines(x), axis=1, kind="stable")[:, :5]
        exact = spark.createDataFrame([(i, int(j)) for i, r in enumerate(best) for j in r], "node_id long, nbr long")
        rows = got.collect()
        assert len(rows) == 4500 and {r["rank"] for r in rows} == set(range(1, 6))
        assert knn.recall(got, exact) >= 0.9
    same = {(r["node_id"], r["nbr"]) for r in rows}
    assert {(r["node_id"], r["nbr"]) for r in knn.descend(df.repartition(7), 5).collect()} == same


def test_descent_sends_little(spark):
    """From leaves far smaller than the table: right, and what the rounds send is bounded. Formerly each host's group was
    shuffled with all vectors and all of its pairs in every round."""
    x = np.random.default_rng(3).normal(size=(1500, 16))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "node_id long, vec array<double>")
    got = knn.descend(df, 5, trees=4, leaf=100)
    best = np.argsort(-cosines(x), axis=1, kind="stable")[:, :5]
    assert knn.recall(got, spark.createDataFrame([(i, int(j)) for i, r in enumerate(best) for j in r], "node_id long, nbr long")) >= 0.95
    dealt = knn.leaves(df, 4, 100).cache()
    assert dealt.count() == 4 * 1500 and dealt.groupBy("tree", "leaf", "chunk").count().where("count > 250").isEmpty()
    copies = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(900)], "node_id long, vec array<double>")
    assert knn.leaves(copies, 2, 100).groupBy("tree", "leaf", "chunk").count().where("count > 250").isEmpty()
    many = {r["node_id"]: r["n"] for r in knn.descend(copies, 3, trees=2, leaf=100).groupBy("node_id").count().withColumnRenamed("count", "n").collect()}
    assert len(many) == 900 and set(many.values()) == {3}


def test_families_and_manifest(spark):
    pairs = lambda rows: spark.createDataFrame(rows, "a long, b long")
    # low * 3 + high: structural 1, neighbours 5, names 2
    out = knn.families(pairs([(0, 1), (1, 2), (1, 2)]), pairs([(0, 1)]), pairs([(0, 2)]))
    got = defaultdict(set)
    for r in out.collect():
        assert r["a"] * 3 + r["b"] not in got[r["family"]]
        got[r["family"]].add(r["a"] * 3 + r["b"])
    assert dict(got) == {"A": {1, 5}, "STRUCT": {1}, "NER": {2}, "kNN": {5}, "B": {1, 2}, "C": {1, 2, 5}}
    nodes = spark.createDataFrame([(0,), (1,), (2,), (3,)], "node_id long")
    one, two = ({r["family"]: tuple(r)[1:] for r in knn.manifest(df, nodes).collect()} for df in (out, out.repartition(5).orderBy(F.rand())))
    assert one == two and one["STRUCT"][:3] == (1, 2, 0.5) and one["C"][:3] == (3, 3, 0.75) and len({v[3] for v in one.values()}) == 6


@pytest.mark.parametrize("size", [4, 64])
def test_postings(spark, size):
    """Exact for any size of blocks, with ties, common terms and queries that nothing answers."""
    rng = random.Random(size)
    docs = {i: [rng.choice("abcdefghij") * rng.randint(1, 2) for _ in range(rng.randint(0, 30))] + ["the"] * rng.randint(0, 20) for i in range(200)}
    asked = {0: ["a", "a", "the", "bb"], 1: ["cc"], 2: ["nothing"], 3: list("abcdefghij"), 4: []}
    frame = lambda d, key: spark.createDataFrame([(k, " ".join(v)) for k, v in d.items()], f"{key} long, text string")
    counts = postings.term_counts(frame(docs, "node_id"), "node_id", F.split("text", " "))
    weighted = postings.weights(counts, len(docs))
    df = defaultdict(int)
    for words in docs.values():
        for t in set(words):
            df[t] += 1
    weight = {(i, t): min(words.count(t), 8) * (len(docs) // df[t]).bit_length() for i, words in docs.items() for t in set(words)}
    assert {(r["node_id"], r["term"]): r["weight"] for r in weighted.collect()} == weight
    index = postings.blocks(weighted, size)
    assert max(r["n"] for r in index.select(F.size("postings").alias("n")).collect()) <= size
    q = postings.term_counts(frame(asked, "query_id"), "query_id", F.split("text", " ")).withColumnRenamed("tf", "q")
    got = {(r["query_id"], r["rank"]): (r["node_id"], r["score"]) for r in postings.top(index, q, 7, first=1).collect()}
    want = {}
    for k, terms in asked.items():
        sums = {i: sum(weight.get((i, t), 0) for t in terms) for i in docs}
        for rank, i in enumerate(sorted((i for i in docs if any((i, t) in weight for t in terms)), key=lambda i: (-sums[i], i))[:7], 1):
            want[k, rank] = (i, sums[i])
    assert got == want


def test_text_blocks(spark):
    """Straight from texts: the same blocks as by way of counts and weights, rows of one id added up; words are never shuffled."""
    rng = random.Random(8)
    rows = [(rng.randrange(90), " ".join(rng.choice(["a", "bb", "the", "the", f"w{rng.randrange(40)}"]) for _ in range(rng.randint(0, 40)))) for _ in range(120)] + [(3, None), (95, "")]
    texts = spark.createDataFrame(rows, "node_id long, text string")
    words = F.split("text", " ")
    counts = postings.term_counts(texts, "node_id", words)
    want = {(r["term"], r["block"]): (r["most"], [tuple(p) for p in r["postings"]]) for r in postings.blocks(postings.weights(counts, len(rows)), 16).collect()}
    asked = spark.createDataFrame([(1, t) for t in ("a", "the", "w3", "none")], "query_id long, term string")
    got = {(r["term"], r["block"]): (r["most"], [tuple(p) for p in r["postings"]]) for r in postings.text_blocks(texts, words, len(rows), asked, 16).collect()}
    assert got == {k: v for k, v in want.items() if k[0] in ("a", "the", "w3")} and got
    sums = {(r["term"], r["block"]): (r["most"], r["nodes"], r["total"]) for r in postings.block_sums(texts, words, len(rows), 16).collect()}
    assert sums == {k: (m, len(p), sum(x for _, x in p)) for k, (m, p) in want.items()}
    plan = postings.block_counts(texts, words)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("Exchange") > plan.index("Generate")


def test_chain_entries(spark):
    rng = random.Random(4)
    steps = sorted({(q, rng.randrange(12), rng.randrange(12), rng.randrange(4)) for q in (1, 2) for _ in range(40)})
    seeds = [(1, 0), (1, 1), (2, 5), (3, 4)]
    df = spark.createDataFrame(steps, "query_id long, u long, v long, z int")
    got = {(r["query_id"], r["node_id"], r["place"]): (r["hop"], r["chain"], r["mass"]) for r in sequences.chain_entries(df, spark.createDataFrame(seeds, "query_id long, node_id long"), 3, 4).collect()}
    want = {}
    for q in (1, 2):
        mine = [s for s in steps if s[0] == q]
        own = {n for k, n in seeds if k == q}
        now = {((), n): 1 / len(own) for n in own}
        entries = defaultdict(list)
        for hop in range(1, 4):
            new = defaultdict(float)
            for (chain, u), m in now.items():
                out = [s for s in mine if s[1] == u]
                for _, _, v, z in out:
                    new[(*chain, z), v] += m / len(out)
            now = new
            total = defaultdict(float)
            for (chain, v), m in now.items():
                total[chain] += 0 if v in own else m
            for (chain, v), m in now.items():
                if v not in own:
                    entries[v].append((-round(m / total[chain], 9), hop, ".".join(f"{z:02d}" for z in chain)))
        for v, rows in entries.items():
            for place, (m, hop, chain) in enumerate(sorted(rows)[:4], 1):
                want[q, v, place] = (hop, chain, -m)
    assert {k: (v[0], v[1], round(v[2], 7)) for k, v in got.items()} == {k: (v[0], v[1], round(v[2], 7)) for k, v in want.items()}


@pytest.mark.parametrize("directions", [1, 3, 5])
def test_least_assignment(spark, directions):
    """Against all injective maps; more golds than directions give null."""
    rng = random.Random(directions)
    rows = [(i, [[rng.random() for _ in range(directions)] for _ in range(rng.randint(1, directions + 1))]) for i in range(20)]
    df = spark.createDataFrame(rows, "i int, c array<array<double>>").select("i", assignment.least_assignment(F.col("c"), directions).alias("x"))
    all_ = {r["i"]: r["x"] for r in df.collect()}
    for i, c in rows:
        best = min((sum(c[g][d] for g, d in enumerate(p)) for p in itertools.permutations(range(directions), len(c))), default=None)
        assert (all_[i] is None) if best is None else all_[i] == pytest.approx(best)


def test_coverage_loss(spark):
    """One candidate pool by hand: the softmax is over candidates in each direction; a pool without golds is left out."""
    s = {10: [2.0, 0.0], 11: [1.0, 3.0], 12: [0.0, 0.0]}
    scores = spark.createDataFrame([(1, k, v) for k, v in s.items()] + [(2, 10, [0.0, 0.0])], "query_id long, node_id long, s array<double>")
    golds = spark.createDataFrame([(1, 10), (1, 11), (1, 99), (2, 5)], "query_id long, node_id long")
    targets = spark.createDataFrame([(1, [[1.0, 0.0], [1.0, 1.0]]), (2, [[1.0, 0.0], [0.0, 1.0]])], "query_id long, t array<array<double>>")
    rows = assignment.coverage_loss(scores, golds, targets, 2, 0.2).collect()
    cost = {k: [math.log(sum(math.exp(v[d]) for v in s.values())) - s[k][d] for d in (0, 1)] for k in s}
    want = min(cost[10][0] + cost[11][1], cost[10][1] + cost[11][0]) / 2
    assert [r["query_id"] for r in rows] == [1] and rows[0]["golds"] == 2
    assert rows[0]["assignment"] == pytest.approx(want) and rows[0]["diversity"] == pytest.approx((math.sqrt(0.5) - 0.2) ** 2)


def plain_search(links, start, hops):
    seen, front = {start: 0}, {start}
    for h in range(1, hops + 1):
        front = {d for s, d in links if s in front} - set(seen)
        seen |= dict.fromkeys(front, h)
    return seen


def test_bit_search(spark):
    """More than 64 starts, two queries, own and shared links, loops and repeated edges."""
    rng = random.Random(9)
    links = [(rng.randrange(150), rng.randrange(150)) for _ in range(260)] + [(3, 3), (1, 2), (1, 2)]
    pool = {1: rng.sample(range(150), 130), 2: rng.sample(range(150), 5)}
    inner = {q: [e for e in links if e[0] in p and e[1] in p and (e[0] + e[1]) % 3] for q, p in pool.items()}
    nodes = spark.createDataFrame([(q, n) for q, p in pool.items() for n in p], "query_id long, node_id long")
    starts = bitsearch.numbered_starts(nodes).cache()
    wide = bitsearch.search(starts, spark.createDataFrame(links, "src long, dst long"), 3)
    narrow = bitsearch.search(starts, spark.createDataFrame([(q, *e) for q, es in inner.items() for e in es], "query_id long, src long, dst long"), 3)
    place = {(r["query_id"], r["word"], r["bits"] & (1 << 64) - 1): r["node_id"] for r in starts.collect()}
    got = defaultdict(dict)
    for r in wide.collect():
        for b in range(64):
            if r["bits"] >> b & 1:
                got[r["query_id"], place[r["query_id"], r["word"], 1 << b]][r["node_id"]] = r["hop"]
    want = {(q, s): plain_search(links, s, 3) for q, p in pool.items() for s in p}
    assert got == want
    report = {r["query_id"]: r for r in bitsearch.preservation(wide, narrow, nodes, 3).collect()}
    for q, p in pool.items():
        both = []
        for s in p:
            near = plain_search(inner[q], s, 3)
            both += [(h, near.get(n)) for n, h in want[q, s].items() if h and n in p]
        if not both:
            assert q not in report
            continue
        r = report[q]
        for h in (1, 2, 3):
            able = [x for x in both if x[0] <= h]
            kept = sum(x[1] is not None and x[1] <= h for x in able)
            assert r[f"eligible_{h}"] == len(able) and r[f"preserved_{h}"] == pytest.approx(kept / len(able), abs=1e-6) and r[f"bridge_loss_{h}"] == pytest.approx(1 - kept / len(able), abs=2e-6)
        joint = [x for x in both if x[1] is not None]
        assert r["inflated"] == pytest.approx(sum(b > a for a, b in joint) / len(joint), abs=1e-6) and r["mean_inflation"] == pytest.approx(sum(b - a for a, b in joint) / len(joint), abs=1e-6)


def test_reach_sizes(spark):
    """Sketches are near the exact numbers; a node without links reaches none."""
    rng = random.Random(3)
    links = [(rng.randrange(600), rng.randrange(600)) for _ in range(2400)]
    nodes = spark.createDataFrame([(i,) for i in range(605)], "node_id long")
    got = {(r["node_id"], r["hop"]): r["reached"] for r in bitsearch.reach_sizes(nodes, spark.createDataFrame(links, "src long, dst long"), 3).collect()}
    assert len(got) == 605 * 3 and got[604, 3] == 0
    out = defaultdict(set)
    for s, d in links:
        out[s].add(d)
    for i in range(0, 600, 20):
        seen = {i}
        for h in (1, 2, 3):
            seen |= {d for s in seen for d in out[s]}
            assert abs(got[i, h] - (len(seen) - 1)) <= max(1, 0.06 * len(seen))


def test_links(spark):
    """Case, sentence starts, common words, last words, own titles, several owners and ambiguity."""
    titles = [(1, "Paris (city)"), (2, "Anna Berg"), (3, "Carl Berg"), (4, "stone"), (5, "Rome, Italy"), (6, "Anna Berg"), (7, "Xy"), (8, "Berg")]
    titles += [(100 + i, f"Name{i} Smith") for i in range(60)]
    texts = [
        (20, "We saw Paris. paris is fine, and Rome, Italy too; not Romer."), (21, "Here Anna Berg met someone."), (2, "I am Anna Berg, and Anna Berg is me."), (8, "Berg is here, a Berg."),
        (22, "a stone, a stone and Stone: Stone"), (23, "The \"anna Berg\" case; ANNA BERG not."), (24, "Mr Smith came"), (25, None), (26, ""), (27, "Berg Carl Berg"), (28, "at Paris (city) now, Xy"),
    ]
    vec = {i: [1.0, 0.0] for i, _ in titles} | {i: [1.0, 0.1] for i, _ in texts} | {3: [0.0, 1.0], 21: [0.0, 1.0], 27: [0.1, 1.0], 8: [0.6, 0.8]}
    got = {}
    for r in linking.link(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(titles, "doc_id long, title string"), spark.createDataFrame(list(vec.items()), "doc_id long, vec array<double>")).collect():
        assert (r["doc_id"], r["surface"]) not in got
        got[r["doc_id"], r["surface"]] = (r["title"], r["owners"], r["first_owner"])
    paris, rome, anna, carl = ("Paris (city)", 1, 1), ("Rome, Italy", 1, 5), ("Anna Berg", 2, 2), ("Carl Berg", 1, 3)
    berg = ("Berg", 1, 8)
    assert got == {
        (20, "Paris"): paris, (20, "Rome, Italy"): rome, (20, "Rome"): rome, (20, "Italy"): rome, (21, "Anna Berg"): anna, (21, "Berg"): berg, (2, "Anna Berg"): ("Anna Berg", 1, 2), (2, "Berg"): berg,
        # In its own text "Berg" stands for the last words of others, the nearest of which is taken.
        (8, "Berg"): carl, (23, "Anna Berg"): anna, (23, "Berg"): berg, (27, "Carl Berg"): carl, (27, "Berg"): berg, (28, "Paris"): paris, (28, "Paris (city"): paris,
    }


def test_runs_are_counted_before_they_meet_names(spark):
    """Counts of names as by way of their occurrences; only counted runs are shuffled, not places with their words."""
    rng = random.Random(6)
    some = ["Anna", "anna", "Berg,", "berg", "(Rome", "rome.", "and", "--", "x"]
    texts = spark.createDataFrame([(i, " ".join(rng.choice(some) for _ in range(30))) for i in range(40)] + [(99, None)], "doc_id long, text string")
    names = linking.surfaces(spark.createDataFrame([("Anna Berg",), ("Rome",), ("berg",)], "title string")).cache()
    found = {tuple(r) for r in linking.common_names(linking.occurrences(texts, names, 2)).collect()}
    got = linking.capitals(texts, names, 2)
    assert {tuple(r) for r in got.collect()} == found and len(found) == 3
    plan = linking.runs(texts, names, 2)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan


def test_first_words(spark):
    """The first words are those of the whole text; what follows is not taken apart."""
    texts = spark.createDataFrame([(t,) for t in ("a", " a", "a b", "\t a  b c d ", "a b c", "", "  ", "a\nb\nc d")], "text string")
    rows = texts.select(F.slice(linking.words("text"), 1, 2).alias("whole"), linking.words("text", 2).alias("first")).collect()
    assert all(r["whole"] == r["first"] for r in rows) and rows[3]["first"] == ["a", "b"]


def test_title_mentions_of_repeated_rows(spark, tmp_path):
    """Each row of documents counts once, also where an id repeats; formerly rows of one id multiplied."""
    from graphloom.plans.search_queries import QUERIES

    spark.createDataFrame([(1, "Anna Berg. More"), (2, "Anna"), (3, "...")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = [(1, "anna berg, Anna Berg"), (1, "So ANNA-berg"), (2, "Annas Berg"), (3, None), (4, "anna")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {tuple(r) for r in QUERIES["title_mention_join"](spark, str(tmp_path)).collect()} == {(1, 2), (2, 3)}


def test_queries_return_rows(spark):
    """The queries without SQL over the smallest tables, and the descent's recall there."""
    from graphloom.plans.search_queries import QUERIES

    at = "/root/testdata/sf0.001"
    assert QUERIES["reach_sizes"](spark, at).count() == 500 * 3 * 3
    found = QUERIES["knn_descent"](spark, at)
    x = np.array([r["embedding"] for r in spark.read.parquet(f"{at}/embeddings.parquet").orderBy("vec_id").collect()])
    best = np.argsort(-cosines(x), axis=1, kind="stable")[:, :5]
    assert knn.recall(found, spark.createDataFrame([(i, int(j)) for i, r in enumerate(best) for j in r], "node_id long, nbr long")) >= 0.9


def test_words_are_stripped_by_text(spark):
    """Odd ends of words, as before, but no pattern is looked for at each word that may begin a name."""
    import re

    text = '"Alpha" (beta)gamma -- x- Über. delta: été, ... end\u0085 a-b- 中。 beta?'
    names = ["alpha", "beta)gamma", "x", "über", "delta", "été", "end", "a-b", "中", "beta", "delta: été", "x- über", "alpha x"]
    texts = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, " -- ")], "doc_id long, text string")
    found = linking.runs(texts, spark.createDataFrame([(n, n, 0) for n in names], "surface string, title string, kind int"), 2)
    bare = lambda s: re.sub(r"^[\W_]+|[\W_]+$", "", s)
    words, lengths = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x], {}
    for n in names:
        lengths.setdefault(bare(n.split(" ")[0]), set()).add(len(n.split(" ")))
    want = []
    for i, word in enumerate(words):
        lead = re.match(r"[\W_]*", word)[0]
        before = lead[-1:] or (words[i - 1][-1] if i else "")
        for n in lengths.get(bare(word).lower(), ()):
            if i + n <= len(words) and bare(words[i + n - 1]):
                written = bare(" ".join(words[i : i + n]))
                want.append((1, written.lower(), written, before in ("", *linking.SENTENCE_END)))
    assert sorted(tuple(r) for r in found.collect()) == sorted(want) and len(want) > 12
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    above = [i for i, line in enumerate(plan) if "posexplode" in line][0] - 1
    assert "Project" in plan[above] and "regexp" not in plan[above]
