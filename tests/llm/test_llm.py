"""The training-data operators against brute force on small fixtures: nulls, empty and long texts, ties, repeated rows,
empty tables, clashing extra columns."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphloom.llm import exact_dedup, language, license_scan, line_dedup, mixing, near_dedup, packing, quality, suffix_dedup, toxicity

DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    base = [words(rng, rng.randint(20, 300)) for _ in range(30)]
    out = dict(enumerate(base))
    for i in range(12):  # near copies: a few words changed
        w = base[i].split()
        for _ in range(1 + i % 3):
            w[rng.randrange(len(w))] = "changed" + str(i)
        out[100 + i] = " ".join(w)
    for i in range(8):
        out[200 + i] = base[i]
    passage = words(rng, 60)
    for i in range(6):
        out[300 + i] = words(rng, 30) + "\n" + passage + "\n" + words(rng, 10)
    out |= {400: None, 401: "", 402: "", 403: " \n\t ", 404: "one two", 405: "One TWO", 406: "été   naïve ÉTÉ", 407: base[0] * 40, 408: "ab " * 200, 409: None}
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rng = random.Random(4)
    rows = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["s0", "s0", "s1", None]), len(t or "")) for i, t in texts.items()]
    return spark.createDataFrame(rows, DOC).repartition(5).cache()


def clashing(df):
    """Extra columns with names that the operators use inside."""
    return df.withColumns({c: F.lit("x") for c in ("rep", "row_id", "bucket", "band", "_salt", "_key", "run", "tokens", "domain", "kept")})


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_exact(spark, docs, texts):
    for keep, best in (("max", max), ("min", min)):
        got = by_id(exact_dedup.exact_dedup(clashing(docs), keep=keep))
        groups = defaultdict(list)
        for i, t in texts.items():
            groups[t or ""].append(i)
        assert len(got) == len(texts)
        for t, ids in groups.items():
            for i in ids:
                r = got[i]
                assert (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) == (best(ids), len(ids), i == best(ids), hashlib.sha256(t.encode()).hexdigest())
    kept = exact_dedup.drop_exact(docs.unionByName(docs.limit(7)))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(max(v) for v in groups.values()) and kept.columns == docs.columns


@pytest.mark.parametrize("parts", [2, 40, 10_000])
def test_exact_pieces(spark, parts):
    """A text on half of the rows, dealt over pieces or not; its groups are the same."""
    rng = random.Random(21)
    rows = [(i, "the same text" if i % 2 else rng.choice("abc") * rng.randint(0, 3)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    groups = defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    got = by_id(exact_dedup.exact_dedup(df, parts=parts))
    assert {i: (max(groups[t]), len(groups[t]), i == max(groups[t])) for i, t in rows} == {i: (r["keep_id"], r["group_size"], r["kept"]) for i, r in got.items()}


def test_exact_repeats_and_nulls(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (None, "b")], "doc_id long, text string")
    got = exact_dedup.exact_dedup(df).collect()
    assert sum(r["kept"] for r in got) == 2 and {r["group_size"] for r in got} == {3, 1}


def brute_shingles(t):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_near(spark, docs, texts):
    got = by_id(near_dedup.near_duplicates(clashing(docs)))
    sets = {i: brute_shingles(t) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in texts:
        for j in texts:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert {i: (len(sets[i]), find(i), find(i) == i) for i in texts} == {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in got.items()}
    kept = near_dedup.keep_one(docs)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i in texts if find(i) == i) and kept.columns == docs.columns


def test_near_chain(spark):
    """A chain a - b - c where a and c are not linked, in one bucket with a hub that links to neither end."""
    rng = random.Random(9)
    w = words(rng, 200).split()
    chain = [" ".join([*w[:i], *(f"x{i}" for i in range(i)), *w[i:][: 200 - i]]) for i in range(0, 60, 12)]
    df = spark.createDataFrame(list(enumerate(chain)), "doc_id long, text string")
    got = by_id(near_dedup.near_duplicates(df))
    sets = [brute_shingles(t) for t in chain]
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    assert [got[i]["component_id"] for i in range(len(chain))] == root


def test_near_across(spark):
    """Many documents of one bucket in different components, of mixed sizes: blocks and classes find each pair once."""
    rng = random.Random(30)
    rows = [(i, rng.randint(20, 60), 1, i % 7, [1, rng.randint(2, 4)]) for i in range(300)]
    rest = spark.createDataFrame([(1, i, n, n, root, b) for i, n, _, root, b in rows], "band long, rep long, n long, c long, root long, bands array<long>")
    got = [frozenset((r["a"], r["b"])) for r in near_dedup.across(rest, 85, block=8).collect()]
    near = lambda a, b: 85 * max(a, b) <= 100 * min(a, b) and min(a, b) * 185 >= 85 * (a + b)
    want = {frozenset((x[0], y[0])) for x in rows for y in rows if x[0] < y[0] and x[3] != y[3] and near(x[1], y[1])}
    assert len(got) == len(set(got)) and set(got) == want


def test_components_long_chain(spark):
    """A path of 500 nodes in random order, and a short one apart."""
    order = list(range(500))
    random.Random(1).shuffle(order)
    links = [*zip(order, order[1:], strict=False), (900, 901), (902, 901)]
    got = near_dedup.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert sorted(map(tuple, got)) == [*((i, 0) for i in range(500)), (900, 900), (901, 900), (902, 900)]


def brute_repeats(texts, span):
    seen, out = set(), {}
    for i in sorted(texts):
        raw = (texts[i] or "").encode()
        mark = np.zeros(len(raw), bool)
        for a in range(len(raw) - span + 1):
            piece = raw[a : a + span]
            if piece in seen:
                mark[a : a + span] = True
            seen.add(piece)
        edge = np.diff(np.concatenate(([0], mark.astype(int))))
        out[i] = (len(raw), int(mark.sum()), int((edge == 1).sum()), hashlib.sha256(bytes(np.frombuffer(raw, np.uint8)[~mark])).hexdigest())
    return out


def test_suffix(spark, docs, texts):
    got = by_id(suffix_dedup.remove_repeats(clashing(docs), buckets=3))
    assert {i: (r["n_bytes"], r["n_removed"], len(r["spans"]), r["kept_sha256"]) for i, r in got.items()} == brute_repeats(texts, 100)


def test_suffix_stretches(spark, docs, texts):
    """Texts in stretches far shorter than they are, whose borders cut runs."""
    some = {i: t for i, t in texts.items() if i not in (408,)}
    got = by_id(suffix_dedup.remove_repeats(docs.where("doc_id <> 408"), buckets=3, stretch=150))
    assert {i: (r["n_bytes"], r["n_removed"], len(r["spans"]), r["kept_sha256"]) for i, r in got.items()} == brute_repeats(some, 100)


def test_suffix_long_text(spark):
    """A text of 20 MB that holds one passage twice, beside a short copy of it."""
    rng = np.random.default_rng(5)
    raw = bytearray(rng.integers(97, 123, 20_000_000).astype(np.uint8).tobytes())
    raw[15_000_000:15_000_300] = raw[1000:1300]
    texts = [(7, raw.decode()), (8, "x" * 50 + raw[1100:1300].decode())]
    got = by_id(suffix_dedup.remove_repeats(spark.createDataFrame(texts, "doc_id long, text string")))
    spans = [(s["start"], s["stop"]) for s in got[7]["spans"]]
    assert len(spans) == 1 and spans[0][0] <= 15_000_000 and spans[0][1] >= 15_000_300 and got[7]["n_removed"] < 310 and got[8]["n_removed"] in range(200, 205)


def test_suffix_repeated_rows(spark):
    """Rows given twice and three times, different texts under one identifier, a short and an empty repeat."""
    rng = random.Random(12)
    a, b, c, d = (words(rng, 60) for _ in range(4))
    rows = [(1, a), (1, a), (2, b + c), (2, d + b), (2, d + b), (2, None), (3, c), (3, c), (3, c), (4, a + d), (5, "short"), (5, "short"), (6, a), (None, a), (None, a)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    order = {r["text"]: r["h"] for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
    ordered = sorted((r for r in rows if r[0]), key=lambda r: (r[0], order[r[1]]))
    want = Counter((ordered[i][0], *v) for i, v in brute_repeats(dict(enumerate(t for _, t in ordered)), 100).items())
    want[None, len(a), 0, 0, hashlib.sha256(a.encode()).hexdigest()] = 2
    got = suffix_dedup.remove_repeats(df, buckets=3).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), r["kept_sha256"]) for r in got) == want
    assert sorted(r["n_removed"] for r in got if r["doc_id"] == 1) == [0, len(a)]


def test_suffix_zero_bytes(spark):
    texts = {1: "a\0" * 120, 2: "\0" * 99, 3: "\0" * 250, 4: "b" + "\0" * 150 + "c"}
    got = by_id(suffix_dedup.remove_repeats(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), buckets=2))
    assert {i: (r["n_bytes"], r["n_removed"], len(r["spans"]), r["kept_sha256"]) for i, r in got.items()} == brute_repeats(texts, 100)


def test_suffix_periodic(spark):
    """Texts of one letter and of a short period, of 3 MB and several stretches: settled runs are joined, not one a byte."""
    texts = {1: "a" * 3_000_000, 2: "ab" * 100_000, 3: "b" + "a" * 150}
    want = {1: (3_000_000, 2_999_999, 1), 2: (200_000, 199_998, 1), 3: (151, 150, 1)}
    got = by_id(suffix_dedup.remove_repeats(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), buckets=3))
    assert {i: (r["n_bytes"], r["n_removed"], len(r["spans"])) for i, r in got.items()} == want
    first = suffix_dedup.first_pass(100, 3)(iter([pa.RecordBatch.from_pydict({"doc_id": [1], "text": [texts[1][:1_000_000]], "base": [0]})]))
    assert sum(len(suffix_dedup.expand(b)) for part in first for b in part.column(3).to_pylist()) < 10


def test_levels_any_order():
    rng = np.random.default_rng(1)
    index, all_ = suffix_dedup.Levels(), []
    for batch in rng.permutation(9):
        text = rng.integers(97, 100, (20, 3)).astype(np.uint8)
        place = np.array([(batch, i) for i in range(20)], suffix_dedup.PLACE)
        index.add(np.hstack((text, np.ones((20, 1), np.uint8))).view("S4").ravel(), place)
        all_ += [(bytes(t), int(batch), i) for i, t in enumerate(text)]
    first = {}
    for t, d, s in sorted(all_, key=lambda x: x[1:]):
        first.setdefault(t, (d, s))
    later = {(d, s) for t, d, s in all_ if first[t] != (d, s)}
    assert {tuple(x) for x in np.concatenate(index.later).tolist()} == later
    sizes = [len(t) for t, _ in index.levels]
    assert all(a > 2 * b for a, b in zip(sizes, sizes[1:], strict=False))


def test_packing(spark, docs, texts):
    from tokenizers import Tokenizer

    P = pytest.importorskip("public_tokenizers")
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    pieces = packing.pack(clashing(docs), length=256).collect()
    at = defaultdict(list)
    for p in pieces:
        at[p["doc_id"]].append(p)
    for i, t in texts.items():
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        ps = sorted(at[i], key=lambda p: p["start"])
        assert b"".join(p["ids"] for p in ps) == ids.tobytes() and all(p["doc_tokens"] == len(ids) and p["length"] * 4 == len(p["ids"]) for p in ps)
    fill = defaultdict(list)
    for p in pieces:
        fill[p["sequence_id"]].append((p["offset"], p["length"]))
    full = [sum(n for _, n in v) for v in fill.values()]
    assert sorted(fill) == list(range(len(fill))) and sum(n < 256 for n in full) <= 1 and max(full) <= 256
    for v in fill.values():
        v.sort()
        assert [a for a, _ in v] == [0, *np.cumsum([n for _, n in v])[:-1]]


def test_encoder_special_token():
    from tokenizers import Tokenizer

    P = pytest.importorskip("public_tokenizers")
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for t in ("a <|endoftext|> b", "x  y\n\n z", "naïve ÉTÉ 123", "   ", "'s 'S don't"):
        assert packing.public_encoder()()(t).tolist() == [*tok.encode(t, add_special_tokens=False).ids, 1]


def test_encoder_long_runs():
    """What the fast encoder's pattern cannot take goes to the tokenizer, with the same ids."""
    encode = packing.public_encoder()()
    for text in (" " * 1_000_000, "\n" * 1_000_000, "a" * 1_000_000):
        assert encode(text).tolist() == [*encode.slowly(text), 1]


def test_packing_order(spark, docs):
    """Along the curve sequences follow the key, ties the identifier, whatever the partitions."""
    pytest.importorskip("public_tokenizers")
    some = docs.where("doc_id < 310 or doc_id in (401, 402)")
    key = {r["doc_id"]: r["curve"] for r in packing.tokenized(some, packing.public_encoder(), 3, 12, 256, 17).collect()}
    place = lambda df: [r["doc_id"] for r in sorted(packing.pack(df, length=256).where("start = 0").collect(), key=lambda r: (r["sequence_id"], r["offset"]))]
    assert place(some.repartition(3)) == place(some.repartition(7)) == sorted(key, key=lambda i: (key[i], i))


@pytest.mark.parametrize(("dims", "bits"), [(2, 4), (3, 3)])
def test_hilbert(dims, bits):
    """A bijection whose successive points are neighbours."""
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    key = packing.hilbert_key(cells, bits)
    assert sorted(key) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(axis=1) == 1).all()


def test_quality(spark, docs, texts):
    got = by_id(quality.quality(clashing(docs)))
    for i, t in texts.items():
        t = t or ""
        w = WORD.findall(t)
        grams = Counter(zip(w, w[1:], w[2:], strict=False))
        hit = {k for j in range(len(w) - 2) if grams[tuple(w[j : j + 3])] > 1 for k in range(j, j + 3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit))
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (len(w) < 50 or 100 * len(hit) > 50 * len(w)) and not (r["base_failed"] and r["kept"])
    assert got[0]["kept"] and not got[408]["kept"]


def test_quality_bands(spark):
    rng = random.Random(2)
    noise = " ".join("".join(chr(rng.randrange(33, 127)) for _ in range(8)) for _ in range(500))
    dull = " ".join(f"w{i % 90}x{i % 89}" for i in range(9)) + " " + " ".join(["tick " + str(i) for i in range(60)])
    got = by_id(quality.quality(spark.createDataFrame([(1, noise), (2, words(rng, 400)), (3, dull)], "doc_id long, text string")))
    assert not got[1]["kept"] and got[2]["kept"]


def brute_mix(rows, share, weights, epochs, seed):
    """Documents (id, domain, lang, source, tokens): copies by a loop over the tree."""
    leaves = defaultdict(int)
    for _, d, l, s, n in rows:
        leaves[d, l, s] += n

    def split(total, kids):  # kids: name -> (cap, weight)
        left, out, open_ = total, {}, dict(kids)
        while open_:
            level = left / sum(w for _, w in open_.values())
            full = [k for k, (c, w) in open_.items() if c <= level * w]
            if not full:
                return out | {k: level * w for k, (_, w) in open_.items()}
            for k in full:
                out[k] = open_.pop(k)[0]
                left -= out[k]
        return out

    w = lambda level, k: weights.get(level, {}).get(k, 1.0)
    cap = lambda *key: epochs * sum(n for k, n in leaves.items() if k[: len(key)] == key)
    budget = {}
    for d, b1 in split(share * sum(leaves.values()), {d: (cap(d), w("domain", d)) for d in {k[0] for k in leaves}}).items():
        for l, b2 in split(b1, {l: (cap(d, l), w("lang", l)) for l in {k[1] for k in leaves if k[0] == d}}).items():
            for s, b3 in split(b2, {s: (cap(d, l, s), w("source", s)) for s in {k[2] for k in leaves if k[:2] == (d, l)}}).items():
                budget[d, l, s] = int(b3 + 1e-6)
    out = {}
    for leaf, b in budget.items():
        n = leaves[leaf]
        whole = min(epochs, b // n) if n else 0
        left = b - whole * n
        key = lambda i: hashlib.md5("|".join([seed, str(whole), *([] if i is None else [str(i)])]).encode()).hexdigest()  # noqa: E731, B023
        for i, t in sorted(((r[0], r[4]) for r in rows if r[1:4] == leaf), key=lambda x: key(x[0])):
            left -= t
            out[i] = (whole + (whole < epochs and left >= 0), b)
    return out


@pytest.mark.parametrize(("share", "epochs"), [(0.5, 1), (0.9, 2), (1.7, 2), (3.0, 2), (0.0, 1)])
def test_mixing(spark, docs, texts, share, epochs):
    weights = {"domain": {"domain1": 5.0}, "lang": {"en": 3.0}, "source": {"s0": 2.0}}
    rows = [(r["doc_id"], "domain" + str(int(hashlib.md5(r["source"].encode()).hexdigest()[:8], 16) % 4) if r["source"] else "", r["lang"] or "", r["source"] or "", len(WORD.findall(r["text"] or ""))) for r in docs.collect()]
    got = by_id(mixing.mix(clashing(docs), share=share, weights=weights, epochs=epochs, seed="t", slice_rows=7))
    assert {i: (r["copies"], r["leaf_budget"]) for i, r in got.items()} == brute_mix(rows, share, weights, epochs, "t")


def test_mix_rows(spark, docs):
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(docs, share=1.6, epochs=2).collect()}
    got = Counter(r["doc_id"] for r in mixing.mix_rows(docs, share=1.6, epochs=2).collect())
    assert got == {i: c for i, c in copies.items() if c}


def test_language(spark):
    rng = random.Random(7)
    say = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(n))
    rows = [(i, say("abcdefg", 40), "x") if i % 2 else (i, say("mnopé", 40), "y") for i in range(400)]
    df = spark.createDataFrame([*rows, (900, None, "x"), (901, "", "y"), (902, "12 34 !", "x"), (903, "abc " * 5000, None)], "doc_id long, text string, lang string")
    net = language.train(language.training_windows(df), steps=60, batch=64)
    got = by_id(language.identify(clashing(df), net))
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(got[i]["lang_pred"] == ("x" if i % 2 else "y") for i in held) >= 0.98 * len(held)
    assert [got[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3 and got[903]["lang_pred"] == "x"
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_language_plain(spark):
    """identify against loops over windows, positions and units; no window reads its padding."""
    net = language.fresh(["a", "b", "c"], 3, np.random.default_rng(2))
    p, H = net.p, 3
    soft = lambda v: v / (1 + np.abs(v))

    def run(raw, d):
        h, out = np.zeros(H), []
        for byte in raw if d == 0 else raw[::-1]:
            a = p[f"embed{d}"][:, byte]
            g = 0.5 + 0.5 * soft(a[: 2 * H] + p[f"zr{d}"] @ h)
            c = soft(a[2 * H :] + p[f"cand{d}"] @ (g[H:] * h))
            h = h + g[:H] * (c - h)
            out.append(h)
        return out if d == 0 else out[::-1]

    rng = random.Random(3)
    texts = {i: "".join(rng.choice("abc é\n") for _ in range(n)) + "x" for i, n in enumerate((0, 1, 18, 95, 96, 97, 127, 128, 129, 500))}
    got = by_id(language.identify(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), net))
    for i, t in texts.items():
        raw, total = t.encode(), np.zeros(3)
        for at in range(0, len(raw), 96):
            lo = max(at - 16, 0)
            window = raw[lo : at + 112]
            for k, (f, b) in enumerate(zip(run(window, 0), run(window, 1), strict=True)):
                if at <= lo + k < at + 96:
                    e = np.exp(p["out"] @ np.concatenate((f, b)) + p["bias"][:, 0])
                    total += e / e.sum()
        assert got[i]["lang_pred"] == net.langs[int(total.argmax())] and got[i]["score"] == pytest.approx(total.max() / len(raw), abs=1e-4)


def test_language_gradient():
    """Backpropagation through time against finite differences."""
    rng = np.random.default_rng(0)
    net = language.fresh(["a", "b", "c"], 3, rng)
    p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x = rng.integers(0, 256, (6, 4)).astype(np.uint8)
    mask, y, weight = (np.arange(6)[:, None] < np.array([6, 3, 5, 1])).astype(float), np.array([0, 1, 2, 1]), np.ones(4)
    p = {k: v.astype(np.float32) for k, v in p.items()}
    _, g = language.gradients(p, x, mask, y, weight)
    for k in p:
        i = np.unravel_index(np.argmax(np.abs(g[k])), g[k].shape)
        ends = []
        for d in (1e-2, -1e-2):
            q = {n: v.copy() for n, v in p.items()}
            q[k][i] += d
            ends.append(language.gradients(q, x, mask, y, weight)[0])
        assert abs((ends[0] - ends[1]) / 2e-2 - g[k][i]) < 0.05 * abs(g[k][i]) + 1e-4, k


def test_segments():
    """All maximal scoring segments by their definition: no part of a maximal one scores more, none can be extended."""
    rng = random.Random(5)
    for _ in range(300):
        n = rng.randint(0, 12)
        score = [rng.choice([2.0, 3.5, None, None, None]) for _ in range(n)]
        flat = [-1.0 if s is None else s for s in score]

        def brute(a, b):
            best = max(((sum(flat[i:j]), -(j - i), -i, i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0, 0, 0, a, a))
            if best[0] <= 0:
                return []
            _, _, _, i, j = best
            return [*brute(a, i), (i, j - 1, sum(flat[i:j])), *brute(j, b)]

        got = toxicity.segments(flat)
        assert sum(s for *_, s in got) == pytest.approx(sum(s for *_, s in brute(0, n)))
        assert max((s for *_, s in got), default=0) == max((s for *_, s in brute(0, n)), default=0)


def test_segments_equal_plain():
    """The same segments as a scan that looks at every earlier entry."""

    def plain(found):
        stack, total = [], 0.0
        for i, score in enumerate(found):
            total += score
            if score <= 0:
                continue
            piece = (i, i, total - score, total)
            while True:
                lower = [j for j in range(len(stack)) if stack[j][2] < piece[2]]
                if not lower or stack[lower[-1]][3] >= piece[3]:
                    break
                piece = (stack[lower[-1]][0], i, stack[lower[-1]][2], piece[3])
                del stack[lower[-1] :]
            stack.append(piece)
        return [(a, b, y - x) for a, b, x, y in stack]

    rng = random.Random(8)
    for _ in range(500):
        found = [rng.choice([1.0, 2.0, 0.5, -1.0, -2.0, -3.0]) for _ in range(rng.randint(0, 50))]
        assert toxicity.segments(found) == plain(found)


@pytest.mark.parametrize("unit", [[1.0, -2.0], [2.0, -1.0], [1.0, -1.0]])
def test_segments_linear(unit):
    began = time.process_time()
    toxicity.segments(unit * 200_000)
    assert time.process_time() - began < 5


def test_toxicity(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(400):
        w = words(rng, rng.randint(30, 120)).split()
        bad = i % 4 == 0
        if bad:
            at = rng.randrange(len(w) - 10)
            for j in range(3):
                w[at + 2 * j] = rng.choice(["vile", "awful", "nasty"])
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    docs = spark.createDataFrame([*rows, (900, None), (901, ""), (902, "vile " * 3000)], "doc_id long, text string")
    labels = spark.createDataFrame([*labels, (0, 1, 1), (None, 1, 1), (5000, 1, 1), (7, 1, None)], "doc_id long, quality int, toxic int")
    m = toxicity.fit(toxicity.training_rows(clashing(docs), labels))
    got = by_id(toxicity.score_toxicity(clashing(docs), m))
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(got[i]["predicted"] == (i % 4 == 0) for i in held) >= 0.97 * len(held)
    assert got[902]["predicted"] == 1 and got[900]["predicted"] == got[901]["predicted"] == 0 and got[0]["passages"]
    left = toxicity.drop_toxic(docs, m)
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(i for i, r in got.items() if not r["predicted"]) and left.columns == docs.columns


def test_toxicity_scores(spark):
    """Log-odds, drift, the law's scale and K, and scores, against plain loops over the same sample."""
    import math

    rng = random.Random(18)
    rows = []
    for i in range(120):
        w = words(rng, rng.randint(5, 40)).split()
        if i % 3 == 0:
            w[rng.randrange(len(w))] = "vile"
        rows.append((" ".join(w), int(i % 3 == 0)))
    m = toxicity.fit(spark.createDataFrame([*rows, (None, 0), ("no label", None)], "text string, toxic int"))
    rows.append(("", 0))
    count = {0: Counter(), 1: Counter()}
    for t, y in rows:
        count[y].update(set(re.findall(r"\w+", t.lower())))
    vocabulary = count[0].keys() | count[1].keys()
    n0, n1 = sum(count[0].values()), sum(count[1].values())
    odds = {}
    for w in vocabulary:
        own = (count[0][w] + count[1][w]) * 500 / (n0 + n1) + 0.5
        b, c, every = count[1][w] + own, count[0][w] + own, 500 + 0.5 * len(vocabulary)
        x = math.log(b / (n1 + every - b)) - math.log(c / (n0 + every - c))
        odds[w] = x * max(1 - (2.5 * math.sqrt(1 / b + 1 / c) / x) ** 2, 0) if x else 0.0
    p0, p1 = ((sum(count[y][w] for w in vocabulary if odds[w] > 0) + 0.5) / (n + 1) for y, n in ((0, n0), (1, n1)))
    rest = min(math.log((1 - p1) / (1 - p0)), -1e-3)
    assert m.rest == pytest.approx(rest) and m.odds == pytest.approx({w: x + rest for w, x in odds.items() if x})
    expected = sum((count[0][w] + 0.5) / (n0 + 0.5 * len(vocabulary)) * math.exp(m.scale * (odds[w] + rest)) for w in vocabulary)
    assert expected == pytest.approx(1, abs=1e-6) or m.scale > 9.99
    pieces = [s for t, y in rows if not y for *_, s in toxicity.segments(toxicity.scores(t, m))]
    tokens = sum(len(re.findall(r"\w+", t)) for t, y in rows if not y)
    assert m.k == pytest.approx((sum(s >= 2 / m.scale for s in pieces) + 0.5) / (tokens * math.exp(-2)))
    got = toxicity.score_toxicity(spark.createDataFrame(list(enumerate(t for t, _ in rows)), "doc_id long, text string"), m)
    for r in got.collect():
        flat = [odds.get(w, 0.0) + rest for w in re.findall(r"\w+", rows[r["doc_id"]][0].lower())]
        found = [m.scale * s - math.log(m.k * max(len(flat), 1)) for *_, s in toxicity.segments(flat)]
        sure = [e for e in found if e >= -math.log(0.05)]
        x = sum(sure) if sure else max(found, default=-math.log(m.k * max(len(flat), 1)))
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-max(min(m.bias + m.slope * min(max(x, -20), 60), 30), -30))))


def test_toxicity_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    m = toxicity.fit(toxicity.training_rows(docs, none))
    assert toxicity.score_toxicity(docs, m).where("score between 0 and 1").count() == docs.count()


@pytest.mark.parametrize("toxic", [None, 1, 0])
def test_drop_toxic_without_both_classes(spark, docs, toxic):
    labels = spark.createDataFrame([(i, 1, toxic) for i in range(30)] if toxic is not None else [], "doc_id long, quality int, toxic int")
    m = toxicity.fit(toxicity.training_rows(docs, labels))
    assert toxicity.drop_toxic(docs, m).count() == docs.count()
    assert toxicity.score_toxicity(docs, m).where("predicted = 1").isEmpty()


def brute_licenses(texts):
    out = set()
    grams = lambda t: (lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)})(re.findall("[a-z0-9]+", (t or "").lower()))
    goal = {n: grams(t) for n, t in license_scan.TEMPLATES}
    for i, t in texts.items():
        own = grams(t)
        out |= {(i, n, len(g), len(g & own)) for n, g in goal.items() if 100 * len(g & own) >= 80 * len(g)}
    return out


def test_licenses(spark):
    rng = random.Random(6)
    notices = [t for _, t in license_scan.TEMPLATES]
    texts = {i: words(rng, rng.randint(0, 40)) + rng.choice([" ", "\n"]) + notices[i % len(notices)] + "." + words(rng, rng.randint(0, 30)) for i in range(80)}
    long = notices[6].split()
    texts |= {90: " ".join([*long[:-1], "other"]), 91: " ".join(long[:8]), 92: None, 93: "", 94: "under the MIT License", 95: words(rng, 500), 96: " ".join(notices) * 20}
    df = clashing(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    got = {tuple(r) for r in license_scan.scan(df).collect()}
    assert got == brute_licenses(texts)
    assert license_scan.scan(df.unionByName(df)).count() == len(got)


def test_license_edits(spark):
    """Every template with words changed, left out and put in at any places: no match of exact containment is missed."""
    rng = random.Random(16)
    texts = {}
    for n, (_, notice) in enumerate(license_scan.TEMPLATES):
        for turn in range(12):
            w = notice.split()
            for _ in range(turn % 4):
                at = rng.randrange(len(w))
                w[at : at + rng.randint(0, 1)] = ["edited"] * rng.randint(0, 1)
            texts[n * 100 + turn] = words(rng, rng.randint(0, 9)) + " " + " ".join(w) + " " + words(rng, rng.randint(0, 9))
    got = {tuple(r) for r in license_scan.scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == brute_licenses(texts)


def test_license_bounds():
    """The run that a text must hold, by laying out runs of at most `longest` with gaps of four, and the share of windows
    that collide."""
    for n in range(1, 60):
        least = -(-n * 80 // 100)
        most = lambda longest: max(min(longest * (gaps + 1), n - 4 * gaps) for gaps in range(n // 4 + 1))  # noqa: E731, B023
        assert license_scan.guaranteed_run(n, 80) == next(x for x in range(1, n + 1) if most(x) >= least)
    assert all(license_scan.guaranteed_run(n, 80) >= 8 for n in range(9, 500))
    rng = np.random.default_rng(3)
    hit, turns = 0, 4000
    for _ in range(turns):
        h = rng.random((3, 6))  # five shingles each, four in common
        hit += any(x[:5].min() == x[1:].min() and x[:5].max() == x[1:].max() for x in h)
    assert abs(hit / turns - license_scan.collision_probability(4 / 6)) < 0.05


def test_lines(spark):
    rng = random.Random(1)
    rows = []
    for i in range(60):
        host = ["Big.example.com", "small.example.org", "one.example.net"][0 if i < 40 else 1 if i < 58 else 2]
        body = "".join(f"<p>{words(rng, 4)}</p>" for _ in range(3))
        nav = "<ul><li>Home</li><li>About</li></ul>" if i % 2 else "<div> Home </div>"
        rows.append((i, f"http://{host}/{i}?x=1", f"<html>{nav}{body}<p>rare {i % 13}</p></html>"))
    rows += [(100, None, None), (101, "not a url", "<p>Home</p>"), (102, "http://big.example.com", ""), (5, rows[5][1], rows[5][2])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("_salt", F.lit(1)).withColumn("host", F.lit("z"))
    got = line_dedup.site_lines(pages, "page_id", line_dedup.host_of(F.col("url")), line_dedup.html_lines(F.col("html"))).collect()
    host = lambda u: (re.match(r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]*)", u or "") or [None, ""])[1].lower()
    lines = lambda h: [x.strip(" ") for x in re.sub("<[^>]*>", "\n", h or "").split("\n") if x.strip(" ")]
    pages_of, n = Counter(host(u) for _, u, _ in rows), Counter((host(u), x) for _, u, h in rows for x in set(lines(h)))
    want = Counter()
    for i, u, h in rows:
        keep = [x for x in lines(h) if not n[host(u), x] > 0.3 * pages_of[host(u)]]
        want[i, host(u), len(lines(h)), len(lines(h)) - len(keep), "\n".join(keep)] += 1
    assert Counter(tuple(r) for r in got) == want


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOC)
    assert exact_dedup.exact_dedup(none).count() == 0 and exact_dedup.drop_exact(none).count() == 0
    assert near_dedup.near_duplicates(none).count() == 0 and near_dedup.keep_one(none).count() == 0
    assert suffix_dedup.remove_repeats(none, buckets=2).count() == 0
    assert mixing.mix(none).count() == 0 and mixing.mix_rows(none).count() == 0
    assert quality.quality(none).count() == 0
    assert license_scan.scan(none).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert line_dedup.site_lines(pages, "page_id", line_dedup.host_of(F.col("url")), line_dedup.html_lines(F.col("html"))).count() == 0
    m = toxicity.fit(toxicity.training_rows(none, spark.createDataFrame([], "doc_id long, quality int, toxic int")))
    assert toxicity.score_toxicity(none, m).count() == 0 and toxicity.drop_toxic(none, m).count() == 0
    pytest.importorskip("public_tokenizers")
    assert packing.pack(none).count() == 0
    net = language.train(language.training_windows(none))
    assert language.identify(none, net).count() == 0


def test_repeated_rows_and_null_ids(spark):
    """Rows without identifier and rows given twice come out each."""
    rng = random.Random(20)
    rows = [(1, words(rng, 60)), (None, words(rng, 40)), (None, None), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s")})
    df = df.unionByName(df)
    m = toxicity.ToxicModel({"a": 1.0}, -0.1)
    net = language.fresh(["en", "fr"], 2, np.random.default_rng(0))
    for out in (quality.quality(df), near_dedup.near_duplicates(df), toxicity.score_toxicity(df, m), language.identify(df, net), mixing.mix(df), exact_dedup.exact_dedup(df), suffix_dedup.remove_repeats(df, buckets=2)):
        assert Counter(r["doc_id"] for r in out.collect()) == {1: 2, None: 4, 3: 2}
    notice = spark.createDataFrame([(None, license_scan.TEMPLATES[6][1])] * 2, "doc_id long, text string")
    assert [r["doc_id"] for r in license_scan.scan(notice).collect()] == [None]
    pages = spark.createDataFrame([(None, "http://a.b/", "<p>x</p>")] * 2, "page_id long, url string, html string")
    assert line_dedup.site_lines(pages, "page_id", line_dedup.host_of(F.col("url")), line_dedup.html_lines(F.col("html"))).count() == 2
    pytest.importorskip("public_tokenizers")
    assert sum(r["length"] for r in packing.pack(df).collect()) == sum(r["doc_tokens"] for r in packing.pack(df).where("start = 0").collect())


def test_quality_verdict(spark, docs, texts):
    """The verdict from ratios computed here."""
    import zstandard

    z = zstandard.ZstdCompressor(level=3)
    band = lambda n, size, bands: next(a <= size / n <= b for most, a, b in bands if n <= most)
    for i, r in by_id(quality.quality(docs)).items():
        raw = (texts[i] or "").encode()
        parts = [raw[k : k + 4096] for k in range(0, len(raw), 4096)]
        bad = sum(not band(len(p), len(z.compress(p)), quality.CHUNK_BANDS) for p in parts)
        good = bool(raw) and band(len(raw), len(z.compress(raw)), quality.WHOLE_BANDS) and 2 * bad <= len(parts)
        assert r["kept"] == (good and not r["base_failed"])


def test_null_ids(spark):
    df = spark.createDataFrame([(None, "some words that make a text here"), (None, None), (1, "some words that make a text here")], "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s")})
    assert near_dedup.near_duplicates(df).count() == 3
    assert suffix_dedup.remove_repeats(df, buckets=2).count() == 3
    assert mixing.mix(df).count() == 3 and quality.quality(df).count() == 3


def test_pipeline(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    m = toxicity.fit(toxicity.training_rows(docs, spark.read.parquet(f"{sf}/labels.parquet")))
    bad = {r["doc_id"] for r in toxicity.score_toxicity(docs, m).where("predicted = 1").collect()}
    rows = {r["doc_id"]: r for r in docs.collect() if r["doc_id"] not in bad}
    last = {}
    for i in sorted(rows):
        last[rows[i]["text"] or ""] = i
    rows = {i: rows[i] for i in last.values()}
    sets = {i: brute_shingles(r["text"]) for i, r in rows.items()}
    gone = set()
    root = {i: i for i in rows}
    for i in sorted(rows):
        for j in sorted(rows):
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = min(root[i], root[j]), max(root[i], root[j])
                root = {k: a if r == b else r for k, r in root.items()}
    gone = {i for i, r in root.items() if r != i}
    rows = {i: r for i, r in rows.items() if i not in gone}
    from graphloom.llm.queries import MIX_WEIGHTS

    leaf = [(i, "domain" + str(int(hashlib.md5(r["source"].encode()).hexdigest()[:8], 16) % 4), r["lang"], r["source"], len(WORD.findall(r["text"]))) for i, r in rows.items()]
    taken = {i for i, (c, _) in brute_mix(leaf, 0.6, MIX_WEIGHTS, 1, "mix-1").items() if c}
    got = corpus_pipeline.run(spark, sf).collect()
    assert {r["doc_id"] for r in got} == taken
    total = Counter()
    for r in got:
        total[r["doc_id"]] += r["length"]
    assert all(total[r["doc_id"]] == r["doc_tokens"] for r in got)


def test_samples_of_repeated_rows(spark):
    """Rows that repeat a doc_id: one labelled row a document for op9, and samples that no partitioning changes."""
    from graphloom.llm import language, toxicity

    rows = [(i, f"text {j} of {i} " * 3, "abcd"[j % 4]) for i in range(1, 30) for j in range(12)] + [(None, "x", "a"), (31, None, "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(3, 0), (None, 1)], "doc_id long, toxic int")
    got = [sorted(map(tuple, toxicity.training_rows(df.repartition(n), labels).collect())) for n in (1, 7)]
    assert got[0] == got[1] and len({t.rsplit("of ", 1)[1] for t, _ in got[0] if t}) == len([t for t, _ in got[0] if t])
    assert len(toxicity.training_rows(df, labels, most=5).collect()) <= 5
    assert language.training_windows(df.repartition(1), 40) == language.training_windows(df.repartition(9).orderBy("text"), 40)
