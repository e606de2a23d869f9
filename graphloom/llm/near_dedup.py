"""Near-duplicate documents by min-max hashing.

A document's set is its distinct five-word shingles. Under each permutation both the minimum and the maximum of the set
are kept, so 2k signature values cost k hash evaluations a shingle; the estimate is unbiased as for MinHash. Bands of
the signature give candidates, full sets confirm each link, and links give connected components.

Within a bucket all pairs are never formed: members are first compared with one member (a star), the one that has most of
its shingles in common with others. Where a bucket still holds several components, pairs across them are compared that
can be linked at all: a link needs near sizes, and shingles that no other document has count against it."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, hot_keys, map_batches, spread_join, stash

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each word of a text, in order; A-Z are lower-cased."""
    raw = LOWER[np.frombuffer(data, np.uint8)]
    inside = ~SPACE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([0], inside.view(np.int8), [0]))))
    start, stop = edge[::2], edge[1::2]
    if not len(start):
        return np.empty(0, np.uint64)
    # Polynomial in each byte's place within its word, so that equal words hash alike wherever they stand.
    length = stop - start
    where = np.flatnonzero(inside)
    place = np.arange(len(where)) - np.repeat(np.cumsum(length) - length, length)
    power = np.power(BASE, np.arange(1, int(length.max()) + 1, dtype=np.uint64), dtype=np.uint64)
    terms = mix(raw[where].astype(np.uint64) + np.uint64(1)) * power[place]
    return mix(np.add.reduceat(terms, np.cumsum(length) - length) + length.astype(np.uint64))


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles; with fewer words the whole sequence is one; else empty."""
    words = word_hashes(text.encode("utf-8", "surrogatepass")) if text else np.empty(0, np.uint64)
    if not len(words):
        return words
    n = min(width, len(words))
    total = np.full(len(words) - n + 1, np.uint64(n))
    for i in range(n):
        total = mix(total * BASE + words[i : len(words) - n + 1 + i])
    return np.unique(total)


def signature(shingles: np.ndarray, permutations: int, rows: int) -> np.ndarray:
    """Band keys of a non-empty set: `permutations` minima and as many maxima, in bands of `rows` values each."""
    seeds = mix(np.arange(1, permutations + 1, dtype=np.uint64) * BASE)
    low, high = np.empty(permutations, np.uint64), np.empty(permutations, np.uint64)
    for i, s in enumerate(seeds):
        h = (shingles ^ s) * (s | np.uint64(1))
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        low[i], high[i] = h.min(), h.max()
    values = np.concatenate((low, high)).reshape(-1, rows)
    key = np.arange(1, len(values) + 1, dtype=np.uint64)
    for j in range(rows):
        key = mix(key * BASE + values[:, j])
    return key.view(np.int64)


def profiles(docs: DataFrame, permutations: int, rows: int, width: int) -> DataFrame:
    """doc_id, n_shingles, a 128-bit fingerprint of the set (null for the empty one) and its band keys."""

    def each(c: dict) -> dict:
        out: dict = {"doc_id": c["doc_id"], "n_shingles": [], "print_a": [], "print_b": [], "bands": []}
        with np.errstate(over="ignore"):
            for text in c["text"]:
                s = shingle_set(text, width)
                out["n_shingles"].append(len(s))
                out["print_a"].append(int(mix(s).sum().view(np.int64)) if len(s) else None)
                out["print_b"].append(int(np.bitwise_xor.reduce(mix(s * BASE)).view(np.int64)) if len(s) else None)
                out["bands"].append(signature(s, permutations, rows) if len(s) else None)
        return out

    return map_batches(docs, each, "doc_id long, n_shingles long, print_a long, print_b long, bands array<long>", rows=2048)


def sets(docs: DataFrame, width: int) -> DataFrame:
    def each(c: dict) -> dict:
        with np.errstate(over="ignore"):
            return {"rep": c["doc_id"], "shingles": [shingle_set(t, width).view(np.int64) for t in c["text"]]}

    return map_batches(docs, each, "rep long, shingles array<long>", rows=256)


def confirm(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b), na, nb those whose full sets reach the similarity. A document is b in few pairs; a hub that is a in
    many has them dealt over several tasks."""
    pairs = cut(pairs)
    hubs = hot_keys(pairs.groupBy("a").agg(F.count("*").alias("n")), "a")
    one = pairs.join(full.select(F.col("rep").alias("b"), F.col("shingles").alias("sb")), "b")
    both = spread_join(one, full.select(F.col("rep").alias("a"), F.col("shingles").alias("sa")), "a", hubs, "b")
    common = F.size(F.array_intersect("sa", "sb")).cast("long")
    return both.where(common * 100 >= percent * (F.col("na") + F.col("nb") - common)).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """node, root (smallest node reachable) of every node in links (a, b). In each round a node takes the smallest of its
    label, its label's label and those of its neighbours, and so does the node that was its label: whole trees are hooked, which
    settles a chain in about log rounds. Labels only fall, so it ends when none changes; every round is checkpointed."""
    both = cut(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    label = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")))
    while True:
        jump = label.join(label.select(F.col("node").alias("root"), F.col("root").alias("over")), "root")
        near = both.join(jump.select(F.col("node").alias("b"), "over"), "b").groupBy(F.col("a").alias("node")).agg(F.min("over").alias("m"))
        mine = cut(jump.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "over", "m").alias("low")))
        lift = mine.groupBy(F.col("old").alias("node")).agg(F.min("low").alias("up"))
        new = cut(mine.join(lift, "node", "left").select("node", "old", F.least("low", "up").alias("root")))
        label = new.select("node", "root")
        if new.where("old <> root").isEmpty():
            return label


def common_shingles(full: DataFrame) -> DataFrame:
    """rep, c: how many of a document's shingles stand in another document of the table as well. A shingle of one document
    only is known by its count, with partial sums before the shuffle, so frequent shingles meet nowhere."""
    alone = full.select("rep", F.explode("shingles").alias("s")).groupBy("s").agg(F.count("*").alias("k"), F.min("rep").alias("rep")).where("k = 1").groupBy("rep").agg(F.count("*").alias("u"))
    return full.select("rep", F.size("shingles").alias("_n")).join(alone, "rep", "left").select("rep", (F.col("_n") - F.coalesce("u", F.lit(0))).cast("long").alias("c"))


def possible(percent: int, na: str, nb: str, ca: str, cb: str) -> str:
    """What holds of every link: sizes are near enough, and the common part, at most the smaller of both documents' shared
    shingles, is large enough."""
    return f"{percent} * greatest({na}, {nb}) <= 100 * least({na}, {nb}) and least({ca}, {cb}) * {100 + percent} >= {percent} * ({na} + {nb})"


def across(rest: DataFrame, percent: int, block: int = 128) -> DataFrame:
    """Pairs (a, b), na, nb of a bucket's members in different components that may be linked, each pair once.

    A bucket is cut into classes of size, so wide that linked documents lie in the same or in neighbouring ones, and a class
    into blocks of about `block` members. A member visits the blocks of its class and of the next; blocks are dealt by
    (band, class, block), and the condition picks the partners inside one. A pair counts only in the first band that it
    shares."""
    width = -math.log(percent / 100) * 1.001
    rest = rest.withColumn("cls", F.floor(F.log("n") / width))
    cell = ["band", "cls"]
    counts = cut(rest.groupBy(*cell).agg(F.count("*").alias("n")))
    hot = hot_keys(counts, cell)
    blocks_of = counts.select(*cell, F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    member = F.struct("rep", "n", "c", "root", "bands", F.col("cls").alias("at"))
    blocks = spread_join(rest, blocks_of, cell, hot, "rep").groupBy(*cell, F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("_k")).agg(F.collect_list(member).alias("block"))
    look = rest.withColumn("own", F.col("cls")).withColumn("cls", F.explode(F.array(F.col("cls"), F.col("cls") + 1)))
    visits = spread_join(look, blocks_of, cell, hot, "rep").withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    may = possible(percent, "n", "y.n", "c", "y.c")
    first = "element_at(filter(zip_with(bands, y.bands, (p, q) -> if(p = q, p, null)), p -> p is not null), 1) = band"
    partner = f"filter(block, y -> (own < y.at or rep < y.rep) and root <> y.root and {may} and {first})"
    fits = visits.join(blocks, [*cell, "_k"]).select(F.col("rep").alias("a"), F.col("n").alias("na"), F.expr(partner).alias("ys")).where("size(ys) > 0")
    return fits.select("a", "na", F.explode(F.transform("ys", lambda y: F.struct(y["rep"].alias("b"), y["n"].alias("nb")))).alias("y")).select("a", "na", "y.b", "y.nb")


def near_duplicates(docs: DataFrame, percent: int = 85, permutations: int = 32, rows: int = 4, width: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row.

    Documents are linked where 100 * |A and B| >= percent * |A or B|; bands miss a pair at 0.85 with probability under
    1e-5 at 16 bands of 4. Texts without words have an empty set and are linked with nothing; documents with equal sets are
    one node, so large groups of copies cost one row a copy. Repeated rows come out each, with the same values; rows
    without identifier are linked with nothing and have a null component. Further columns are not carried.

    Buckets, hubs and groups of equal sets with a large share of all rows are dealt over several tasks."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    seen = cut(profiles(texts, permutations, rows, width))
    able = seen.where("doc_id is not null and print_a is not null")
    prints = ["print_a", "print_b", "n_shingles"]
    reps = cut(able.groupBy(*prints).agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.count("*").alias("n")))
    copies = hot_keys(reps.select(*prints, "n"), prints)
    banded = reps.select("rep", F.col("n_shingles").alias("n"), F.explode("bands").alias("band"))
    shared = cut(banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"))
    hot = hot_keys(shared, "band")
    inside = cut(spread_join(banded, shared.select("band"), "band", hot, "rep"))
    full = stash(sets(texts.join(inside.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id"]), width), "shingle-sets")
    within = cut(inside.join(common_shingles(full), "rep"))
    hubs = within.groupBy("band").agg(F.max(F.struct((F.col("c") / F.col("n")).alias("share"), (-F.col("rep")).alias("low"), "rep", "n", "c")).alias("hub"))
    stars = spread_join(within, hubs, "band", hot, "rep").where("rep <> hub.rep").select(F.col("hub.rep").alias("a"), F.col("rep").alias("b"), F.col("hub.n").alias("na"), F.col("n").alias("nb"), F.col("hub.c").alias("ca"), F.col("c").alias("cb"))
    may = possible(percent, "na", "nb", "ca", "cb")
    links = cut(confirm(stars.where(may).distinct(), full, percent))
    label = components(links)

    # What is left: members of one bucket in different components. Pairs inside a component need no check.
    known = within.where(F.col("c") * 100 >= percent * F.col("n")).join(label.select(F.col("node").alias("rep"), "root"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    mixed = known.groupBy("band").agg((F.min("root") != F.max("root")).alias("mixed")).where("mixed").select("band")
    rest = cut(spread_join(known, mixed, "band", hot, "rep").join(reps.select("rep", "bands"), "rep"))
    more = cut(confirm(across(rest, percent), full, percent))
    if not more.isEmpty():
        label = components(cut(links.unionByName(more)))
    rooted = reps.join(label.select(F.col("node").alias("rep"), "root"), "rep", "left").select(*prints, F.coalesce("root", "rep").alias("component_id"))
    out = spread_join(seen, rooted, prints, copies, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, **params) -> DataFrame:
    """The rows of docs that stay: one document of each group (and rows without identifier), with their columns. Null and
    empty texts stay, each by itself; repeated rows of a document that stays stay all; no rows give none."""
    gone = near_duplicates(docs, **params).where("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")
