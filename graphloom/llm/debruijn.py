"""Removal of repeated word windows over a compacted de Bruijn graph.

The edges of the graph are windows of k consecutive words that occur more than once, its nodes their first and last k - 1
words. Windows that share their smallest-hash gram (the anchor) and follow each other are a run; equal windows have equal
anchors, so few runs, not all windows, are sent.

1. Each batch of documents finds its runs. A run that the batch repeats is compared word by word with its last
   occurrence and leaves as a settled span; the others meet by anchor, and runs whose anchor stands nowhere else go.
2. Where an anchor stands in one kind of run only, the run's first occurrence is one edge of several windows; where it
   stands in several kinds, each window of each kind's first occurrence is an edge. Equal edges fall together, and the
   first place of each is its source.
3. A node with one edge in and one out links the two. Linked edges that follow each other in their source are segments;
   segments are linked to paths by joins that double the distance each round, and each edge gets its place on its path.
4. Every later occurrence is a walk along a path. Pieces of walks that follow each other on one path are one span; a
   digest of each piece's words is compared with the digest taken at the path's source before its words are removed."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, stash
from .suffix_dedup import ROOM, Rolling, anchors, mix, pieces

GRAM = 5
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(9, 14)]] = True


def word_bounds(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the words of UTF-8 bytes."""
    gap = np.concatenate(([True], WHITE[raw], [True]))
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    return edge[0::2], edge[1::2]


def stretches(batches, k: int, most_bytes: int, most_words: int):
    """(doc ids, bases, bytes) of about most_bytes each. A long text comes in stretches of most_words windows that share k - 1
    words, so each window lies in one of them."""
    for batch in batches:
        docs, bases, raws, size = [], [], [], 0
        for d, t, b in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            raw = t.encode("utf-8", "surrogatepass")
            parts = [(0, raw)]
            if len(raw) > most_bytes:
                begin, end = word_bounds(np.frombuffer(raw, np.uint8))
                parts = [(w, raw[begin[w] : end[min(w + most_words + k - 1, len(end)) - 1]]) for w in range(0, max(len(begin) - k + 1, 0), most_words)]
            for at, part in parts:
                docs.append(d)
                bases.append(b + at)
                raws.append(part)
                size += len(part)
                if size >= most_bytes:
                    yield docs, bases, raws
                    docs, bases, raws, size = [], [], [], 0
        if docs:
            yield docs, bases, raws


RUN = pa.schema([("deal", pa.int64()), ("run", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("many", pa.int32()), ("n", pa.int32())])


def find_runs(k: int, most_bytes: int = 2 << 20, most_words: int = 200_000):
    """Batches of (doc_id, text, base) to runs: those new in the batch by anchor, with their number there; repeated ones, which
    equal earlier words of the batch, as settled spans (n = 0), joined where they follow each other."""

    def run(batches):
        for docs, bases, raws in stretches(batches, k, most_bytes, most_words):
            order = np.lexsort((np.array(bases, np.int64), np.array(docs, np.int64)))
            ids, base = np.array(docs, np.int64)[order], np.array(bases, np.int64)[order]
            text = b" ".join(raws[i] for i in order)
            raw = np.frombuffer(text, np.uint8)
            begin, end = word_bounds(raw)
            stop = np.cumsum([len(raws[i]) + 1 for i in order])
            last_word = np.searchsorted(begin, stop)
            first_word = np.concatenate(([0], last_word[:-1]))
            values = Rolling(raw).of(begin, end)
            rolling = Rolling(values)
            a, first, last = anchors(rolling, values, first_word, last_word, k, GRAM)
            if not len(a):
                continue
            key = rolling.of(a, a + GRAM)
            with np.errstate(over="ignore"):
                kind = mix(rolling.of(first, last + k) + (a - first).astype(np.uint64) * np.uint64(1000) + (last - first).astype(np.uint64))
            owner = np.searchsorted(last_word, first, side="right")
            by = np.lexsort((np.arange(len(a)), kind, key))
            same = (key[by][1:] == key[by][:-1]) & (kind[by][1:] == kind[by][:-1])
            before = np.full(len(a), -1)
            before[by[1:][same]] = by[:-1][same]
            root = np.maximum.accumulate(np.where(np.concatenate(([True], ~same)), np.arange(len(a)), 0))
            number = np.zeros(len(a), np.int64)
            np.add.at(number, by[root], 1)

            new = np.flatnonzero(before < 0)
            yield pa.RecordBatch.from_arrays([pa.array(key[new].view(np.int64)), pa.array(kind[new].view(np.int64)), pa.array(ids[owner[new]]), pa.array(first[new] - first_word[owner[new]] + base[owner[new]]), pa.array((last - first + 1)[new].astype(np.int32)), pa.array(number[new].astype(np.int32))], schema=RUN)

            old = np.flatnonzero(before >= 0)
            if not len(old):
                continue
            source = first[before[old]]
            delta, from_ = first[old] - source, owner[before[old]]
            joined = (np.diff(old) == 1) & (np.diff(owner[old]) == 0) & (first[old][1:] == last[old][:-1] + 1) & (np.diff(delta) == 0) & (np.diff(from_) == 0)
            head = np.flatnonzero(np.concatenate(([True], ~joined)))
            tail = np.concatenate((head[1:], [len(old)])) - 1
            start, many, source = first[old][head], last[old][tail] - first[old][head] + 1, source[head]
            there = np.zeros(len(head), bool)
            for i, (s, m, o) in enumerate(zip(start.tolist(), many.tolist(), source.tolist(), strict=True)):
                x, y = text[begin[s] : end[s + m + k - 2]], text[begin[o] : end[o + m + k - 2]]
                there[i] = x == y or x.split() == y.split()
            start, many, who = start[there], many[there], owner[old][head][there]
            at = start - first_word[who] + base[who]
            zero = np.zeros(len(at), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(mix(ids[who].view(np.uint64)).view(np.int64)), pa.array(zero), pa.array(ids[who]), pa.array(at), pa.array(many.astype(np.int32)), pa.array(zero.astype(np.int32))], schema=RUN)

    return run


EDGE = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("many", pa.int32()), ("n", pa.int64()), ("whole", pa.bool_()), ("tail", pa.int64()), ("head", pa.int64()), ("digest", pa.int64())])


def plain(text: str | None) -> tuple[bytes, np.ndarray, np.ndarray]:
    """A text's words joined by one space, with their begins and ends."""
    raw = b" ".join((text or "").encode("utf-8", "surrogatepass").split())
    return raw, *word_bounds(np.frombuffer(raw, np.uint8))


def digest(raw: bytes) -> int:
    """64 bits of a stretch of words, as a signed number."""
    return xxhash.xxh3_64_intdigest(raw) - (1 << 63)


def find_edges(k: int, most_words: int = 200_000):
    """(doc_id, text, base, runs) to edges: of a whole run, or of each window; with their nodes and a digest of their words."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                col = batch.slice(at, 512).to_pydict()
                for doc, text, base, runs in zip(col["doc_id"], col["text"], col["base"], col["runs"], strict=True):
                    raw, begin, end = plain(text)
                    data = np.frombuffer(raw, np.uint8)
                    runs = sorted((r["start"] - base, r["many"], r["n"], r["whole"]) for r in runs)
                    while runs:
                        low = runs[0][0]
                        part = [r for r in runs[: most_words // 8] if r[0] < low + most_words]
                        runs = runs[len(part) :]
                        high = part[-1][0] + part[-1][1] + k - 1
                        cut_at = begin[low]
                        nodes = Rolling(Rolling(data[cut_at : end[high - 1]]).of(begin[low:high] - cut_at, end[low:high] - cut_at))
                        start, many, times, whole = (np.array(c) for c in zip(*part, strict=True))
                        each = np.where(whole, 1, many)
                        s = np.repeat(start, each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
                        m = np.repeat(np.where(whole, many, 1), each)
                        left, right = nodes.of(s - low, s - low + k - 1), nodes.of(s - low + m, s - low + m + k - 1)
                        digests = [digest(raw[x:y]) for x, y in zip(begin[s].tolist(), end[s + m + k - 2].tolist(), strict=True)]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), doc)), pa.array(s + base), pa.array(m.astype(np.int32)), pa.array(np.repeat(times, each)), pa.array(np.repeat(whole, each)), pa.array(left.view(np.int64)), pa.array(right.view(np.int64)), pa.array(digests, pa.int64())], schema=EDGE)

    return run


def chains(segments: DataFrame, small: int = 50_000) -> DataFrame:
    """id, path, offset of segments (id, size, prev: the id before or null): the id at the head of each chain, and the sizes
    between. Each round doubles the distance to the known predecessor, so rounds are logarithmic in the longest chain. What
    has no head lies on a cycle, which then is cut before its smallest id: as soon as a round neither settles a row nor finds
    a smaller id, each row knows the smallest of its cycle. Up to `small` rows that
    still move are broadcast to the state, which lies in few files; more are joined by a shuffle. The driver keeps a
    broadcast for some rounds, so the settled rows, soon the most, are never part of one. Each round's state is written and read
    again: a checkpoint keeps the estimated size, which such a join squares, so that its digits double each round."""
    n = segments.count()
    parts = 1 + n // 100_000
    few = lambda df, n: F.broadcast(df) if n <= small else df.hint("merge")
    keep = lambda df: stash(df.coalesce(parts), "chains")
    size = keep(segments.select(F.col("id").alias("path"), F.col("size").alias("more")))
    state = segments.select("id", F.coalesce("prev", "id").alias("path"), F.col("prev").isNull().alias("done"), F.col("id").alias("low"))
    state = keep(state.join(few(size, n), "path", "left").select("id", "path", F.when(F.col("done"), F.lit(0)).otherwise(F.col("more")).cast("long").alias("offset"), "done", "low", F.lit(True).alias("lowered")))
    before = None
    while True:
        left, lowered = state.agg(F.count(F.when(~F.col("done"), 1)), F.count(F.when(~F.col("done") & F.col("lowered"), 1))).first()
        if not left:
            return state.select("id", "path", "offset")
        if left == before and not lowered:
            break
        before = left
        ahead = state.select(F.col("id").alias("path"), F.col("path").alias("to"), F.col("offset").alias("more"), F.col("done").alias("ends"), F.col("low").alias("lower"))
        moved = few(state.where("not done"), left).join(ahead, "path").select("id", F.col("to").alias("path"), (F.col("offset") + F.col("more")).alias("offset"), F.col("ends").alias("done"), F.least("low", "lower").alias("low"), (F.col("lower") < F.col("low")).alias("lowered"))
        state = keep(state.where("done").unionByName(moved))
    settled = state.where("done").select("id", "path", "offset")
    rest = state.where("not done").select("id", "low")
    rest = keep(segments.join(few(rest, left), "id").withColumn("prev", F.when(F.col("id") != F.col("low"), F.col("prev"))).drop("low"))
    return settled.unionByName(chains(rest, small))


def compact(edges: DataFrame) -> DataFrame:
    """edges (doc_id, start, many, tail, head; place doc_id, start is unique) with path_doc, path_start, offset: the place of
    the first edge of their path, and how many windows of the path lie before."""
    place = F.struct("doc_id", "start")
    ends = edges.select(F.col("tail").alias("node"), place.alias("out"), F.lit(None).cast("struct<doc_id: long, start: long>").alias("in")).unionByName(
        edges.select(F.col("head").alias("node"), F.lit(None).cast("struct<doc_id: long, start: long>").alias("out"), place.alias("in"))
    )
    nodes = ends.groupBy("node").agg(F.count("in").alias("n_in"), F.count("out").alias("n_out"), F.min("in").alias("in"), F.min("out").alias("out"))
    links = nodes.where("n_in = 1 and n_out = 1").select(F.col("out.doc_id").alias("doc_id"), F.col("out.start").alias("start"), F.col("in").alias("before"))
    linked = edges.join(links, ["doc_id", "start"], "left")
    walk = Window.partitionBy("doc_id").orderBy("start")
    follows = F.col("before").isNotNull() & (F.col("before.doc_id") == F.col("doc_id")) & (F.col("before.start") == F.lag("start").over(walk)) & (F.lag("start").over(walk) + F.lag("many").over(walk) == F.col("start"))
    heads = linked.withColumn("first", ~F.coalesce(follows, F.lit(False))).withColumn("segment", F.last(F.when(F.col("first"), F.col("start")), ignorenulls=True).over(walk))
    heads = stash(heads, "segments")
    segments = heads.groupBy("doc_id", "segment").agg(F.sum("many").alias("size"), F.max(F.when(F.col("first"), F.col("before"))).alias("before"))
    owner = heads.select(F.struct("doc_id", "start").alias("before"), F.struct(F.col("doc_id"), F.col("segment").alias("start")).alias("prev"))
    joint = cut(segments.join(owner, "before", "left").select(F.struct(F.col("doc_id"), F.col("segment").alias("start")).alias("id"), "size", "prev"))
    paths = chains(joint).select(F.col("id.doc_id").alias("doc_id"), F.col("id.start").alias("segment"), F.col("path"), F.col("offset").alias("_before"))
    return heads.join(paths, ["doc_id", "segment"]).withColumn("offset", F.col("_before") + F.col("start") - F.col("segment")).withColumns({"path_doc": F.col("path.doc_id"), "path_start": F.col("path.start")}).drop("_before", "path", "before", "first", "segment")


def base_of(start: str):
    return F.shiftleft(F.shiftright(start, ROOM), ROOM)


def remove_repeats(docs: DataFrame, k: int = 20, bucket_bytes: int = 64 << 20, most_words: int = 200_000) -> DataFrame:
    """doc_id, n_words, n_removed, spans (start, many: windows, path_doc, path_start, offset), kept (text), kept_sha256 of every row.

    A word goes if a window of k words that covers it also starts earlier (smaller doc_id, or same document, earlier start).
    Words are what lies between ASCII white space; a null text has none, and texts under k words keep all. doc_id is the
    identity of a document: rows without one are returned whole, rows that repeat one count as stretches of it, one after the
    other (no window spans two): of equal rows the first stays as it is, different texts follow each other in the order of
    their 64-bit hashes. Spans settled inside a batch name no path. Kept words are joined by one space.

    Long texts are read in stretches of most_words windows; a word is read whole. There is a task for each bucket_bytes."""
    if k <= GRAM:
        raise ValueError(f"k must be above {GRAM}")
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = pieces(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    able = texts.where(F.octet_length("text") >= 2 * k - 1).where("doc_id is not null").select("doc_id", "text", "base")
    tasks = max(partitions, (able.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // bucket_bytes)

    found = able.mapInArrow(find_runs(k, most_words=most_words), "deal long, run long, doc_id long, start long, many int, n int").repartition(tasks, "deal")
    settled = F.col("n") == 0
    found = found.withColumn("settled", settled)
    anchor, kind = Window.partitionBy("deal", "settled"), Window.partitionBy("deal", "settled", "run")
    ordered = kind.orderBy("doc_id", "start")
    runs = (
        found.withColumns({"rank": F.row_number().over(ordered), "source": F.first(F.struct("doc_id", "start")).over(ordered), "total": F.sum("n").over(kind), "rows": F.count("*").over(anchor)})
        .withColumn("kinds", F.sum(F.when(F.col("rank") == 1, 1)).over(anchor))
        .where("settled or rows > 1 or n > 1")
        .select("doc_id", "start", "many", "settled", (F.col("rank") == 1).alias("first"), "source", F.col("total").alias("n"), (F.col("kinds") == 1).alias("whole"))
    )
    runs = stash(runs, "word-runs")

    firsts = runs.where("not settled and first").groupBy("doc_id", base_of("start").alias("base")).agg(F.collect_list(F.struct("start", "many", "n", "whole")).alias("runs"))
    shape = "doc_id long, start long, many int, n long, whole boolean, tail long, head long, digest long"
    edges = able.join(firsts, ["doc_id", "base"]).select("doc_id", "text", "base", "runs").mapInArrow(find_edges(k, most_words), shape)
    equal = Window.partitionBy("tail", "head", "many")
    least = F.first(F.struct("doc_id", "start", "digest")).over(equal.orderBy("doc_id", "start"))
    edges = stash(edges.withColumns({"edge": least, "times": F.sum("n").over(equal)}).where("times > 1").drop("n"), "edges")
    own = (F.col("edge.doc_id") == F.col("doc_id")) & (F.col("edge.start") == F.col("start"))
    # A source stands where no equal edge lies before it; equal digests confirm that an edge equals its source.
    path = compact(edges.where(own).select("doc_id", "start", "many", "tail", "head")).select(F.col("doc_id").alias("edge_doc"), F.col("start").alias("edge_start"), "path_doc", "path_start", "offset")
    on_path = edges.select("doc_id", "start", "many", "digest", own.alias("own"), (F.col("edge.digest") == F.col("digest")).alias("sure"), F.col("edge.doc_id").alias("edge_doc"), F.col("edge.start").alias("edge_start")).join(path, ["edge_doc", "edge_start"])
    on_path = stash(on_path.where("sure"), "path-edges")

    later = runs.where("not settled and not first")
    walks = later.where("whole").select("doc_id", "start", "many", F.col("source.doc_id").alias("source_doc"), F.col("source.start").alias("source_start")).unionByName(
        later.where("not whole").withColumn("j", F.explode(F.sequence(F.lit(0), F.col("many") - 1))).select("doc_id", (F.col("start") + F.col("j")).alias("start"), F.lit(1).alias("many"), F.col("source.doc_id").alias("source_doc"), (F.col("source.start") + F.col("j")).alias("source_start"))
    )
    sources = on_path.select(F.col("doc_id").alias("source_doc"), F.col("start").alias("source_start"), "path_doc", "path_start", "offset", "digest")
    walks = walks.join(sources, ["source_doc", "source_start"]).select("doc_id", "start", "many", "path_doc", "path_start", "offset", "digest")
    walks = walks.unionByName(on_path.where("not own").select("doc_id", "start", "many", "path_doc", "path_start", "offset", "digest"))
    line = Window.partitionBy("doc_id", "base", "path_doc", "path_start", "delta").orderBy("start")
    goes_on = F.lag("start").over(line) + F.lag("many").over(line) == F.col("start")
    spans = (
        walks.withColumns({"base": base_of("start"), "delta": F.col("start") - F.col("offset")})
        .withColumn("span", F.last(F.when(~F.coalesce(goes_on, F.lit(False)), F.col("start")), ignorenulls=True).over(line))
        .groupBy("doc_id", "base", "path_doc", "path_start", "delta", "span")
        .agg(F.sum("many").cast("long").alias("many"), F.array_sort(F.collect_list(F.struct("start", "many", "digest"))).alias("parts"))
        .select("doc_id", "base", F.struct(F.col("span").alias("start"), "many", "path_doc", "path_start", (F.col("span") - F.col("delta")).alias("offset"), "parts").alias("span"))
    )
    nothing = {"path_doc": "long", "path_start": "long", "offset": "long", "parts": "array<struct<start: long, many: int, digest: long>>"}
    batch = runs.where("settled").select("doc_id", base_of("start").alias("base"), F.struct("start", F.col("many").cast("long").alias("many"), *(F.lit(None).cast(t).alias(c) for c, t in nothing.items())).alias("span"))
    gone = spans.unionByName(batch).groupBy("doc_id", "base").agg(F.collect_list("span").alias("gone"))
    shape = "doc_id long, n_words long, n_removed long, spans array<struct<start: long, many: long, path_doc: long, path_start: long, offset: long>>, kept string, kept_sha256 string"
    return texts.join(gone, ["doc_id", "base"], "left").select("doc_id", "text", "base", "copies", "gone").mapInArrow(finish(k), shape)


SPAN = pa.struct([("start", pa.int64()), ("many", pa.int64()), ("path_doc", pa.int64()), ("path_start", pa.int64()), ("offset", pa.int64())])
RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(SPAN)), ("kept", pa.string()), ("kept_sha256", pa.string())])


def finish(k: int):
    """(doc_id, text, base, copies, gone) to results: each part of a span is compared with its digest, then its words go."""

    def row(doc, raw: bytes, begin: np.ndarray, end: np.ndarray, spans: list[dict]) -> tuple:
        if not spans:
            return doc, len(begin), 0, [], raw.decode("utf-8", "surrogatepass"), hashlib.sha256(raw).hexdigest()
        cover = np.zeros(len(begin) + 1, np.int64)
        sure = []
        for s in spans:
            parts = s.pop("parts") or []
            if all(digest(raw[begin[p["start"]] : end[p["start"] + p["many"] + k - 2]]) == p["digest"] for p in parts):
                cover[s["start"]] += 1
                cover[s["start"] + s["many"] + k - 1] -= 1
                sure.append(s)
        gone = np.cumsum(cover[:-1]) > 0
        # Each word with the space behind it; the last kept one's goes.
        kept = np.frombuffer(raw + b" ", np.uint8)[np.repeat(~gone, end - begin + 1)].tobytes()[:-1]
        return doc, len(begin), int(gone.sum()), sorted(sure, key=lambda s: (s["start"], s["many"])), kept.decode("utf-8", "surrogatepass"), hashlib.sha256(kept).hexdigest()

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({f.name: [r[i] for r in rows] for i, f in enumerate(RESULT)}, schema=RESULT)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                col = batch.slice(at, 512).to_pydict()
                rows = []
                for doc, text, base, copies, gone in zip(*(col[c] for c in ("doc_id", "text", "base", "copies", "gone")), strict=True):
                    raw, begin, end = plain(text)
                    spans = [g | {"start": g["start"] - base, "parts": [p | {"start": p["start"] - base} for p in g["parts"] or []]} for g in gone or []]
                    rows.append(row(doc, raw, begin, end, spans))
                    # Of a further copy every window starts earlier.
                    whole = [{"start": 0, "many": len(begin) - k + 1, "path_doc": None, "path_start": None, "offset": None, "parts": []}] if len(begin) >= k else []
                    later = row(doc, raw, begin, end, whole) if copies > 1 else None
                    for done in range(0, copies - 1, 1024):
                        yield table([later] * min(1024, copies - 1 - done))
                yield table(rows)

    return run
