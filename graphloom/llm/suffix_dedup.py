"""Removal of repeated byte strings by a logarithmic family of suffix arrays.

Suffixes are compared by their first `span` (100) bytes. Sampling keeps their number small without losing a match: the
smallest-hash k-gram of a span-byte string (its anchor) is fixed by the string, so equal strings have equal anchors.

1. Each batch of documents finds its anchors and, for each, the run of strings that share it. Runs repeated inside the
   batch are settled there; the first of each is sent, as two hashes and its place, to the bucket of its anchor.
2. A bucket settles runs that are equal as a whole, and names the anchors that stand in different runs.
3. Only the strings around those anchors are sent as bytes. A bucket sorts each arriving batch of suffixes, scans it
   against the sorted levels it holds, and merges levels of equal size, so each suffix is merged a logarithmic number of times.
4. Removed stretches are joined to the texts."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, running_total, stash

GRAM = 24
BASE = 0x9E3779B97F4A7C15
#: Different texts of one identifier count as stretches of one document; each begins at a multiple of 2^ROOM.
ROOM = 31
RECORD = np.dtype([("key", "<u8"), ("run", "<u8"), ("doc", "<i8"), ("start", "<i8"), ("many", "<u4"), ("shift", "<u2")])


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


INVERSE = pow(BASE, -1, 1 << 64)


class Rolling:
    """Hashes of any stretch of an array (bytes, or 64-bit values), alike wherever the stretch lies: prefix sums of
    value * BASE^place modulo 2^64, with the power of the place divided out."""

    def __init__(self, values: np.ndarray) -> None:
        with np.errstate(over="ignore"):
            if values.dtype == np.uint8:
                values = mix(np.arange(1, 257, dtype=np.uint64))[values]
            power, self.back = (np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(len(values), b, np.uint64))), dtype=np.uint64) for b in (BASE, INVERSE))
            self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * power[:-1], dtype=np.uint64)))

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[stop] - self.sums[start]) * self.back[start])


def anchors(rolling: Rolling, raw: np.ndarray, begin: np.ndarray, end: np.ndarray, span: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of documents raw[begin:end]: each run's anchor, first window and last window (places in raw)."""
    n = len(raw) - gram + 1
    if n < 1 or len(raw) < span:
        return (np.empty(0, np.int64),) * 3
    at = np.arange(n)
    h = rolling.of(at, at + gram)
    low = (h & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    width = span - gram + 1
    size, reach = 1, low
    while size * 2 <= width:
        reach = np.minimum(reach[:-size], reach[size:])
        size *= 2
    best = np.minimum(reach[: len(low) - width + 1], reach[width - size : width - size + len(low) - width + 1])
    anchor = (best & np.uint64(0xFFFFFFFF)).astype(np.int64)
    lead = np.zeros(len(raw) + 1, np.int8)
    whole = end - begin >= span
    np.add.at(lead, begin[whole], 1)
    np.add.at(lead, end[whole] - span + 1, -1)
    valid = np.flatnonzero(np.cumsum(lead)[: len(anchor)] > 0)
    if not len(valid):
        return (np.empty(0, np.int64),) * 3
    new = np.flatnonzero(np.concatenate(([True], (np.diff(anchor[valid]) != 0) | (np.diff(valid) != 1))))
    last = np.concatenate((new[1:], [len(valid)])) - 1
    return anchor[valid[new]], valid[new], valid[last]


def spans(starts: np.ndarray, stops: np.ndarray) -> list[tuple[int, int]]:
    """Union of stretches as maximal ones."""
    order = np.argsort(starts, kind="stable")
    out: list[list[int]] = []
    for a, b in zip(starts[order].tolist(), stops[order].tolist(), strict=True):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def laid_out(docs: list, raws: list[bytes], bases: list) -> tuple[np.ndarray, ...]:
    """Stretches end to end in the order of their identifiers and bases: identifiers, bases, bytes, begins, ends."""
    order = np.lexsort((np.array(bases, np.int64), np.array(docs, np.int64)))
    size = np.array([len(raws[i]) for i in order], np.int64)
    end = np.cumsum(size)
    return np.array(docs, np.int64)[order], np.array(bases, np.int64)[order], np.frombuffer(b"".join(raws[i] for i in order), np.uint8), end - size, end


def firsts(*keys: np.ndarray) -> np.ndarray:
    """For rows already in (document, start) order: which are the first of their key."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    out = np.zeros(len(order), bool)
    out[order[new]] = True
    return out


OUT = "bucket long, batch long, kind int, body binary"
FOUND = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("shift", pa.int32()), ("key", pa.int64())])


def squeeze(rows: np.ndarray) -> bytes:
    """Records column by column, documents and starts as differences, compressed."""
    columns = [rows["key"], rows["run"], np.diff(rows["doc"], prepend=0), np.diff(rows["start"], prepend=0), rows["many"], rows["shift"]]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(c.tobytes() for c in columns))


def expand(body: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(body)
    rows, at = np.empty(len(raw) // RECORD.itemsize, RECORD), 0
    for name in RECORD.names:
        rows[name] = np.frombuffer(raw, RECORD[name], len(rows), at)
        at += RECORD[name].itemsize * len(rows)
    rows["doc"], rows["start"] = np.cumsum(rows["doc"]), np.cumsum(rows["start"])
    return rows


def slices(batches, span: int, most_bytes: int = 2 << 20):
    """(doc ids, bytes, bases) of at most about most_bytes each. A longer text comes in stretches that overlap by span - 1
    bytes: each span-byte string lies in one of them. A run that a border cuts differs as a whole from an uncut one, so its
    anchor is looked into by bytes."""
    for batch in batches:
        docs, raws, bases, size = [], [], [], 0
        for d, t, b in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            raw = (t or "").encode("utf-8", "surrogatepass")
            for at in range(0, max(len(raw) - span + 1, 1), most_bytes):
                piece = raw[at : at + most_bytes + span - 1]
                docs.append(d)
                raws.append(piece)
                bases.append(b + at)
                size += len(piece)
                if size >= most_bytes:
                    yield docs, raws, bases
                    docs, raws, bases, size = [], [], [], 0
        if docs:
            yield docs, raws, bases


def send(kind: int, bucket: np.ndarray, rows: np.ndarray, batch: int) -> pa.RecordBatch:
    order = np.argsort(bucket, kind="stable")
    rows, bucket = rows[order], bucket[order]
    edge = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(rows) else np.empty(0, np.int64)
    stop = np.concatenate((edge[1:], [len(rows)]))[: len(edge)]
    n = len(edge)
    body = [squeeze(rows[a:b]) for a, b in zip(edge, stop, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(bucket[edge], pa.int64()), pa.array([batch] * n, pa.int64()), pa.array([kind] * n, pa.int32()), pa.array(body, pa.binary())], names=["bucket", "batch", "kind", "body"])


def joined(rows: np.ndarray) -> np.ndarray:
    """Settled runs in the order of their places, those that follow each other as one: a periodic text leaves few."""
    edge = np.flatnonzero(np.concatenate(([True], (rows["doc"][1:] != rows["doc"][:-1]) | (rows["start"][1:] != rows["start"][:-1] + rows["many"][:-1]))))
    out = rows[edge].copy()
    out["many"] = np.add.reduceat(rows["many"], edge)
    return out


RUNS, DONE, WINDOWS = 0, 1, 2


def first_pass(span: int, buckets: int, most_bytes: int = 2 << 20):
    """Batches of documents to records: RUNS by anchor, DONE (already settled, passed through) by document."""

    def run(batches):
        for part in slices(batches, span, most_bytes):
            ids, base, raw, begin, end = laid_out(*part)
            rolling = Rolling(raw)
            a, first, last = anchors(rolling, raw, begin, end, span)
            if not len(a):
                continue
            rows = np.empty(len(a), RECORD)
            owner = np.searchsorted(end, first, side="right")
            rows["key"] = rolling.of(a, a + GRAM)
            with np.errstate(over="ignore"):
                rows["run"] = mix(rolling.of(first, last + span) + (a - first).astype(np.uint64) * np.uint64(1000) + (last - first).astype(np.uint64))
            rows["doc"], rows["start"], rows["many"], rows["shift"] = ids[owner], first - begin[owner] + base[owner], last - first + 1, a - first
            new = firsts(rows["key"], rows["run"])
            batch = int(ids[0])
            yield send(RUNS, (rows["key"][new] % np.uint64(buckets)).astype(np.int64), rows[new], batch)
            if not new.all():
                old = joined(rows[~new])
                yield send(DONE, (mix((old["doc"] ^ (old["start"] >> ROOM)).view(np.uint64)) % np.uint64(buckets)).astype(np.int64), old, batch)

    return run


def found(doc, start, stop, shift, key) -> pa.Table:
    return pa.Table.from_arrays([pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(stop, pa.int64()), pa.array(shift, pa.int32()), pa.array(key, pa.int64())], schema=FOUND)


def settle_runs(span: int):
    """Of a bucket: stretches of repeated runs (shift -1), and runs to look into, whose anchor stands in several (shift >= 0)."""

    def bucket(table: pa.Table) -> pa.Table:
        kinds = table.column("kind").to_pylist()
        bodies = table.column("body").to_pylist()
        rows = np.concatenate([np.empty(0, RECORD)] + [expand(b) for k, b in zip(kinds, bodies, strict=True) if k == RUNS])
        done = np.concatenate([np.empty(0, RECORD)] + [expand(b) for k, b in zip(kinds, bodies, strict=True) if k == DONE])
        rows = rows[np.lexsort((rows["start"], rows["doc"]))]
        new = firsts(rows["key"], rows["run"])
        done = np.concatenate((done, rows[~new]))
        rows = rows[new]
        _, back, many = np.unique(rows["key"], return_inverse=True, return_counts=True)
        open_ = rows[many[back] > 1]
        stop = lambda r: r["start"] + r["many"] + (span - 1)
        both = np.concatenate((done, open_))
        shift = np.concatenate((np.full(len(done), -1), open_["shift"].astype(np.int64)))
        return found(both["doc"], both["start"], stop(both), shift, both["key"].view(np.int64))

    return bucket


class Levels:
    """The index of one bucket: sorted arrays of distinct suffixes with their earliest place, of sizes that double.

    add() sorts a new batch, scans it against every level, and merges levels while the newest is no smaller than half the
    one before. What turns out to be later than an equal suffix is reported once."""

    def __init__(self) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        self.later: list[np.ndarray] = []

    def add(self, text: np.ndarray, place: np.ndarray) -> None:
        """text: suffixes as fixed-length byte strings; place: (document, start)."""
        order = np.lexsort((place["start"], place["doc"], text))
        text, place = text[order], place[order]
        new = np.concatenate(([True], text[1:] != text[:-1]))
        self.later.append(place[~new])
        text, place = text[new], place[new].copy()
        fresh = np.ones(len(text), bool)
        for level_text, level_place in self.levels:
            at = np.minimum(np.searchsorted(level_text, text), len(level_text) - 1)
            same = np.flatnonzero(level_text[at] == text)
            held, own = level_place[at[same]], place[same]
            early = (own["doc"] < held["doc"]) | ((own["doc"] == held["doc"]) & (own["start"] < held["start"]))
            self.later += [own[~early], held[early]]
            level_place[at[same[early]]] = own[early]
            fresh[same] = False
        text, place = text[fresh], place[fresh]
        while self.levels and len(self.levels[-1][0]) <= 2 * len(text):
            old_text, old_place = self.levels.pop()
            spot = np.searchsorted(old_text, text)
            text, place = np.insert(old_text, spot, text), np.insert(old_place, spot, place)
        if len(text):
            self.levels.append((text, place))


PLACE = np.dtype([("doc", "<i8"), ("start", "<i8")])


HEAD = np.dtype([("doc", "<i8"), ("start", "<i8"), ("size", "<i8")])


def second_pass(span: int, buckets: int):
    """(doc_id, text, base, open runs) to the bytes of each open run, by anchor: heads, then bytes, compressed."""

    def run(batches):
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                col = batch.slice(at, 2048).to_pydict()
                heads: dict[int, list[tuple[int, int, int]]] = {}
                parts: dict[int, list[bytes]] = {}
                for doc, text, base, runs in zip(col["doc_id"], col["text"], col["base"], col["runs"], strict=True):
                    raw = text.encode("utf-8", "surrogatepass")
                    for r in runs:
                        bucket = (r["key"] & 0xFFFFFFFFFFFFFFFF) % buckets
                        heads.setdefault(bucket, []).append((doc, r["start"], r["stop"] - r["start"]))
                        parts.setdefault(bucket, []).append(raw[r["start"] - base : r["stop"] - base])
                body = [len(h).to_bytes(8, "little") + pack.compress(np.array(h, HEAD).tobytes() + b"".join(parts[b])) for b, h in heads.items()]
                n, first = len(heads), min(col["doc_id"], default=0)
                yield pa.RecordBatch.from_arrays([pa.array(heads, pa.int64()), pa.array([first] * n, pa.int64()), pa.array([WINDOWS] * n, pa.int32()), pa.array(body, pa.binary())], names=["bucket", "batch", "kind", "body"])

    return run


def suffixes(body: bytes, span: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of a batch, cut at span bytes, and their places."""
    n = int.from_bytes(body[:8], "little")
    raw = zstandard.ZstdDecompressor().decompress(body[8:])
    head = np.frombuffer(raw, HEAD, n)
    data = np.frombuffer(raw, np.uint8, offset=n * HEAD.itemsize)
    many = head["size"] - span + 1
    step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    at = np.repeat(np.cumsum(head["size"]) - head["size"], many) + step
    place = np.empty(len(at), PLACE)
    place["doc"], place["start"] = np.repeat(head["doc"], many), np.repeat(head["start"], many) + step
    # One byte more than the suffix: numpy's strings drop zero bytes at their end when compared.
    text = np.ones((len(at), span + 1), np.uint8)
    text[:, :span] = np.lib.stride_tricks.sliding_window_view(data, span)[at]
    return text.view(f"S{span + 1}").ravel(), place


def settle_windows(span: int):
    """Of a bucket: stretches [start, start + span) of suffixes that also start earlier."""

    def bucket(table: pa.Table) -> pa.Table:
        index = Levels()
        for i in np.argsort(np.array(table.column("batch").to_pylist(), np.int64), kind="stable"):
            index.add(*suffixes(table.column("body")[int(i)].as_py(), span))
        later = np.unique(np.concatenate([np.empty(0, PLACE), *index.later]))
        if not len(later):
            return FOUND.empty_table()
        edge = np.flatnonzero(np.concatenate(([True], (later["doc"][1:] != later["doc"][:-1]) | (later["start"][1:] != later["start"][:-1] + 1))))
        last = np.concatenate((edge[1:], [len(later)])) - 1
        return found(later["doc"][edge], later["start"][edge], later["start"][last] + span, np.full(len(edge), -1), np.zeros(len(edge), np.int64))

    return bucket


def pieces(texts: DataFrame) -> DataFrame:
    """doc_id, text, base, copies: one row for each different text of an identifier, which begins at `base` in its document
    and is given `copies` times. Only identifiers that stand in several rows are grouped; the others are rows as they are.
    The texts of one identifier follow each other in the order of their 64-bit hashes."""
    again = cut(texts.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    plain = {"base": F.lit(0).cast("long"), "copies": F.lit(1).cast("long")}
    if again.isEmpty():
        return texts.withColumns(plain)
    several = texts.join(again, "doc_id").withColumn("salt", F.xxhash64("text")).groupBy("doc_id", "salt").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    place = running_total(several.select("doc_id", "salt", F.lit(1).alias("one")), ["doc_id", "salt"], "one", "rank")
    based = several.join(place.select("doc_id", "salt", F.shiftleft("rank", ROOM).alias("base")), ["doc_id", "salt"])
    return texts.join(again, "doc_id", "left_anti").withColumns(plain).unionByName(stash(based.select("doc_id", "text", "base", "copies"), "repeated-ids"))


def remove_repeats(docs: DataFrame, span: int = 100, buckets: int | None = None, bucket_bytes: int = 64 << 20, stretch: int = 2 << 20) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (maximal removed stretches), kept (remaining bytes), kept_sha256 of every row.

    A byte goes if a span-byte string that covers it also starts earlier (smaller doc_id, or same document and earlier
    start). Null text is empty; texts shorter than span keep all. doc_id is the identity of a document: rows without one
    are returned whole, and rows that repeat one count as stretches of one document, one after the other (no string spans two):
    of equal rows the first stays as it is, different texts follow each other in the order of their 64-bit hashes.

    There is a task for each bucket_bytes of text and four buckets a task, so what a bucket holds does not grow with the
    table. Texts are read in stretches of `stretch` bytes, which bounds the memory of a long one."""
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = pieces(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    able = texts.where(F.octet_length("text") >= span).where("doc_id is not null").select("doc_id", "text", "base")
    tasks = max(partitions, (able.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // bucket_bytes)
    buckets = buckets or max(96, 4 * tasks)
    shape = "doc_id long, start long, stop long, shift int, key long"
    runs = stash(able.mapInArrow(first_pass(span, buckets, stretch), OUT).repartition(tasks, "bucket").groupBy("bucket").applyInArrow(settle_runs(span), shape), "suffix-runs")
    base = F.shiftleft(F.shiftright("start", ROOM), ROOM).alias("base")
    open_ = runs.where("shift >= 0").groupBy("doc_id", base).agg(F.collect_list(F.struct("start", "stop", "key")).alias("runs"))
    bytes_ = able.join(open_, ["doc_id", "base"]).select("doc_id", "text", "base", "runs").mapInArrow(second_pass(span, buckets), OUT)
    windows = bytes_.repartition(tasks, "bucket").groupBy("bucket").applyInArrow(settle_windows(span), shape)
    gone = runs.where("shift < 0").unionByName(windows).groupBy("doc_id", base).agg(F.collect_list(F.struct("start", "stop")).alias("gone"))

    names = ("doc_id", "n_bytes", "n_removed", "spans", "kept", "kept_sha256")
    arrow = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("kept", pa.binary()), ("kept_sha256", pa.string())])

    def row(doc: int, raw: bytes, cuts: list[tuple[int, int]]) -> tuple:
        parts, at = [], 0
        for a, b in cuts:
            parts.append(raw[at:a])
            at = b
        kept = b"".join([*parts, raw[at:]])
        return doc, len(raw), len(raw) - len(kept), [{"start": a, "stop": b} for a, b in cuts], kept, hashlib.sha256(kept).hexdigest()

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({k: [r[i] for r in rows] for i, k in enumerate(names)}, schema=arrow)

    def finish(batches):
        for batch in batches:
            col = batch.to_pydict()
            rows = []
            for doc, text, base, copies, gone in zip(*(col[k] for k in ("doc_id", "text", "base", "copies", "gone")), strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                cuts = spans(np.array([g["start"] for g in gone], np.int64) - base, np.array([g["stop"] for g in gone], np.int64) - base) if gone else []
                rows.append(row(doc, raw, cuts))
                # Of a further copy every string starts earlier.
                later = row(doc, raw, [(0, len(raw))] if len(raw) >= span else []) if copies > 1 else None
                for at in range(0, copies - 1, 1024):
                    yield table([later] * min(1024, copies - 1 - at))
            yield table(rows)

    shape = "doc_id long, n_bytes long, n_removed long, spans array<struct<start: long, stop: long>>, kept binary, kept_sha256 string"
    return texts.join(gone, ["doc_id", "base"], "left").select("doc_id", "text", "base", "copies", "gone").mapInArrow(finish, shape)
