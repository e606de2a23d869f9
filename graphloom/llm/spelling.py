"""Grouping of spelling variants by search schemes over bidirectional FM-indexes of the vocabulary.

Two words are near if one inserted, deleted or replaced code point makes them equal. A near word keeps at least one half
of the query whole, so a search matches either half exactly and extends across the other, allowing one error:

1. Words are counted over all documents; those long and frequent enough are the vocabulary.
2. Whatever shares a query's left half shares its first two code points, whatever shares its right half its last three:
   words meet in a cell for each, and a cell indexes its words. Keys of very many words are dealt over a grid of cells,
   blocks of indexed words by slices of queries, so no cell grows with the vocabulary.
3. A cell counts the near words of each of its queries and finds the best; only these sums leave it.
4. Forms are followed to their last by joins that double the distance each round."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, stash

#: Letters as UTF-8: A-Z, a-z and U+00C0 to U+00FF.
LETTERS = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\xbf])+")
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
HEAD, TAIL = 2, 3


def count_words(docs: DataFrame, noise: int = 97, flush: int = 200_000) -> DataFrame:
    """word, n: lower-cased (A-Z only) runs of letters of all texts. Where `noise` divides the crc32 of `<doc_id>:<run>`,
    the run's code point crc32 % length is deleted (noise 0: never); a text without doc_id keeps its runs. Counts leave a task
    summed, at most `flush` words at a time."""

    def run(batches):
        counts: Counter[bytes] = Counter()

        def rows():
            keys = list(counts)
            out = pa.RecordBatch.from_arrays([pa.array([k.decode() for k in keys], pa.string()), pa.array([counts[k] for k in keys], pa.int64())], names=["word", "n"])
            counts.clear()
            return out

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = Counter(LETTERS.findall((text or "").encode("utf-8", "surrogatepass").translate(LOWER)))
                seed = zlib.crc32(f"{doc}:".encode())
                for word, n in own.items():
                    h = zlib.crc32(word, seed)
                    if noise and doc is not None and h % noise == 0:
                        letters = word.decode()
                        at = h % len(letters)
                        word = (letters[:at] + letters[at + 1 :]).encode()
                    counts[word] += n
                if len(counts) >= flush:
                    yield rows()
        yield rows()

    counted = docs.select("doc_id", "text").where("text is not null").mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def rotations(text: np.ndarray) -> np.ndarray:
    """The order of the rotations of a text that is no repetition of a shorter one; symbols are below 128. The first eight
    symbols are compared at once, then the known distance doubles."""
    rank, size = text.astype(np.int64), 1
    while size < 8:
        rank = (rank << (7 * size)) | np.roll(rank, -size)
        size *= 2
    order = np.argsort(rank, kind="stable")
    while True:
        ordered = rank[order]
        place = np.cumsum(np.concatenate(([0], ordered[1:] != ordered[:-1])))
        if place[-1] == len(text) - 1:
            return order
        rank = np.empty(len(text), np.int64)
        rank[order] = place
        rank = rank * len(text) + np.roll(rank, -size)
        order = np.argsort(rank, kind="stable")
        size *= 2


class Ranks:
    """The Burrows-Wheeler transform of one direction, with the number of smaller symbols before each 32nd place."""

    def __init__(self, text: np.ndarray, symbols: int) -> None:
        order = rotations(text)
        last = text[order - 1]
        blocks = len(text) // 32 + 1
        padded = np.full(blocks * 32, symbols, np.uint8)
        padded[: len(last)] = last
        self.rows = padded.reshape(blocks, 32)
        counts = np.bincount((np.arange(len(last)) >> 5) * symbols + last, minlength=blocks * symbols).reshape(blocks, symbols)
        smaller = np.zeros((blocks, symbols + 1), np.int32)
        smaller[1:, 1:] = np.cumsum(np.cumsum(counts, axis=0), axis=1)[:-1]
        self.smaller, self.symbols = smaller, symbols
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=symbols))))

    def before(self, symbol: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the transform up to each place: how many symbols are smaller, and how many equal."""
        at = place >> 5
        rows = np.where(np.arange(32) < (place & 31)[:, None], self.rows[at], 255)
        small = self.smaller[at, symbol] + (rows < symbol[:, None]).sum(1)
        upto = self.smaller[at, symbol + 1] + (rows <= symbol[:, None]).sum(1)
        return small, upto - small

    def all_before(self, place: np.ndarray) -> np.ndarray:
        """How many symbols are smaller than each symbol (columns 0 to symbols), up to each place."""
        at = place >> 5
        inside = np.arange(32) < (place & 31)[:, None]
        who, col = np.nonzero(inside)
        counts = np.bincount(who * (self.symbols + 1) + self.rows[at[who], col] + 1, minlength=len(place) * (self.symbols + 1)).reshape(len(place), -1)[:, : self.symbols + 1]
        return self.smaller[at] + np.cumsum(counts, axis=1)


class Index:
    """Bidirectional FM-index of distinct words, sorted, each after a delimiter (symbol 0).

    A state is an interval of suffix ranks in the text and in its mirror image: (low, mirrored low, size). Extending to the
    right narrows the mirrored interval by its transform and moves the other by the number of smaller symbols; to the left the
    other way round. A whole word between delimiters is one suffix, whose rank is the word's place in the sorted list."""

    def __init__(self, words: list[str], alphabet: str) -> None:
        self.code = np.zeros(max(map(ord, alphabet), default=0) + 1, np.uint8)
        self.code[[ord(c) for c in alphabet]] = np.arange(1, len(alphabet) + 1)
        self.text = np.concatenate([np.zeros(1, np.uint8), self.coded("\0".join(words))])
        self.starts = np.concatenate(([1], np.cumsum([len(w) + 1 for w in words])[:-1] + 1)).astype(np.int64)
        symbols = len(alphabet) + 1
        self.size, self.symbols = len(self.text), symbols
        self.left, self.right = Ranks(self.text, symbols), Ranks(self.text[::-1], symbols)

    def coded(self, text: str) -> np.ndarray:
        return self.code[np.frombuffer(text.encode("utf-32-le"), "<u4")]

    def extend(self, state: np.ndarray, symbol: np.ndarray, right: bool) -> np.ndarray:
        """The states (3, n) extended by one symbol each; size 0 where there is none."""
        side, own, other = (self.right, 1, 0) if right else (self.left, 0, 1)
        small, equal = side.before(symbol, state[own])
        small_end, equal_end = side.before(symbol, state[own] + state[2])
        out = np.empty_like(state)
        out[own] = side.first[symbol] + equal
        out[other] = state[other] + small_end - small
        out[2] = equal_end - equal
        return out

    def children(self, state: np.ndarray, right: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Every extension by one letter (no delimiter) that occurs: which state it comes from, its symbol, its state."""
        side, own, other = (self.right, 1, 0) if right else (self.left, 0, 1)
        low, high = side.all_before(state[own]), side.all_before(state[own] + state[2])
        many = np.diff(high - low, axis=1)
        many[:, 0] = 0
        who, symbol = np.nonzero(many)
        out = np.empty((3, len(who)), np.int64)
        out[own] = side.first[symbol] + np.diff(low, axis=1)[who, symbol]
        out[other] = state[other][who] + (high - low)[who, symbol]
        out[2] = many[who, symbol]
        return who, symbol, out

    def near(self, queries: np.ndarray, right: bool) -> tuple[np.ndarray, np.ndarray]:
        """Of queries of one length (n, length) in symbols: (query, rank) of indexed words that keep the query's left half
        (right: the error is sought to the right) or its right half, and differ by one error in the other; each pair once."""
        n, length = queries.shape
        half = length // 2
        zero = np.zeros(n, np.int64)
        steps = [zero, *queries[:, :half].T.astype(np.int64)] if right else [zero, *queries[:, half:].T[::-1].astype(np.int64)]
        rest = [*queries[:, half:].T.astype(np.int64), zero] if right else [*queries[:, :half].T[::-1].astype(np.int64), zero]
        who = np.arange(n)
        state = np.vstack([np.zeros((2, n), np.int64), np.full(n, self.size)])
        for symbol in steps:
            state = self.extend(state, symbol[who], right)
            live = state[2] > 0
            state, who = state[:, live], who[live]
        # by how much of `rest` is matched: states without and with the error
        bad: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty((3, 0), np.int64)) for _ in range(len(rest) + 1)]

        def put(at: int, owner: np.ndarray, states: np.ndarray) -> None:
            bad[at] = (np.concatenate((bad[at][0], owner)), np.hstack((bad[at][1], states)))

        for at in range(len(rest)):
            if len(who):
                parent, symbol, child = self.children(state, right)
                put(at, who[parent], child)  # inserted
                if at < len(rest) - 1:
                    other = symbol != rest[at][who[parent]]
                    put(at + 1, who[parent][other], child[:, other])  # replaced
                    put(at + 1, who, state)  # deleted
                    same = ~other
                    state, who = child[:, same], who[parent][same]
            owner, states = bad[at]
            if len(owner) > 8 * n:  # runs of one letter: errors at different places make the same string
                owner, *states = np.unique(np.vstack((owner, states)), axis=1)
                states = np.array(states)
            if not len(who) and not len(owner) and not len(bad[at + 1][0]):
                continue
            if len(owner):
                states = self.extend(states, rest[at][owner], right)
                live = states[2] > 0
                put(at + 1, owner[live], states[:, live])
        owner, states = bad[len(rest)]
        pair = np.unique(owner * np.int64(len(self.starts)) + states[0])
        return pair // len(self.starts), pair % len(self.starts)

    def same_head(self, queries: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Whether the indexed words begin with the left half of the queries, row by row."""
        half = queries.shape[1] // 2
        at = np.minimum(self.starts[rank][:, None] + np.arange(half), self.size - 1)
        return (self.text[at] == queries[:, :half]).all(1)


CELL = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])


def search_cell(table: pa.Table) -> pa.Table:
    """Of a cell's queries: how many near words it indexes, and the most frequent of them (ties: the smallest). The cells by last
    letters leave out words that the other cells find."""
    col = table.to_pydict()
    right = col["side"][0] == 0
    indexed = sorted((w, n) for w, n, i in zip(col["word"], col["n"], col["indexed"], strict=True) if i)
    asked = [w for w, q in zip(col["word"], col["asked"], strict=True) if q]
    if not indexed or not asked:
        return CELL.empty_table()
    words, n = [w for w, _ in indexed], np.array([k for _, k in indexed], np.int64)
    index = Index(words, "".join(sorted(set("".join(words)).union("".join(asked)))))
    by_length: dict[int, list[str]] = {}
    for w in asked:
        by_length.setdefault(len(w), []).append(w)
    out: list[tuple] = []
    for length, group in by_length.items():
        for at in range(0, len(group), step := max(1, 80_000 // length)):
            part = group[at : at + step]
            queries = index.coded("".join(part)).reshape(len(part), length)
            who, rank = index.near(queries, right)
            if not right:
                new = ~index.same_head(queries[who], rank)
                who, rank = who[new], rank[new]
            order = np.lexsort((rank, -n[rank], who))
            who, rank = who[order], rank[order]
            first = np.flatnonzero(np.concatenate(([True], who[1:] != who[:-1]))) if len(who) else np.empty(0, np.int64)
            many = np.diff(np.concatenate((first, [len(who)])))
            out += zip((part[i] for i in who[first]), many.tolist(), n[rank[first]].tolist(), (words[r] for r in rank[first]), strict=True)
    return pa.Table.from_pydict({f.name: [r[i] for r in out] for i, f in enumerate(CELL)}, schema=CELL)


def near_words(vocabulary: DataFrame, cell: int = 40_000, most: int = 200_000) -> DataFrame:
    """word, n_near, best_n, best of words that have near ones in vocabulary (word, n; distinct, at least five code points).

    A cell holds some `cell` words; a key with more than `most` words is cut into blocks, and its cells are every block of
    indexed words with every slice of queries. At most 2 / most of the vocabulary are such keys: a broadcast of that bound."""
    word = F.col("word")
    sides = F.array(F.struct(F.lit(0).alias("side"), F.substring(word, 1, HEAD).alias("key")), F.struct(F.lit(1).alias("side"), F.substring(word, -TAIL, TAIL).alias("key")))
    entries = vocabulary.select("word", "n", F.explode(sides).alias("s")).select("word", "n", "s.side", "s.key")
    counts = entries.groupBy("side", "key").agg(F.count("*").alias("many"))
    large = cut(counts.where(F.col("many") > most).select("side", "key", F.ceil(F.col("many") / most).cast("int").alias("blocks")))
    total = vocabulary.count()
    bins = max(4, -(-total // cell))
    own = F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")
    grid = F.when(F.col("blocks").isNull(), F.array(F.struct(F.lit(0).alias("block"), F.lit(0).alias("slice")))).otherwise(
        F.array_distinct(F.concat(
            F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda s: F.struct(own.alias("block"), s.alias("slice"))),
            F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.struct(b.alias("block"), own.alias("slice"))),
        ))
    )
    dealt = entries.join(F.broadcast(large), ["side", "key"], "left").withColumn("g", F.explode(grid))
    hot = F.col("blocks").isNotNull()
    cells = dealt.select(
        "side", F.when(hot, F.col("key")).otherwise(F.pmod(F.xxhash64("key"), F.lit(bins)).cast("string")).alias("bin"), hot.alias("hot"), "g.block", "g.slice",
        "word", "n", (~hot | (own == F.col("g.block"))).alias("indexed"), (~hot | (own == F.col("g.slice"))).alias("asked"),
    )
    # As many partitions as cells, else small ones are put together by their bytes, which say little about their searches.
    by = ["side", "hot", "bin", "block", "slice"]
    found = cells.repartition(2 * bins, *by).groupBy(*by).applyInArrow(lambda t: search_cell(t), "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("form")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.less")).alias("best_n"), F.col("b.form").alias("best"))


def last_forms(forms: DataFrame) -> DataFrame:
    """word, root of (word, form): forms followed to the last, null being the end. Each round doubles the distance, and a
    form is more frequent than its word, so rounds are few; they end when nothing changes."""
    state = forms.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        state = cut(state)
        ahead = state.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = state.join(ahead, "root")
        if moved.isEmpty():
            return state
        state = state.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"))


def group_variants(docs: DataFrame, least: int = 3, letters: int = 5, ratio: int = 2, noise: int = 97) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of at least `letters` code points and `least` occurrences.

    form is the near word of largest n (ties: smallest), if its n is at least `ratio` times the word's; root the last form.
    Null texts have no words; rows that repeat a document count again; an empty table gives no rows. The time of a cell grows
    with its longest word, which is searched letter by letter. letters must be 5 or more and ratio above 1."""
    if letters < HEAD + TAIL or ratio <= 1:
        raise ValueError("letters must be 5 or more, ratio above 1")
    vocabulary = stash(count_words(docs, noise).where((F.length("word") >= letters) & (F.col("n") >= least)), "vocabulary")
    near = near_words(vocabulary)
    ok = F.col("best_n") >= ratio * F.col("n")
    formed = stash(
        vocabulary.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(ok, F.col("best")).alias("form"), F.when(ok, F.col("best_n")).alias("form_n")), "forms"
    )
    return formed.join(last_forms(formed), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
