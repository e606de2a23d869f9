"""Packing documents into training sequences along a space-filling curve.

A document's token ids are hashed into a vector, which a fixed random projection takes to a few dimensions; its Hilbert
key orders documents so that neighbours on the curve have similar words. The documents are then laid end to end along the
curve and cut at every `length` tokens, so that only the last sequence needs padding."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, running_total, stash

PIECE = "row_id long, doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """Keys along a Hilbert curve of points (n, dimensions) with integer coordinates of `bits` bits.

    From the highest bit down, each level reads which half a point lies in along every axis; later levels see the cell
    reflected or with two axes exchanged, so that the curve's pieces join. The bits are then Gray-decoded into the key."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for d in range(dims):
            upper = (x[d] >> level) & 1 == 1
            swap = np.where(upper, 0, (x[0] ^ x[d]) & low)
            x[0] = np.where(upper, x[0] ^ low, x[0] ^ swap)
            x[d] ^= swap
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    carry = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        carry ^= np.where((x[-1] >> level) & 1 == 1, (1 << level) - 1, 0)
    x ^= carry
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for d in range(dims):
            key = (key << 1) | ((x[d] >> level) & 1)
    return key


class Encoder:
    """Token ids of the given tokenizer file plus the end id. The ranks file of the same vocabulary, where given, yields
    the same ids several times faster; texts then keep the tokenizer's own treatment of its special token. A text that the
    fast encoder refuses (its pattern's stack overflows on very long runs of white space) is given to the tokenizer."""

    def __init__(self, tokenizer: str, ranks: str | None, pattern: str | None, end: int) -> None:
        self.end, self.fast, self.slow, self.tokenizer = end, None, None, tokenizer
        if ranks:
            import base64

            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={"<|endoftext|>": len(table)})

    def slowly(self, text: str) -> list[int]:
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.tokenizer)
        return self.slow.encode(text, add_special_tokens=False).ids

    def ids(self, text: str) -> list[int]:
        if self.fast is None:
            return self.slowly(text)
        try:
            return self.fast.encode(text, allowed_special="all")
        except ValueError:
            return self.slowly(text)

    def __call__(self, text: str | None) -> np.ndarray:
        return np.array([*(self.ids(text) if text else ()), self.end], np.uint32)


def public_encoder(end: int = 1):
    """A function that makes the encoder of the installed byte_bpe_50k vocabulary on an executor."""

    def make() -> Encoder:
        import public_tokenizers as P

        return Encoder(P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN, end)

    return make


def tokenized(docs: DataFrame, encoder, dims: int, bits: int, features: int, seed: int) -> DataFrame:
    """row_id, doc_id, n (tokens), curve (Hilbert key), ids (little-endian, 16 bits where they fit, else 32)."""

    def setup():
        rng = np.random.default_rng(seed)
        vocabulary = 1 << 17
        return encoder(), rng.integers(0, features, vocabulary), rng.choice([-1.0, 1.0], vocabulary), rng.standard_normal((dims, features))

    def each(c: dict, tools: tuple) -> dict:
        encode, bucket, sign, project = tools
        points, n, packed = [], [], []
        for text in c["text"]:
            ids = encode(text)
            vector = np.bincount(bucket[ids % len(bucket)], sign[ids % len(bucket)], features)
            points.append(project @ (vector / max(float(np.linalg.norm(vector)), 1e-9)))
            n.append(len(ids))
            packed.append(ids.astype("<u2").tobytes() if ids.max() < 65536 else b"\x00" + ids.astype("<u4").tobytes())
        side = 1 << bits
        cells = np.clip(((np.tanh(np.array(points).reshape(-1, dims)) + 1) / 2 * side).astype(np.int64), 0, side - 1)
        return {"row_id": c["row_id"], "doc_id": c["doc_id"], "n": n, "curve": hilbert_key(cells, bits), "ids": packed}

    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_batches(rows, each, "row_id long, doc_id long, n long, curve long, ids binary", setup=setup)


def pack(docs: DataFrame, length: int = 2048, encoder=None, dims: int = 3, bits: int = 12, features: int = 256, seed: int = 17) -> DataFrame:
    """Pieces of documents: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    Null text counts as empty, and an empty document is its end id alone. Every row is packed, repeated ones too (row_id
    tells them apart). Documents of equal key stand in the order of doc_id, then of a hash of their tokens, so that the
    order doesn't depend on files or partitions; only equal rows are told apart by row_id. A null doc_id comes first among
    equal keys. No rows give no pieces. Tokens are written once to the shared folder; order and running totals use only identifiers, keys and counts."""
    tokens = stash(tokenized(docs, encoder or public_encoder(), dims, bits, features, seed), "tokens")
    place = running_total(tokens.select("row_id", "curve", "n", "doc_id", F.xxhash64("ids").alias("digest")), ["curve", "doc_id", "digest", "row_id"], "n", "_at").select("row_id", "_at")

    def each(c: dict) -> dict:
        out: dict = {k: [] for k in ("row_id", "doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")}
        for row, doc, n, raw, at in zip(c["row_id"], c["doc_id"], c["n"], c["ids"], c["_at"], strict=True):
            ids = np.frombuffer(raw, "<u4", offset=1) if len(raw) % 2 else np.frombuffer(raw, "<u2").astype("<u4")
            start = 0
            while start < n:
                sequence, offset = divmod(at + start, length)
                size = min(length - offset, n - start)
                for k, v in zip(out, (row, doc, start, size, ids[start : start + size].tobytes(), n, sequence, offset), strict=True):
                    out[k].append(v)
                start += size
        return out

    return map_batches(tokens.select("row_id", "doc_id", "n", "ids").join(place, "row_id"), each, PIECE)
