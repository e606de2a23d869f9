"""Quality rules: word and symbol counts, and compression bands.

A text is compressed with zstandard as a whole and in fixed chunks. Ratios (compressed / raw bytes) below a band are
repetitive, above it incompressible; the bands depend on length, since short inputs carry a frame and no history."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

#: (up to bytes, least ratio, largest ratio) of a whole document.
WHOLE_BANDS = ((512, 0.30, 1.02), (2048, 0.22, 0.85), (8192, 0.16, 0.78), (65536, 0.12, 0.74), (float("inf"), 0.08, 0.72))
#: The same of a chunk; a document goes if more than MOST_BAD of its chunks lie outside.
CHUNK_BANDS = ((512, 0.25, 1.02), (2048, 0.18, 0.85), (float("inf"), 0.14, 0.78))
CHUNK, MOST_BAD = 4096, 0.5
SYMBOLS = "#*$%&|<>"

SHAPE = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, bad_chunks long, n_chunks long"


def counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words. bytes.split() splits at exactly the six ASCII spaces."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    spaces = sum(text.count(c) for c in " \t\n\v\f\r")
    symbols = sum(text.count(c) for c in SYMBOLS)
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    repeated = 0
    grams = list(zip(words, words[1:], words[2:], strict=False))
    seen = Counter(grams)
    if len(seen) < len(grams):
        to = 0
        for i, g in enumerate(grams):
            if seen[g] > 1:
                repeated += i + 3 - max(i, to)
                to = i + 3
    return len(words), len(text) - spaces, symbols, len(lines) - len(set(lines)), repeated


def in_band(raw: int, packed: int, bands: tuple) -> bool:
    low, high = next((a, b) for most, a, b in bands if raw <= most)
    return low <= packed / raw <= high


def quality(docs: DataFrame, whole: tuple = WHOLE_BANDS, chunks: tuple = CHUNK_BANDS, chunk: int = CHUNK, most_bad: float = MOST_BAD, level: int = 3) -> DataFrame:
    """Counts and verdict of every row (SHAPE). Null and empty texts have no words, so they fail the base rule. Repeated
    rows come out each; further columns are not carried. A map over whole texts, without shuffle."""

    def setup():
        import zstandard

        return zstandard.ZstdCompressor(level=level)

    def each(c: dict, z) -> dict:
        out: dict = {"doc_id": c["doc_id"]} | {k.split()[0]: [] for k in SHAPE.split(", ")[1:]}
        for text in c["text"]:
            text = text or ""
            n, chars, symbols, dup, repeat = counts(text)
            failed = n < 50 or 100 * repeat > 50 * n
            raw = text.encode("utf-8", "surrogatepass")
            size = len(z.compress(raw))
            parts = [raw[i : i + chunk] for i in range(0, len(raw), chunk)]
            bad = sum(not in_band(len(p), len(z.compress(p)), chunks) for p in parts)
            good = bool(raw) and in_band(len(raw), size, whole) and bad <= most_bad * len(parts)
            row = (n, chars, symbols, dup, repeat, failed, not failed and good, size / len(raw) if raw else None, bad, len(parts))
            for k, v in zip(list(out)[1:], row, strict=True):
                out[k].append(v)
        return out

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), each, SHAPE, setup=setup)
