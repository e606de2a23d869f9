"""Language identification by a bidirectional gated recurrent network over bytes.

Two GRUs with soft-sign gates read a window of bytes, one from each end; every position gets language probabilities from
both states, and a document's are the mean over all its positions. A state is zero until the window's own first byte (from
that end), so padding is never read. Training is backpropagation through time in numpy on a bounded sample of windows;
prediction labels every byte of every text, in windows that overlap by MARGIN bytes on both sides."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, map_batches

WINDOW = 128
#: Bytes at a window's ends that are read for the states but labelled in the neighbouring window.
MARGIN = 16


def soft(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.abs(x))


def gate(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * soft(x)


@dataclass
class Net:
    """Per direction d in 0, 1: embed[d] (3H, 256), zr[d] (2H, H), cand[d] (H, H); out (languages, 2H), bias (languages, 1)."""

    langs: list[str]
    p: dict[str, np.ndarray]


def fresh(langs: list[str], hidden: int, rng: np.random.Generator) -> Net:
    p = {}
    for d in (0, 1):
        p[f"embed{d}"] = rng.standard_normal((3 * hidden, 256)).astype(np.float32) * 0.5
        p[f"zr{d}"] = rng.standard_normal((2 * hidden, hidden)).astype(np.float32) * 0.4
        p[f"cand{d}"] = rng.standard_normal((hidden, hidden)).astype(np.float32) * 0.4
    p["out"] = rng.standard_normal((len(langs), 2 * hidden)).astype(np.float32) * 0.3
    p["bias"] = np.zeros((len(langs), 1), np.float32)
    return Net(langs, p)


def states(p: dict, d: int, x: np.ndarray, mask: np.ndarray, keep: bool = False):
    """States (T, H, N) of direction d over bytes x (T, N), zero where mask (T, N) is 0; with keep, what backpropagation
    needs as well."""
    hidden = len(p[f"cand{d}"])
    steps, n = x.shape
    h = np.zeros((hidden, n), np.float32)
    out = np.empty((steps, hidden, n), np.float32)
    tape = []
    embed, zr, cand = p[f"embed{d}"], p[f"zr{d}"], p[f"cand{d}"]
    for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
        a = embed.take(x[t], axis=1)
        pre = a[: 2 * hidden] + zr @ h
        g = gate(pre)
        z, r = g[:hidden], g[hidden:]
        q = a[2 * hidden :] + cand @ (r * h)
        c = soft(q)
        new = (h + z * (c - h)) * mask[t]
        if keep:
            tape.append((t, h, pre, z, r, q, c))
        out[t] = h = new
    return (out, tape) if keep else out


def probabilities(p: dict, forward: np.ndarray, backward: np.ndarray) -> np.ndarray:
    """(languages, N) at one position."""
    hidden = len(forward)
    logit = p["out"][:, :hidden] @ forward + p["out"][:, hidden:] @ backward + p["bias"]
    e = np.exp(logit - logit.max(axis=0))
    return e / e.sum(axis=0)


def gradients(p: dict, x: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict]:
    """Mean weighted cross-entropy over positions, and its gradients by backpropagation through time."""
    hidden = len(p["cand0"])
    (hf, tf), (hb, tb) = states(p, 0, x, mask, True), states(p, 1, x, mask, True)
    g = {k: np.zeros_like(v) for k, v in p.items()}
    dh = [np.zeros_like(hf), np.zeros_like(hb)]
    scale = weight / max(float((mask * weight).sum()), 1e-9)
    loss = 0.0
    for t in range(len(x)):
        prob = probabilities(p, hf[t], hb[t])
        w = mask[t] * scale
        loss -= float((w * np.log(prob[y, np.arange(len(y))] + 1e-9)).sum())
        prob[y, np.arange(len(y))] -= 1
        d = (prob * w).astype(np.float32)
        g["out"][:, :hidden] += d @ hf[t].T
        g["out"][:, hidden:] += d @ hb[t].T
        g["bias"] += d.sum(axis=1, keepdims=True)
        dh[0][t], dh[1][t] = p["out"][:, :hidden].T @ d, p["out"][:, hidden:].T @ d
    for k, tape in ((0, tf), (1, tb)):
        carry = np.zeros_like(hf[0])
        zr, cand = p[f"zr{k}"], p[f"cand{k}"]
        rows = np.empty((len(x), 3 * hidden, x.shape[1]), np.float32)
        for t, h, pre, z, r, q, c in reversed(tape):
            up = (carry + dh[k][t]) * mask[t]
            dq = up * z / (1 + np.abs(q)) ** 2
            drh = cand.T @ dq
            dg = np.concatenate((up * (c - h), drh * h)) * (0.5 / (1 + np.abs(pre)) ** 2)
            g[f"cand{k}"] += dq @ (r * h).T
            g[f"zr{k}"] += dg @ h.T
            carry = up * (1 - z) + drh * r + zr.T @ dg
            rows[t, : 2 * hidden], rows[t, 2 * hidden :] = dg, dq
        at = x.ravel()
        flat = rows.transpose(1, 0, 2).reshape(3 * hidden, -1)
        for j in range(3 * hidden):
            g[f"embed{k}"][j] = np.bincount(at, flat[j], 256)
    return loss, g


def train(windows: list[tuple[str, bytes]], hidden: int = 8, steps: int = 350, batch: int = 192, rate: float = 0.02, seed: int = 5) -> Net:
    """Adam on windows (language, bytes). Languages weigh alike however many windows they have."""
    langs = sorted({lang for lang, _ in windows})
    rng = np.random.default_rng(seed)
    net = fresh(langs, hidden, rng)
    if len(langs) < 2:
        return net
    x, length = as_matrix([w for _, w in windows], WINDOW)
    y = np.array([langs.index(lang) for lang, _ in windows])
    weight = (len(y) / len(langs) / np.bincount(y, minlength=len(langs)))[y]
    m1, m2 = ({k: np.zeros_like(v) for k, v in net.p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        pick = rng.integers(0, len(y), batch)
        mask = (np.arange(WINDOW)[:, None] < length[pick]).astype(np.float32)
        _, g = gradients(net.p, x[:, pick], mask, y[pick], weight[pick].astype(np.float32))
        norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
        now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, v in g.items():
            v = v / max(1.0, norm)
            m1[k] = 0.9 * m1[k] + 0.1 * v
            m2[k] = 0.99 * m2[k] + 0.01 * v * v
            net.p[k] -= (now * m1[k] / (1 - 0.9**step) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def as_matrix(windows: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes as (width, n), padded with zeros, and each window's length."""
    length = np.array([len(w) for w in windows], np.int64)
    x = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in windows), np.uint8).reshape(-1, width)
    return np.ascontiguousarray(x.T), length


def window_sums(net: Net, windows: list[bytes], first: list[int], last: list[int]) -> np.ndarray:
    """(windows, languages): position probabilities summed over the places first <= t < last of each window."""
    x, length = as_matrix(windows, WINDOW)
    mask = (np.arange(WINDOW)[:, None] < length).astype(np.float32)
    back, front = states(net.p, 1, x, mask), states(net.p, 0, x, mask)
    lo, hi = np.array(first), np.array(last)
    total = np.zeros((len(net.langs), len(windows)), np.float32)
    for t in range(len(x)):
        total += probabilities(net.p, front[t], back[t]) * ((lo <= t) & (t < hi))
    return total.T


def cut_up(size: int) -> list[tuple[int, int, int, int]]:
    """(start, stop, first, last) of the windows of a text of so many bytes: window [start, stop) labels its places first to
    last, and every byte is labelled once."""
    step = WINDOW - 2 * MARGIN
    out = []
    for at in range(0, size, step):
        start = max(at - MARGIN, 0)
        out.append((start, min(at + step + MARGIN, size), at - start, min(at + step, size) - start))
    return out


def training_windows(docs: DataFrame, most: int = 6000) -> list[tuple[str, bytes]]:
    """(lang, bytes) windows of at most `most` documents with a language outside fold 2, chosen by hash of doc_id: three
    windows of WINDOW characters from each, at its start, a third and two thirds in. The bound is this parameter. Rows that repeat
    a doc_id are ordered by language and windows, so that the sample doesn't depend on partitions."""
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))
    usable = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (fold != 2) & (F.length("text") > 0))
    at = [F.substring("text", (F.length("text") * i / 3).cast("int") + 1, F.lit(WINDOW)) for i in range(3)]
    rows = bounded_sample(usable.select("doc_id", "lang", F.array(*at).alias("w")), "doc_id", most, ("lang", "w")).select("lang", "w").collect()
    return [(r["lang"], w.encode("utf-8", "surrogatepass")[:WINDOW]) for r in rows for w in r["w"] if w]


def identify(docs: DataFrame, net: Net, group: int = 2048) -> DataFrame:
    """doc_id, lang_pred, score of every row, over its whole text. `und` with score 0 where the text is null or has no
    letter, or nothing was learned. Repeated rows come out each, a null doc_id is kept, no rows give none; further columns
    are not carried. No shuffle. The longest text needs no more memory than `group` windows."""

    def each(c: dict) -> dict:
        texts = c["text"]
        totals = np.zeros((len(texts), max(len(net.langs), 1)))
        size = np.zeros(len(texts))
        waiting: list[bytes] = []
        owner: list[int] = []
        first: list[int] = []
        last: list[int] = []

        def flush() -> None:
            if waiting:
                np.add.at(totals, np.array(owner), window_sums(net, waiting, first, last))
                for kept in (waiting, owner, first, last):
                    kept.clear()

        clear = [bool(net.langs and t and any(ch.isalpha() for ch in t)) for t in texts]
        for i, t in enumerate(texts):
            if clear[i]:
                raw = t.encode("utf-8", "surrogatepass")
                size[i] = len(raw)
                for start, stop, a, b in cut_up(len(raw)):
                    waiting.append(raw[start:stop])
                    owner.append(i)
                    first.append(a)
                    last.append(b)
                    if len(waiting) == group:
                        flush()
        flush()
        best = totals.argmax(axis=1)
        score = [float(min(totals[i, b] / size[i], 1.0)) if clear[i] else 0.0 for i, b in enumerate(best)]
        return {"doc_id": c["doc_id"], "lang_pred": [net.langs[b] if clear[i] else "und" for i, b in enumerate(best)], "score": score}

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), each, "doc_id long, lang_pred string, score double", rows=256)
