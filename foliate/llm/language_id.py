"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads segments of SEGMENT bytes in both directions, with CONTEXT bytes more on
either side from which the states start, gives every byte a
probability for each language, and a document the mean over all its bytes. It is
written and trained here in numpy, by backpropagation through time and Adam, on a
bounded sample of labelled texts; gates are hard sigmoids, candidates softsigns, both
cheap and differentiable almost everywhere. Prediction runs in Arrow batches with a
fixed number of segments at a time, so memory does not grow with a text.

Null text, or one without a letter: ``und`` with score 0. Without labelled texts all
are ``und``. Repeated rows are predicted alike; other columns are ignored. A row without
doc_id is not learned from, and its ``held_out`` is null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliate.llm.common import byte_view, read, slices, texts

#: Bytes of a segment and of its surroundings, hidden units a direction, segments computed together.
SEGMENT, CONTEXT, HIDDEN, BLOCK = 128, 16, 8, 2048
#: Labelled texts to learn from at most, chosen by a hash of doc_id, and characters of each of two windows of them (start and middle), of which the first SEGMENT bytes are used.
MAX_LABELLED, WINDOW = 4_000, 128


def hard_sigmoid(x: np.ndarray) -> np.ndarray:
    x *= 0.2
    x += 0.5
    return np.clip(x, 0, 1, out=x)


class Direction:
    """One gated recurrent layer: byte table ``wx`` (256 x 3H: update, reset, candidate), recurrent ``u``, candidate bias ``b``."""

    def __init__(self, p: dict[str, np.ndarray], name: str):
        self.wx, self.u, self.b = p["wx" + name], p["u" + name], p["b" + name]

    def run(self, x: np.ndarray, mask: np.ndarray | None, back: bool, keep: list | None = None) -> np.ndarray:
        """Hidden states (T x B x H) over bytes x (T x B); where mask (T x B) is 0 the state is zero."""
        (steps, n), h_ = x.shape, self.u.shape[0]
        out = np.empty((steps, n, h_), np.float32)
        h = np.zeros((n, h_), np.float32)
        gx, gh = np.empty((n, 3 * h_), np.float32), np.empty((n, 3 * h_), np.float32)
        for t in range(steps - 1, -1, -1) if back else range(steps):
            np.take(self.wx, x[t], axis=0, out=gx, mode="clip")
            np.matmul(h, self.u, out=gh)
            zr = hard_sigmoid(gx[:, : 2 * h_] + gh[:, : 2 * h_])
            z, r = zr[:, :h_], zr[:, h_:]
            q = gh[:, 2 * h_ :] + self.b
            a = r * q
            a += gx[:, 2 * h_ :]
            c = a / (np.abs(a) + 1)
            new = h - c
            new *= z
            new += c
            if mask is not None:
                new *= mask[t][:, None]
            if keep is not None:
                keep.append((t, h, z, r, q, c))
            out[t] = h = new
        return out

    def gradients(self, x: np.ndarray, kept: list, dout: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backpropagation through time: of ``wx, u, b`` from the states' gradients (masks of 1)."""
        h_ = self.u.shape[0]
        du, db, dg = np.zeros_like(self.u), np.zeros_like(self.b), np.zeros((*x.shape, 3 * h_), np.float32)
        carry = np.zeros_like(dout[0])
        for t, h, z, r, q, c in reversed(kept):
            d = dout[t] + carry
            da = d * (1 - z) * (1 - np.abs(c)) ** 2
            dz = d * (h - c) * 0.2 * ((z > 0) & (z < 1))
            dr = da * q * 0.2 * ((r > 0) & (r < 1))
            dq = da * r
            dg[t] = np.concatenate([dz, dr, da], 1)
            dgh = np.concatenate([dz, dr, dq], 1)
            du += h.T @ dgh
            db += dq.sum(0)
            carry = d * z + dgh @ self.u.T
        flat, rows = dg.reshape(-1, 3 * h_), x.reshape(-1)
        dwx = np.stack([np.bincount(rows, flat[:, j], 256) for j in range(3 * h_)], 1).astype(np.float32)
        return dwx, du, db


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(-1, keepdims=True))
    return x / x.sum(-1, keepdims=True)


def new_parameters(classes: int, hidden: int = HIDDEN, seed: int = 3) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    p: dict[str, np.ndarray] = {}
    for d in "fb":
        p["wx" + d] = rng.normal(0, 0.5, (256, 3 * hidden))
        p["u" + d] = rng.normal(0, hidden**-0.5, (hidden, 3 * hidden))
        p["b" + d] = np.zeros(hidden)
    p["wo"], p["bo"] = rng.normal(0, 0.3, (2 * hidden, classes)), np.zeros(classes)
    return {k: v.astype(np.float32) for k, v in p.items()}


def loss_and_gradients(p: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross-entropy over all positions of x (T x B) with labels y (B)."""
    layers, kept = {d: Direction(p, d) for d in "fb"}, {"f": [], "b": []}
    hidden = np.concatenate([layers[d].run(x, None, d == "b", kept[d]) for d in "fb"], 2)
    prob = softmax(hidden @ p["wo"] + p["bo"])
    at = np.arange(x.shape[1])
    loss = -np.log(np.maximum(prob[:, at, y], 1e-9)).mean()
    prob[:, at, y] -= 1
    prob /= x.size
    g = {"wo": np.einsum("tbh,tbc->hc", hidden, prob), "bo": prob.sum((0, 1))}
    dh, n = prob @ p["wo"].T, p["uf"].shape[0]
    for d, part in (("f", dh[..., :n]), ("b", dh[..., n:])):
        g["wx" + d], g["u" + d], g["b" + d] = layers[d].gradients(x, kept[d], part)
    return float(loss), g


def train(segments: np.ndarray, labels: np.ndarray, classes: int, steps: int = 220, batch: int = 160, rate: float = 0.03, seed: int = 3) -> dict[str, np.ndarray]:
    """Parameters fitted to segments (N x T bytes) and their labels by Adam."""
    p = new_parameters(classes, seed=seed)
    rng = np.random.default_rng(seed)
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in "mv")
    for i in range(1, steps + 1):
        pick = rng.integers(0, len(segments), batch)
        _, g = loss_and_gradients(p, np.ascontiguousarray(segments[pick].T), labels[pick])
        now = rate * min(1, 3 * (1 - i / (steps + 1)))
        for k in p:
            d = np.clip(g[k], -1, 1)
            m[k] = 0.9 * m[k] + 0.1 * d
            v[k] = 0.98 * v[k] + 0.02 * d * d
            p[k] = (p[k] - now * (m[k] / (1 - 0.9**i)) / (np.sqrt(v[k] / (1 - 0.98**i)) + 1e-8)).astype(np.float32)
    return p


def position_probabilities(p: dict[str, np.ndarray], x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Probabilities (T x B x C) of every position of x (B x T bytes); beyond a segment's size they are 0."""
    x = np.ascontiguousarray(x.T)
    mask = None
    if (sizes < len(x)).any():
        mask = (np.arange(len(x))[:, None] < sizes[None, :]).astype(np.float32)
    hidden = np.concatenate([Direction(p, d).run(x, mask, d == "b") for d in "fb"], 2)
    prob = softmax(hidden @ p["wo"] + p["bo"])
    return prob if mask is None else prob * mask[..., None]


def document_probabilities(p: dict[str, np.ndarray], raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Mean over each text's positions (rows x C); zeros for an empty text."""
    lengths = np.diff(offsets)
    count = -(-lengths // SEGMENT)
    rows = np.repeat(np.arange(len(lengths)), count)
    first = np.cumsum(count) - count
    starts = offsets[rows] + (np.arange(len(rows)) - first[rows]) * SEGMENT
    ends = np.minimum(starts + SEGMENT, offsets[rows + 1])
    lo = np.maximum(starts - CONTEXT, offsets[rows])  # inside the text
    sizes = np.minimum(ends + CONTEXT, offsets[rows + 1]) - lo
    width = SEGMENT + 2 * CONTEXT
    order = np.argsort(-sizes, kind="stable")  # full segments first: they need no mask
    padded = np.concatenate([raw, np.zeros(width, np.uint8)])
    out = np.zeros((len(lengths), len(p["bo"])))
    place = np.arange(width)[:, None]
    for i in range(0, len(order), BLOCK):
        at = order[i : i + BLOCK]
        x = padded[lo[at][:, None] + np.arange(width)]
        own = (place >= starts[at] - lo[at]) & (place < ends[at] - lo[at])  # surroundings belong to other segments
        np.add.at(out, rows[at], np.einsum("tbc,tb->bc", position_probabilities(p, x, sizes[at]), own.astype(np.float32)))
    return out / np.maximum(lengths, 1)[:, None]


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def learn(docs: DataFrame, limit: int = MAX_LABELLED) -> tuple[list[str], dict[str, np.ndarray]] | None:
    """Languages and parameters, from at most ``limit`` labelled texts outside the held-out part."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text").where(F.col("lang").isNotNull() & (F.length("text") > 0) & ~held_out(F.col("doc_id")))
    middle = F.greatest(F.lit(1), (F.length("text") / 2).cast("int"))
    # a hash leaves a few more than the limit, so that each task sends few rows, and only their windows
    slots = 1 << 30
    share = 1.3 * limit / max(1, rows.count())
    few = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(slots)) < min(1.0, share) * slots)
    few = few.select("doc_id", "lang", F.substring(F.col("text"), F.lit(1), F.lit(WINDOW)).alias("a"), F.substring(F.col("text"), middle, F.lit(WINDOW)).alias("b"))
    sample = few.orderBy(F.xxhash64("doc_id"), "doc_id", "a", "b").limit(limit).collect()
    if not sample:
        return None
    langs = sorted({r["lang"] for r in sample})
    parts, labels = [], []
    for r in sample:
        for t in (r["a"], r["b"]):
            data = np.frombuffer(t.encode(), np.uint8)
            reps = np.resize(data, max(SEGMENT, len(data)))  # a short text is repeated
            parts.append(reps[:SEGMENT])
            labels.append(langs.index(r["lang"]))
    return langs, train(np.stack(parts), np.array(labels), len(langs))


def identify(docs: DataFrame, model: tuple[list[str], dict[str, np.ndarray]] | None) -> DataFrame:
    """``doc_id, lang_pred, score`` of every row of ``docs(doc_id, text)``."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # some 60 kB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 19):
            has_letter = [any(map(str.isalpha, t)) for t in batch.column("text").to_pylist()]
            if held.value is None:
                pred, score = ["und"] * batch.num_rows, [0.0] * batch.num_rows
            else:
                langs, p = held.value
                prob = document_probabilities(p, *byte_view(batch.column("text")))
                best = prob.argmax(1)
                pred = [langs[b] if ok else "und" for b, ok in zip(best, has_letter)]
                score = np.clip(np.where(has_letter, prob.max(1), 0.0), 0, 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return texts(docs).mapInArrow(run, "doc_id long, lang_pred string, score double")


def op4_bigru_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return identify(docs, learn(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
