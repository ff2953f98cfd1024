"""Text quality by a byte-level convolutional network in numpy.

Bytes are embedded, learned filters slide over all positions of a document, and
each filter's response is max-pooled over overlapping chunks that together cover
the whole text. The mean, largest and smallest chunk responses of a document go
to a logistic layer that gives one probability.

Training uses a bounded sample: at most ``SAMPLE_ROWS`` labelled documents, by a
hash of the id, each with its whole text. Nothing but the bytes of a text goes into
its score. Scoring reads whole texts; the filters are compiled to tables over byte
pairs, so a position costs three reads. A very long text is one slice of its own:
about six bytes of memory for each of its bytes.

Null and empty texts are scored as one position of padding. Repeated rows get equal
scores; of sampled rows that share an id, the one with the smallest hash of its text
trains. Without labels every score is 0.5; an empty table gives an empty one. Equal
scores are no tie to break: each row is judged alone. Columns of any name may clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textio import buffers, map_texts, text_column

EMBED, WIDTH, FILTERS = 8, 6, 32
#: Positions of a segment; a chunk is four segments and shares one with the next chunk.
SEGMENT, CHUNK, STRIDE = 128, 4, 3
SAMPLE_ROWS, EPOCHS, SEED = 3000, 2, 11
#: Filter positions that are held in memory at once.
BLOCK = 1 << 12


def adam(params: dict, grads: dict, state: dict, rate: float) -> None:
    state["t"] = t = state.get("t", 0) + 1
    for k, g in grads.items():
        m, v = state.get(k, (0.0, 0.0))
        state[k] = m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        params[k] -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def learn_filters(chunks: np.ndarray, y: np.ndarray, weight: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> dict:
    """Embedding, filters and biases from (n, SEGMENT * CHUNK + WIDTH - 1) bytes, trained by the loss of a linear layer on max-pooled responses."""
    rng = np.random.default_rng(seed)
    p = {
        "embed": rng.normal(0, 0.5, (256, EMBED)).astype(np.float32), "filters": rng.normal(0, 0.3, (WIDTH * EMBED, FILTERS)).astype(np.float32),
        "bias": np.zeros(FILTERS, np.float32), "out": rng.normal(0, 0.1, FILTERS).astype(np.float32), "shift": np.zeros(1, np.float32),
    }
    state: dict = {}
    positions = SEGMENT * CHUNK
    for epoch in range(epochs):
        order = rng.permutation(len(chunks))
        for at in range(0, len(order), 32):
            pick = order[at : at + 32]
            x, n = chunks[pick], len(pick)
            e = p["embed"][x]
            wide = np.concatenate([e[:, j : j + positions] for j in range(WIDTH)], axis=2)
            act = wide.reshape(-1, WIDTH * EMBED) @ p["filters"]
            act = act.reshape(n, positions, FILTERS)
            best = act.argmax(axis=1)
            top = np.take_along_axis(act, best[:, None], axis=1)[:, 0] + p["bias"]
            h = np.maximum(top, 0)
            d = (sigmoid(h @ p["out"] + p["shift"]) - y[pick]) * weight[pick] / n
            dh = d[:, None] * p["out"] * (top > 0)
            where = wide[np.arange(n)[:, None], best]
            dwhere = dh[:, :, None] * p["filters"].T[None]
            g_embed = np.zeros_like(p["embed"])
            for j in range(WIDTH):
                np.add.at(g_embed, x[np.arange(n)[:, None], best + j], dwhere[:, :, j * EMBED : (j + 1) * EMBED])
            grads = {"out": h.T @ d, "shift": d.sum(keepdims=True), "bias": dh.sum(axis=0), "filters": np.einsum("nfk,nf->kf", where, dh), "embed": g_embed}
            adam(p, grads, state, 0.01 / (1 + epoch))
    return p


def pair_tables(p: dict) -> list[np.ndarray]:
    """Responses of two neighbouring bytes, for each even offset of the filters: (65536, FILTERS)."""
    w = p["filters"].reshape(WIDTH, EMBED, FILTERS)
    single = [p["embed"] @ w[j] for j in range(WIDTH)]
    tables = [(single[j][:, None] + single[j + 1][None]).reshape(65536, FILTERS) for j in range(0, WIDTH, 2)]
    tables[0] = tables[0] + p["bias"]
    return [np.ascontiguousarray(t, np.float32) for t in tables]


def document_features(texts, tables: list[np.ndarray]) -> np.ndarray:
    """(documents, 3 * FILTERS): mean, largest and smallest chunk response over the whole of each text."""
    data, off = buffers(texts)
    size = np.maximum(np.diff(off), 1)  # an empty text has one position of padding
    start = np.concatenate([[0], np.cumsum(size + WIDTH - 1)])
    padded = np.zeros(start[-1] + 1, np.uint8)
    for a, b, to in zip(off[:-1].tolist(), off[1:].tolist(), start[:-1].tolist(), strict=True):
        padded[to : to + b - a] = data[a:b]
    pair = (padded[:-1].astype(np.uint16) << 8) | padded[1:]

    n_seg = -(-size // SEGMENT)
    seg_doc = np.repeat(np.arange(len(size)), n_seg)
    seg_no = np.arange(len(seg_doc)) - np.repeat(np.cumsum(n_seg) - n_seg, n_seg)
    seg_at = start[seg_doc] + seg_no * SEGMENT
    seg_end = np.minimum(seg_at + SEGMENT, start[seg_doc] + size[seg_doc])
    seg = np.empty((len(seg_at), FILTERS), np.float32)
    act, more = np.empty((2, BLOCK, FILTERS), np.float32)
    for first in range(0, len(seg_at), BLOCK // SEGMENT):
        some = slice(first, min(len(seg_at), first + BLOCK // SEGMENT))
        # a segment that the text does not fill repeats its last position, which no maximum notices
        at = np.minimum(seg_at[some, None] + np.arange(SEGMENT), seg_end[some, None] - 1).ravel()
        np.take(tables[0], pair[at], axis=0, out=act[: len(at)], mode="clip")
        for j, t in enumerate(tables[1:], 1):
            np.take(t, pair[at + 2 * j], axis=0, out=more[: len(at)], mode="clip")
            act[: len(at)] += more[: len(at)]
        best, half = act[: len(at)].reshape(-1, SEGMENT, FILTERS), SEGMENT
        while half > 1:
            half //= 2
            np.maximum(best[:, :half], best[:, half : 2 * half], out=best[:, :half])
        seg[some] = best[:, 0]
    np.maximum(seg, 0, out=seg)

    n_chunk = np.maximum(1, -(-(n_seg - 1) // STRIDE))
    chunk_doc = np.repeat(np.arange(len(size)), n_chunk)
    chunk_no = np.arange(len(chunk_doc)) - np.repeat(np.cumsum(n_chunk) - n_chunk, n_chunk)
    base = np.cumsum(n_seg) - n_seg
    reach = np.minimum(chunk_no[:, None] * STRIDE + np.arange(CHUNK), n_seg[chunk_doc][:, None] - 1) + base[chunk_doc][:, None]
    chunk = seg[reach].max(axis=1)
    at = np.cumsum(n_chunk) - n_chunk
    mean = np.add.reduceat(chunk, at, axis=0) / n_chunk[:, None]
    return np.concatenate([mean, np.maximum.reduceat(chunk, at, axis=0), np.minimum.reduceat(chunk, at, axis=0)], axis=1)


def learn_output(x: np.ndarray, y: np.ndarray, steps: int = 600, decay: float = 0.02) -> dict:
    """Logistic layer over standardised document features."""
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-3
    z = (x - mean) / spread
    p, state = {"w": np.zeros(x.shape[1]), "b": np.zeros(1)}, {}
    for step in range(steps):
        d = (sigmoid(z @ p["w"] + p["b"]) - y) / len(y)
        adam(p, {"w": z.T @ d + decay * p["w"], "b": d.sum(keepdims=True)}, state, 0.05 / (1 + step / 200))
    return {"mean": mean, "spread": spread, **p}


def probability(x: np.ndarray, out: dict) -> np.ndarray:
    return sigmoid(((x - out["mean"]) / out["spread"]) @ out["w"] + out["b"])


def held_out(id_col) -> "F.Column":
    """Rows that no model may learn from."""
    return F.crc32(id_col.cast("string")) % 4 == 2


def chunks_of(raw: bytes) -> np.ndarray:
    """The overlapping chunks that cover a whole text, each with the bytes that its last filters reach."""
    n = SEGMENT * CHUNK + WIDTH - 1
    first = range(0, max(1, len(raw) - SEGMENT), SEGMENT * STRIDE)
    return np.stack([np.frombuffer(raw[a : a + n].ljust(n, b"\0"), np.uint8) for a in first])


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample_rows: int) -> list[tuple[int, int, str]]:
    """(id, label, whole text) of at most ``sample_rows`` labelled documents that are not held out, in order of their ids."""
    picked = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
        .groupBy(F.col(id_col).cast("long").alias("chosen")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
        .orderBy(F.xxhash64("chosen"), "chosen").limit(sample_rows)
    )
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    one = rows.join(F.broadcast(picked), F.col("id") == F.col("chosen")).groupBy("id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    return sorted((r["id"], r["y"], r["text"]) for r in one.collect())


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> dict | None:
    """A model from at most ``sample_rows`` labelled documents that are not held out; None without any."""
    rows = training_rows(docs, labels, id_col, text_col, label_col, sample_rows)
    if not rows:
        return None
    parts = [chunks_of(text.encode()) for _, _, text in rows]
    n = np.array([len(c) for c in parts])
    truth = np.array([y for _, y, _ in rows], np.float64)
    share = np.clip(truth.mean(), 0.02, 0.98)
    weight = np.where(truth > 0, 0.5 / share, 0.5 / (1 - share)) * n.mean() / n  # a document counts once, however long
    p = learn_filters(np.concatenate(parts), np.repeat(truth, n).astype(np.float32), np.repeat(weight, n).astype(np.float32))
    x = document_features(pa.array([text for _, _, text in rows], pa.large_string()), pair_tables(p)).astype(np.float64)
    return {"filters": {k: p[k] for k in ("embed", "filters", "bias")}, "out": learn_output(x, truth)}


def score(docs: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id and score, the probability of label 1."""

    def start():
        tables = pair_tables(model["filters"]) if model else None

        def work(ids, texts):
            s = probability(document_features(texts, tables).astype(np.float64), model["out"]) if model else np.full(len(texts), 0.5)
            return {"id": ids, "score": s}

        return work

    return map_texts(docs, id_col, text_col, start, "id long, score double").withColumnRenamed("id", id_col)


def good(docs: DataFrame, model: dict | None, least: float, text_col: str = "text") -> DataFrame:
    """The rows with a score of at least ``least``, all columns as they are."""

    def start():
        tables = pair_tables(model["filters"]) if model else None
        return lambda texts: probability(document_features(texts, tables).astype(np.float64), model["out"]) if model else np.full(len(texts), 0.5)

    return docs.where(text_column(docs, text_col, start, "double") >= least)
