"""Quality rules by line labels: a linear-chain conditional random field over the lines of a text.

A line with a word is a position of the chain. It is described by a few measures
(length, shares of symbols, capitals, digits and marks, repetition, place), each cut
into ranges; a weight for each range and two-by-two transitions score the labels
content and boilerplate, and Viterbi decoding gives the likeliest sequence. A text is
kept if enough of its word characters are in lines of content.

The weights are fitted by maximum likelihood (forward and backward passes) on the
lines of at most ``SAMPLE_ROWS`` labelled texts, picked by a hash of the id, each
whole. Executors measure the lines; the driver gets one byte for each measure of a
line. A line of a poor text that good texts of the sample have as well counts as
content; chains longer than ``SEGMENT`` lines are cut for the fit, never for decoding.

Rules besides: too few words, or too many words in windows that repeat, fail a text.

Null and empty texts have no words and fail; without labels (or with labels of one
kind only) the rules alone decide. Repeated rows get equal results, an empty table
gives an empty one. Equal scores of both labels mean content. A text is measured line
by line, in time linear in its length; memory follows the longest text. Only the named
columns are read; others may have any name.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality import adam, held_out
from .textio import map_texts

SAMPLE_ROWS, SEGMENT, STEPS = 3000, 256, 150
#: A text with fewer words fails, and one with more than so many percent of its words in repeated windows of so many words.
LEAST_WORDS, MOST_REPEATED, WINDOW = 50, 50, 3
#: Share of the word characters that must be in lines of content.
LEAST_CONTENT = 0.5
SYMBOLS = b"#*$%&|<>"
CAPITALS, DIGITS = bytes(range(65, 91)), bytes(range(48, 58))
MARKS = b"!\"'(),-./:;?@[\\]^_`{}~+="
_NOT_FIRST = bytes(range(0x80, 0xC0))

#: The measures of a line and where their ranges are cut.
CUTS = {
    "words": (2, 4, 8, 16, 32, 64), "characters a word": (1.5, 2.5, 3.5, 4.5, 6, 8, 12), "symbols": (1e-9, 0.01, 0.03, 0.1, 0.2, 0.4), "capitals": (0.01, 0.03, 0.06, 0.12, 0.3, 0.6),
    "digits": (1e-9, 0.02, 0.08, 0.2, 0.5), "marks": (1e-9, 0.01, 0.03, 0.06, 0.12, 0.25), "different words": (0.1, 0.25, 0.45, 0.65, 0.8, 0.9, 0.999), "words equal to the one before": (1e-9, 0.05, 0.2, 0.5),
    "ends a sentence": (1,), "starts with a capital": (1,), "equals an earlier line": (1,), "first or last": (1, 2, 3),
}
WIDTH = max(map(len, CUTS.values())) + 1


def without(text: bytes, some: bytes) -> int:
    """How many bytes of the text are among ``some``."""
    return len(text) - len(text.translate(None, some))


def characters(text: bytes) -> int:
    """Code points of UTF-8 bytes."""
    return len(text.translate(None, _NOT_FIRST))


def measured(line: bytes, words: list[bytes], chars: int, symbols: int, again: bool, place: int) -> bytes:
    """The range of each measure of a line."""
    n = len(words)
    values = (
        n, chars / n, symbols / chars, without(line, CAPITALS) / chars, without(line, DIGITS) / chars, without(line, MARKS) / chars, len(set(words)) / n,
        sum(map(bytes.__eq__, words[1:], words)) / n, words[-1][-1] in b".!?", 65 <= words[0][0] <= 90 or words[0][0] >= 0xC3, again, place,
    )
    return bytes(bisect_right(cuts, v) for cuts, v in zip(CUTS.values(), values, strict=True))


def repeated_words(words: Iterable[int]) -> int:
    """How many words stand in a window of three that the text has twice or more (numbers of words)."""
    w = np.fromiter(words, np.int64)
    if len(w) <= WINDOW:
        return 0
    pair = np.unique(w[:-2] * (w.max() + 1) + w[1:-1], return_inverse=True)[1]
    _, window, times = np.unique(pair * (w.max() + 1) + w[2:], return_inverse=True, return_counts=True)
    often = times[window] > 1
    inside = np.zeros(len(w), bool)
    for k in range(WINDOW):
        inside[k : k + len(often)] |= often
    return int(inside.sum())


class Measures:
    """The counts of a text, and the measures, word characters and hashes of its lines with a word."""

    def __init__(self, raw: bytes):
        number: dict[bytes, int] = {}
        seen: set[bytes] = set()
        order: list[int] = []
        self.word_chars = self.symbols = self.again = 0
        rows: list[tuple] = []
        for line in raw.split(b"\n"):
            words = line.split()  # bytes split at exactly \x20 and \x09-\x0d
            if not words:
                continue
            order += [number.setdefault(w, len(number)) for w in words]
            chars, symbols, again = sum(map(characters, words)), without(line, SYMBOLS), line in seen
            seen.add(line)
            self.word_chars += chars
            self.symbols += symbols
            self.again += again
            rows.append((line, words, chars, symbols, again))
        self.words = len(order)
        self.repeated = repeated_words(order)
        last = len(rows) - 1
        self.chars = [r[2] for r in rows]
        self.ranges = [measured(*r, (k == 0) + 2 * (k == last)) for k, r in enumerate(rows)]
        self.lines = [r[0] for r in rows]

    @property
    def failed(self) -> bool:
        return self.words < LEAST_WORDS or 100 * self.repeated > MOST_REPEATED * self.words


def emissions(ranges: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """What speaks for content in each line: the sum of the weights of its ranges. ranges: (..., measures)."""
    return weights[np.arange(ranges.shape[-1]), ranges].sum(axis=-1)


def viterbi(score: list[float], stay: float, go: float, back: float, start: float) -> list[bool]:
    """The likeliest labels (content) of a chain: ``score`` for content at each position, ``stay`` for content after content, ``go`` for content after boilerplate, ``back`` for boilerplate after content, all against boilerplate after boilerplate."""
    if not score:
        return []
    no, yes = 0.0, start + score[0]
    came: list[tuple[bool, bool]] = []
    for s in score[1:]:
        to_no, to_yes = yes + back >= no, yes + stay >= no + go
        no, yes = (yes + back if to_no else no), (yes + stay if to_yes else no + go) + s
        came.append((to_no, to_yes))
    label = yes >= no
    out = [label]
    for to_no, to_yes in reversed(came):
        label = to_yes if label else to_no
        out.append(label)
    return out[::-1]


def fitted(chains: list[np.ndarray], labels: list[np.ndarray], steps: int = STEPS, decay: float = 1e-3) -> dict:
    """Weights (measures, WIDTH) and transitions (from, to) that maximise the likelihood of the labels, all chains at once.

    Rows are laid out by position, longer chains first, so that the chains that go on
    at a position are the first rows of the position before.
    """
    length = np.array([len(c) for c in chains])
    chain, place = np.repeat(np.arange(len(chains)), length), np.concatenate([np.arange(n) for n in length])
    order = np.lexsort((chain, -length[chain], place))
    x, y, chain = np.concatenate(chains)[order].astype(np.int64), np.concatenate(labels)[order].astype(float), chain[order]
    alive = np.bincount(place)
    off = np.concatenate([[0], np.cumsum(alive)])
    links = [(slice(off[t - 1], off[t - 1] + alive[t]), slice(off[t], off[t + 1])) for t in range(1, len(alive))]  # rows that go on, and where to
    before, after = np.concatenate([np.zeros(0, np.int64), *(np.arange(a.start, a.stop) for a, _ in links)]), np.arange(alive[0], len(x))
    last = np.setdiff1d(np.arange(len(x)), before)
    total, cell, measures = len(x), (np.arange(len(CUTS)) * WIDTH + x).ravel(), len(CUTS)
    seen = np.bincount((2 * y[before] + y[after]).astype(int), minlength=4).reshape(2, 2)
    p, state, z = {"weights": np.zeros((measures, WIDTH)), "trans": np.zeros((2, 2)), "start": np.zeros(1)}, {}, np.empty(len(chains))
    for step in range(steps):
        e = np.zeros((total, 2))
        e[:, 1] = emissions(x, p["weights"])
        a, b = e.copy(), np.zeros((total, 2))
        a[: alive[0], 1] += p["start"][0]
        for i, j in links:
            a[j] += np.logaddexp.reduce(a[i, :, None] + p["trans"], axis=1)
        for i, j in reversed(links):
            b[i] = np.logaddexp.reduce(p["trans"] + (e[j] + b[j])[:, None, :], axis=2)
        z[chain[last]] = np.logaddexp.reduce(a[last], axis=1)
        given = np.exp(a[:, 1] + b[:, 1] - z[chain])
        both = np.exp(a[before][:, :, None] + p["trans"] + (e + b)[after][:, None, :] - z[chain[after]][:, None, None])
        grads = {
            "weights": np.bincount(cell, np.repeat(given - y, measures), measures * WIDTH).reshape(measures, WIDTH) / total + decay * p["weights"],
            "trans": (both.sum(axis=0) - seen) / total + decay * p["trans"], "start": np.array([(given - y)[: alive[0]].sum() / total]),
        }
        adam(p, grads, state, 0.1 / (1 + step / 100))
    return p


def sampled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows: int) -> list:
    """(id, label, measures and hashes of the lines) of at most ``rows`` labelled documents that are not held out."""
    picked = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(F.col(id_col).cast("long").alias("chosen"))
        .agg(F.max(F.col(label_col).cast("int")).alias("y")).orderBy(F.xxhash64("chosen"), "chosen").limit(rows)
    )

    def start():
        def work(ids, texts):
            found = [Measures(t.as_buffer().to_pybytes()) for t in texts]
            return {"id": ids, "ranges": [b"".join(m.ranges) for m in found], "lines": [[hash_of(x) for x in m.lines] for m in found]}

        return work

    want = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(picked), F.col("id") == F.col("chosen"), "left_semi")
    found = map_texts(want, "id", "text", start, "id long, ranges binary, lines array<long>")
    one = found.groupBy("id").agg(F.min(F.struct("ranges", "lines")).alias("of")).join(F.broadcast(picked), F.col("id") == F.col("chosen"))
    return one.select("id", "y", "of.ranges", "of.lines").orderBy("id").collect()


def hash_of(line: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(line) - (1 << 63)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> dict | None:
    """The field, from at most ``sample_rows`` labelled documents; None without labels of both kinds."""
    rows = [r for r in sampled(docs, labels, id_col, text_col, label_col, sample_rows) if r["lines"]]
    if len({r["y"] > 0 for r in rows}) < 2:
        return None
    good = {h for r in rows if r["y"] > 0 for h in r["lines"]}
    chains, truth = [], []
    for r in rows:
        x = np.frombuffer(bytes(r["ranges"]), np.uint8).reshape(-1, len(CUTS))
        y = np.ones(len(x), bool) if r["y"] > 0 else np.array([h in good for h in r["lines"]])
        for at in range(0, len(x), SEGMENT):
            chains.append(x[at : at + SEGMENT])
            truth.append(y[at : at + SEGMENT])
    return fitted(chains, truth)


def content_share(m: Measures, field: dict | None) -> float:
    """Share of the word characters in lines that the field labels content."""
    if field is None or not m.word_chars:
        return 1.0
    t = field["trans"] - field["trans"][0, 0]
    score = emissions(np.frombuffer(b"".join(m.ranges), np.uint8).reshape(-1, len(CUTS)), field["weights"]).tolist()
    content = viterbi(score, t[1, 1], t[0, 1], t[1, 0], field["start"][0])
    return sum(c for c, yes in zip(m.chars, content, strict=True) if yes) / m.word_chars


def judge(docs: DataFrame, field: dict | None, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST_CONTENT) -> DataFrame:
    """One row a document: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, content (share), kept."""

    def start():
        def work(ids, texts):
            found = [Measures(t.as_buffer().to_pybytes()) for t in texts]
            share = [content_share(m, field) for m in found]
            return {
                "id": ids, "n_words": [m.words for m in found], "word_chars": [m.word_chars for m in found], "n_symbols": [m.symbols for m in found], "n_dup_lines": [m.again for m in found],
                "n_repeat_words": [m.repeated for m in found], "base_failed": [m.failed for m in found], "content": share, "kept": [not m.failed and s >= least for m, s in zip(found, share, strict=True)],
            }

        return work

    schema = "id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content double, kept boolean"
    return map_texts(docs, id_col, text_col, start, schema).withColumnRenamed("id", id_col)
