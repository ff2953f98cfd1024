"""Secrets: three fixed patterns, and tokens that look random to two Markov models.

Two first-order character models are trained from labelled samples (``samples``):
random strings over the usual key alphabets (label 1), and the words of all
documents together with the identifiers that programmers make of such words, in
snake, kebab, camel and constant case (label 0). Every token of at least two
characters is judged: it is a secret when the log-likelihood ratio of the models
exceeds a threshold a character and one in all, which short tokens can't reach.

Training counts pairs of characters over all documents, so ``documents`` is read
twice. Null and empty texts have no spans. Positions count code points, ends are
exclusive; equal starts are ordered by kind; repeated rows give repeated results, an
empty table an empty one. Time and memory are linear in the length of a text. Only
the text and id columns are read, so others may have any name.
"""

from __future__ import annotations

import random
import re
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textio import buffers, map_texts, text_column

BASE = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
#: Linear prefilters of the patterns over a slice of texts; they only ever let too much through.
MAYBE = (r"(?i)(?:password|passwd|secret|token|api_?key)", r"AKIA[A-Z0-9]", r"[0-9a-f]{24}")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
N = len(ALPHABET)
#: Nats by which the random model must win: a character, and over a whole token.
THRESHOLD, EVIDENCE = 1.0, 20.0

_CODE = np.full(256, N, np.int64)
_CODE[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(N)
_DIGIT = np.zeros(N + 1, bool)
_DIGIT[52:62] = True


def token_runs(code: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end byte of the runs of alphabet characters of at least two, none across texts."""
    inside = np.zeros(len(code) + 2, bool)
    inside[1:-1] = code < N
    cut = off[1:-1][(off[1:-1] > 0) & (off[1:-1] < len(code))]
    edge = inside[1:] != inside[:-1]
    both = np.unique(cut[inside[cut] & inside[cut + 1]])
    first = np.sort(np.concatenate([np.flatnonzero(edge & inside[1:]), both]))
    end = np.sort(np.concatenate([np.flatnonzero(edge & inside[:-1]), both]))
    long_ = end - first >= 2
    return first[long_], end[long_]


def transitions(counts: np.ndarray) -> np.ndarray:
    """Log-probabilities of the next character; rare contexts lean on how common that character is at all."""
    common = counts.sum(axis=0) + 0.5
    common = common / common.sum()
    return np.log((counts + 5 * common) / (counts.sum(axis=1, keepdims=True) + 5))


def random_counts(n: int = 4000, seed: int = 7) -> np.ndarray:
    """Label 1: pairs of characters of strings over the alphabets of keys, of 20 to 64 characters."""
    draw, counts = random.Random(seed), np.zeros((N, N))
    kinds = ("0123456789abcdef", "0123456789ABCDEF", ALPHABET[:62], ALPHABET[:64], ALPHABET[26:62], ALPHABET[:62] + "_-")
    for _ in range(n):
        chars = draw.choice(kinds)
        k = _CODE[np.frombuffer("".join(draw.choice(chars) for _ in range(draw.randint(20, 64))).encode(), np.uint8)]
        np.add.at(counts, (k[:-1], k[1:]), 1)
    return counts


def word_counts(texts: pa.Array) -> np.ndarray:
    """Label 0, in one vector: pairs within the words of texts, and pairs of the last character of a word and the first of the next.

    Words with more digits than a quarter of them are left out: nothing says what they are.
    """
    data, off = buffers(texts)
    code = _CODE[data]
    first, end = token_runs(code, off)
    out = np.zeros((2, N, N), np.int64)
    if not len(first):
        return out.ravel()
    digits = np.concatenate([[0], np.cumsum(_DIGIT[code])])
    word = (digits[end] - digits[first]) * 4 <= end - first
    first, end = first[word], end[word]
    size = end - first - 1
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size)
    out[0] = np.bincount(code[at] * N + code[at + 1], minlength=N * N).reshape(N, N)
    out[1] = np.bincount(code[end[:-1] - 1] * N + code[first[1:]], minlength=N * N).reshape(N, N)
    return out.ravel()


def identifier_counts(within: np.ndarray, across: np.ndarray) -> np.ndarray:
    """Pairs of the identifiers made of neighbouring words: snake_case, kebab-case, camelCase, CONSTANT_CASE, with a version number at times."""
    upper, lower = np.arange(26), np.arange(26, 52)
    letters, joints = np.zeros((26, 26)), np.zeros((26, 26))
    for a in (upper, lower):
        for b in (upper, lower):
            letters += within[np.ix_(a, b)]
            joints += across[np.ix_(a, b)]
    out = np.zeros((N, N))
    ends, starts = joints.sum(axis=1), joints.sum(axis=0)
    for case, mark in ((lower, "_"), (lower, "-"), (upper, "_")):
        out[np.ix_(case, case)] += letters
        out[case, ALPHABET.index(mark)] += ends
        out[ALPHABET.index(mark), case] += starts
    out[np.ix_(lower, lower)] += letters
    out[np.ix_(lower, upper)] += joints
    out[np.ix_(lower, np.arange(52, 62))] += np.outer(ends, np.full(10, 0.005))
    return out


def samples(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Counts of the pairs of characters of label 1 and of label 0, the latter over all documents.

    Spark adds up the pairs, so the driver gets at most one number for each of them.
    """

    def start():
        def work(ids, texts):
            n = word_counts(texts)
            at = np.flatnonzero(n)
            return {"pair": at, "n": n[at]}

        return work

    flat = np.zeros(2 * N * N)
    for r in map_texts(docs, id_col, text_col, start, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        flat[r["pair"]] = r["n"]
    within, across = flat.reshape(2, N, N)
    return random_counts(), within + identifier_counts(within, across)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """Log-likelihood ratio (random minus ordinary) of each pair of characters."""
    likely, ordinary = samples(docs, id_col, text_col)
    return transitions(likely) - transitions(ordinary)


def ratio(token: str, model: np.ndarray) -> float:
    """Mean log-likelihood ratio of a token's transitions."""
    k = _CODE[np.frombuffer(token.encode(), np.uint8)]
    return float(model[k[:-1], k[1:]].mean()) if len(token) > 1 else 0.0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of the fixed patterns."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def random_tokens(texts: pa.Array, model: np.ndarray, threshold: float = THRESHOLD, evidence: float = EVIDENCE) -> dict[int, list[tuple[int, int]]]:
    """Text number -> (first, end) in code points of the tokens that the models take for random."""
    data, off = buffers(texts)
    code = _CODE[data]
    first, end = token_runs(code, off)
    if not len(first):
        return {}
    padded = np.zeros((N + 1, N + 1))
    padded[:N, :N] = model
    gain = np.concatenate([[0.0], np.cumsum(padded[code[:-1], code[1:]])])
    total = gain[end - 1] - gain[first]
    hit = np.flatnonzero((total > evidence) & (total > threshold * (end - first - 1)))
    if not len(hit):
        return {}
    text = np.searchsorted(off, first[hit], "right") - 1
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    base = chars[off[text]]
    out: dict[int, list[tuple[int, int]]] = {}
    for t, a, b in zip(text.tolist(), (chars[first[hit]] - base).tolist(), (chars[end[hit]] - base).tolist(), strict=True):
        out.setdefault(t, []).append((a, b))
    return out


def merged(base: list[tuple[int, int, int]], tokens: list[tuple[int, int]]) -> list[tuple[int, str, int]]:
    """(start, kind, end) of all spans by start; random tokens that touch a base span are left out. Both lists are ordered by start."""
    out, k, reach = list(base), 0, 0
    for a, b in tokens:
        while k < len(base) and base[k][0] < b:
            reach = max(reach, base[k][2])
            k += 1
        if reach <= a:
            out.append((a, 3, b))
    return [(a, (*BASE, "random")[k], b) for a, k, b in sorted(out)]


def find_all(texts: pa.Array, model: np.ndarray, threshold: float = THRESHOLD) -> list[list[tuple[int, str, int]]]:
    """The spans of each of many texts."""
    maybe = reduce(np.logical_or, (pc.match_substring_regex(texts, p).to_numpy(zero_copy_only=False) for p in MAYBE))
    tokens = random_tokens(texts, model, threshold)
    out: list[list[tuple[int, str, int]]] = [[] for _ in range(len(texts))]
    for t in sorted({*np.flatnonzero(maybe).tolist(), *tokens}):
        out[t] = merged(base_spans(texts[t].as_py()) if maybe[t] else [], tokens.get(t, []))
    return out


def find(text: str, model: np.ndarray, threshold: float = THRESHOLD) -> list[tuple[int, str, int]]:
    """(start, kind, end) of all spans; base spans come first at equal starts."""
    return find_all(pa.array([text], pa.string()), model, threshold)[0]


def secret_spans(docs: DataFrame, model: np.ndarray, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row a document: id and ``found``, an array of (kind, start, end) by start."""

    def start():
        return lambda ids, texts: {"id": ids, "found": [[{"kind": k, "start": a, "end": b} for a, k, b in spans] for spans in find_all(texts, model, threshold)]}

    return map_texts(docs, id_col, text_col, start, "id long, found array<struct<kind:string,start:int,end:int>>").withColumnRenamed("id", id_col)


def redacted(text: str, spans: list[tuple[int, str, int]], mark: str) -> str:
    parts, at = [], 0
    for a, _, b in spans:
        if a >= at:
            parts += [text[at:a], mark]
        at = max(at, b)
    return "".join([*parts, text[at:]])


def redact(docs: DataFrame, model: np.ndarray, text_col: str = "text", mark: str = "[SECRET]", threshold: float = THRESHOLD) -> DataFrame:
    """All rows and columns, with each span of the texts replaced by ``mark``; null texts stay null."""

    def start():
        return lambda texts: [redacted(x.as_py(), spans, mark) if spans else None for x, spans in zip(texts, find_all(texts, model, threshold), strict=True)]

    return docs.withColumn(text_col, F.coalesce(text_column(docs, text_col, start, "string"), F.col(text_col)))
