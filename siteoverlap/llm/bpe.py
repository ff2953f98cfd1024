"""Byte-level BPE by a lazily determinised finite-state transducer.

The encoding of a prefix of a pre-token ends in exactly one token, and a token
sequence is the encoding if and only if all its neighbours keep apart, that is,
if encoding the two of them alone gives the two again. So the merges compile to
a nondeterministic transducer with one hypothesis for each place where the
current token may have begun: its place in the token trie and the token before.
Sets of hypotheses are the states of the deterministic transducer, which outputs
at each byte the token that ends there; states and transitions are built when a
byte first needs them. A token is certain, and goes out, once every hypothesis
descends from it: after a lookahead bounded by the longest token. So pre-tokens
of any length cost linear time and bounded memory.

Null and empty texts encode to no ids. Caches are bounded and rebuilt when full.
Repeated rows give repeated rows, an empty table an empty one; there are no ties,
because a text has one encoding. Only the id and text columns are read, so others
may have any name.
"""

from __future__ import annotations

import base64
import hashlib
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame

from .textio import map_texts

#: States, neighbouring tokens for each state, and whole pre-tokens that a worker remembers at most.
MAX_STATES, MAX_APART, MAX_WORDS = 260_000, 2, 120_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a public rank file (base64 of the token, its id)."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines) if token}


class Transducer:
    #: Room for a token id beside a trie node in one number.
    SHIFT = 24

    def __init__(self, ranks: dict[bytes, int], max_states: int = MAX_STATES):
        self.ranks, self.max_states = ranks, max_states
        self.word: dict[int, bytes] = {r: w for w, r in ranks.items()}
        self.apart: dict[tuple[int, int], bool] = {}
        self.edges: dict[int, list[tuple[list[bytes], list[int]]]] = {}
        self.trie: list[dict[int, int]] = [{}]
        self.depth, self.token = [0], [-1]
        for word, rank in ranks.items():
            if self.merged(word) == [word]:
                node = 0
                for c in word:
                    if c not in self.trie[node]:
                        self.trie[node][c] = len(self.trie)
                        self.trie.append({})
                        self.depth.append(self.depth[node] + 1)
                        self.token.append(-1)
                    node = self.trie[node][c]
                self.token[node] = rank
        self.forget()

    def forget(self) -> None:
        self.number, self.sets, self.steps = {(0,): 0}, [(0,)], {}

    def merged(self, word: bytes, watch: list | None = None) -> list[bytes]:
        """Merge by rank, leftmost first; only for words as short as two tokens. ``watch`` gets the parts after each merge."""
        parts, ranks = [word[k : k + 1] for k in range(len(word))], self.ranks
        found = [ranks.get(parts[k] + parts[k + 1], 1 << 60) for k in range(len(parts) - 1)]
        while found and (best := min(found)) < 1 << 60:
            at = found.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del found[at]
            if at:
                found[at - 1] = ranks.get(parts[at - 1] + parts[at], 1 << 60)
            if at < len(found):
                found[at] = ranks.get(parts[at] + parts[at + 1], 1 << 60)
            if watch is not None:
                watch.append((best, parts[0], parts[-1]))
        return parts

    def edge(self, token: int) -> list[tuple[list[bytes], list[int]]]:
        """First and last parts of a token as it is merged, each with the ranks of the merges that replace them."""
        got = self.edges.get(token)
        if got is None:
            word, watch = self.word[token], []
            self.merged(word, watch)
            got = []
            for side, part in ((1, word[:1]), (2, word[-1:])):
                parts, when = [part], []
                for w in watch:
                    if w[side] != parts[-1]:
                        parts.append(w[side])
                        when.append(w[0])
                got.append((parts, [*when, 1 << 60]))
            self.edges[token] = got
        return got

    def keeps_apart(self, a: int, b: int) -> bool:
        """Whether no merge ever crosses the border of two neighbouring tokens."""
        got = self.apart.get((a, b))
        if got is None:
            if len(self.apart) >= MAX_APART * self.max_states:
                self.apart.clear()
            (left, left_when), (right, right_when) = self.edge(a)[1], self.edge(b)[0]
            i = j = 0
            if left_when[:-1] != sorted(left_when[:-1]) or right_when[:-1] != sorted(right_when[:-1]):
                got = self.merged(self.word[a] + self.word[b]) == [self.word[a], self.word[b]]
            while got is None:
                across = self.ranks.get(left[i] + right[j], 1 << 60)
                if across < left_when[i] and across <= right_when[j] and across < 1 << 60:
                    got = False
                elif left_when[i] == right_when[j] == 1 << 60:
                    got = True
                elif left_when[i] <= right_when[j]:
                    i += 1
                else:
                    j += 1
            self.apart[a, b] = got
        return got

    def step(self, state: int, byte: int) -> int:
        """Build the transition: the next state and, in the last SHIFT bits, one more than the token that ends at this byte."""
        alive, ended, shift = [], -1, self.SHIFT
        for packed in self.sets[state]:
            before = packed & ((1 << shift) - 1)
            node = self.trie[packed >> shift].get(byte, -1)
            if node < 0:
                continue
            if ended < 0 and (token := self.token[node]) >= 0 and (not before or self.keeps_apart(before - 1, token)):
                ended = token
            if self.trie[node]:
                alive.append(node << shift | before)
        alive.append(ended + 1)
        key = tuple(alive)
        number = self.number.get(key)
        if number is None:
            number = self.number[key] = len(self.sets)
            self.sets.append(key)
        got = self.steps[state << 8 | byte] = number << shift | (ended + 1)
        return got

    def stream(self, word: Iterable[int], look: int = 4096) -> Iterator[list[int]]:
        """Ids of one pre-token in pieces: what is certain after each ``look`` bytes, and the rest at its end."""
        if len(self.sets) > self.max_states:
            self.forget()
        state, ends, put, mask = 0, [], 0, (1 << self.SHIFT) - 1
        for byte in word:
            got = self.steps.get(state << 8 | byte) or self.step(state, byte)
            state = got >> self.SHIFT
            ends.append((got & mask) - 1)
            if len(ends) - put >= look:
                paths = [self.back(ends, len(ends) - self.depth[packed >> self.SHIFT]) for packed in self.sets[state]]
                common = min(len(p) for p in paths)
                while len({p[common - 1] if common else 0 for p in paths}) > 1:
                    common -= 1
                if common:
                    yield [t for t, _ in paths[0][:common]]
                    ends = ends[paths[0][common - 1][1] :]
                put = len(ends)
                if len(self.sets) > 2 * self.max_states:  # within one very long pre-token
                    kept = self.sets[state]
                    self.forget()
                    state = self.number.setdefault(kept, len(self.sets))
                    if state:
                        self.sets.append(kept)
        yield [t for t, _ in self.back(ends, len(ends))]

    def back(self, ends: list[int], at: int) -> list[tuple[int, int]]:
        """(token, its end) of the path that ends at a place, in order."""
        out = []
        while at > 0:
            out.append((ends[at - 1], at))
            at -= len(self.word[ends[at - 1]])
        return out[::-1]

    def encode(self, word: bytes) -> list[int]:
        """Ids of one pre-token."""
        if len(word) > 2048:
            return [t for piece in self.stream(word) for t in piece]
        if len(self.sets) > self.max_states:
            self.forget()
        state, ends, steps, shift, mask = 0, [], self.steps.get, self.SHIFT, (1 << self.SHIFT) - 1
        for byte in word:
            got = steps(state << 8 | byte) or self.step(state, byte)
            state = got >> shift
            ends.append((got & mask) - 1)
        at, out, words = len(ends), [], self.word
        while at:
            token = ends[at - 1]
            out.append(token)
            at -= len(words[token])
        return out[::-1]


class Utf8Stream:
    """Incremental UTF-8: keeps the bytes of an unfinished character until the rest arrives."""

    def __init__(self):
        self.rest = b""

    @staticmethod
    def unfinished(data: bytes) -> int:
        """How many last bytes start a character that is not complete."""
        for back in range(1, min(4, len(data) + 1)):
            lead = data[-back]
            if lead & 0xC0 == 0x80:
                continue
            need = 4 if lead >= 0xF0 else 3 if lead >= 0xE0 else 2 if lead >= 0xC0 else 1
            return back if need > back else 0
        return 0

    def feed(self, data: bytes) -> str:
        data = self.rest + data
        cut = len(data) - self.unfinished(data)
        self.rest = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def end(self) -> str:
        rest, self.rest = self.rest, b""
        return rest.decode("utf-8", "replace")


def decode_stream(ids: Iterable[int], table: dict[int, bytes] | list[bytes], block: int = 4096) -> Iterator[str]:
    """Text of a stream of ids, in pieces that end at characters."""
    out, block_bytes = Utf8Stream(), []
    for i in ids:
        block_bytes.append(table[i])
        if len(block_bytes) >= block:
            yield out.feed(b"".join(block_bytes))
            block_bytes = []
    yield out.feed(b"".join(block_bytes))
    yield out.end()


def latin_pattern(pattern: str) -> str:
    r"""The pattern with \p{L}, \p{N} and \s spelled out for the characters below 256."""
    chars = [chr(k) for k in range(256)]
    of = {
        r"\p{L}": "".join(re.escape(c) for c in chars if unicodedata.category(c)[0] == "L"),
        r"\p{N}": "".join(re.escape(c) for c in chars if unicodedata.category(c)[0] == "N"),
        r"\s": "\t\n\x0b\x0c\r \x85\xa0",
    }
    out = pattern.replace(r"\S", f"[^{of[r'\s']}]")
    out = re.sub(r"\[\^([^]]*)\]", lambda m: "[^" + re.sub(r"\\p\{[LN]\}|\\s", lambda c: of[c[0]], m[1]) + "]", out)
    return re.sub(r"\\p\{[LN]\}|\\s", lambda m: f"[{of[m[0]]}]", out)


class Codec(dict):
    """Pre-token -> its ids as decimal text, through the transducer; and back."""

    def __init__(self, path: str, pattern: str, max_words: int = MAX_WORDS):
        import regex

        super().__init__()
        ranks = read_ranks(path)
        self.any_text, self.transducer, self.max_words = regex.compile(pattern).findall, Transducer(ranks), max_words
        self.latin = re.compile(latin_pattern(pattern)).findall
        self.bytes_of = {str(i): token for token, i in ranks.items()}

    def __missing__(self, word: str) -> str:
        got = ",".join(map(str, self.transducer.encode(word.encode())))
        if len(word) <= 64:
            if len(self) >= self.max_words:
                self.clear()
            self[word] = got
        return got

    def split(self, text: str) -> list[str]:
        """The matches of the pattern; the standard library finds them sooner where all characters are below 256."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.any_text(text)
        return self.latin(text)

    def encode(self, text: str) -> str:
        """Ids of a text, decimal, comma-joined."""
        return ",".join(map(self.__getitem__, self.split(text))) if text else ""

    def decode(self, ids: str, block: int = 1 << 16) -> Iterator[str]:
        """Text of comma-joined ids, streamed in pieces."""
        out, table = Utf8Stream(), self.bytes_of.__getitem__
        every = ids.split(",") if ids else []
        for k in range(0, len(every), block):
            yield out.feed(b"".join(map(table, every[k : k + block])))
        yield out.end()


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One codec a worker process, so that tasks share what earlier ones compiled."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(path, pattern)
    return _CODECS[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """One row a document: id, n_tokens, ids (unless ``keep_ids`` is off), sha-256 of the ids and of the decoded bytes.

    ``path`` is a rank file that every executor can open.
    """

    def start():
        code = codec(path, pattern)

        def work(ids, texts):
            out = {"id": ids, "n_tokens": [], "ids": [], "ids_sha256": [], "decoded_sha256": []}
            for text in texts.to_pylist():
                coded = code.encode(text)
                back = hashlib.sha256()
                for piece in code.decode(coded):
                    back.update(piece.encode())
                out["n_tokens"].append(coded.count(",") + 1 if coded else 0)
                out["ids"].append((np.array(coded.split(","), np.int32) if coded else np.zeros(0, np.int32)) if keep_ids else None)
                out["ids_sha256"].append(hashlib.sha256(coded.encode()).hexdigest())
                out["decoded_sha256"].append(back.hexdigest())
            return out

        return work

    schema = "id long, n_tokens long, " + "ids array<int>, " * keep_ids + "ids_sha256 string, decoded_sha256 string"
    return map_texts(docs, id_col, text_col, start, schema).withColumnRenamed("id", id_col)
