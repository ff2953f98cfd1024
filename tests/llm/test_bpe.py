"""The transducer against the tiktoken library."""

import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken
from siteoverlap.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def both():
    ranks = bpe.read_ranks(PATH)
    return bpe.Codec(PATH, P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    draw = random.Random(3)
    letters = ["a", "b", "th", "e", "ing", "é", "ß", "中", "文", "🙂", " ", "  ", "\n", "1", "23", "'s", "!", "###", "ñ", "ciónado", "un", "Straße", "‍", "\t"]
    yield from ("", " ", "a" * 5000, "ab" * 3000, "é" * 999, " " * 700, "<|endoftext|>", "naïve café 中文字符 🙂🙂", "0123456789" * 50)
    for _ in range(1500):
        yield "".join(draw.choice(letters) for _ in range(draw.randint(1, 60)))
    for _ in range(200):
        yield "".join(chr(draw.choice([draw.randint(32, 126), draw.randint(160, 0x2FFF), draw.randint(0x4E00, 0x9FFF)])) for _ in range(80))


def test_equals_library(both):
    code, library = both
    for text in texts():
        want = ",".join(map(str, library.encode_ordinary(text)))
        assert code.encode(text) == want, text[:80]
        assert "".join(code.decode(want)) == text


def test_small_caches_change_nothing(both):
    _, library = both
    small = bpe.Codec(PATH, P.PATTERN, max_words=5)
    small.transducer.max_states = 40
    for text in list(texts())[:300]:
        assert small.encode(text) == ",".join(map(str, library.encode_ordinary(text)))


@pytest.mark.parametrize("block", [1, 2, 3, 1000])
def test_streaming_decode_never_cuts_characters(both, block):
    code, library = both
    table = {int(k): v for k, v in code.bytes_of.items()}
    text = "naïve 中文字符 🙂 " * 20
    pieces = list(bpe.decode_stream(library.encode_ordinary(text), table, block))
    assert "".join(pieces) == text and "�" not in "".join(pieces)


def test_query_rows(spark, both):
    _, library = both
    docs = spark.createDataFrame([(1, "Ünter den Linden 12", 0), (2, None, 0), (3, "", 0), (3, "", 0)], "doc_id long, text string, ids int")
    got = sorted(map(tuple, bpe.encode_documents(docs, PATH, P.PATTERN).collect()))
    none = hashlib.sha256(b"").hexdigest()
    ids = library.encode_ordinary("Ünter den Linden 12")
    assert got[0] == (1, len(ids), ids, hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256("Ünter den Linden 12".encode()).hexdigest())
    assert got[1:] == [(2, 0, [], none, none)] + [(3, 0, [], none, none)] * 2
    assert bpe.encode_documents(docs.where("false"), PATH, P.PATTERN).count() == 0
