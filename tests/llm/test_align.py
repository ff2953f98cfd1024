"""Alignment of two tokenizers against a plain version."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
import sentencepiece
from siteoverlap.llm import align, queries
from tokenizers import Tokenizer

A_PATH, B_PATH = P.path(queries.BYTES), P.path(queries.PIECES)


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A_PATH)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B_PATH)


def plain_groups(text, libraries):
    """The groups of a text as two lists of ids each."""
    a, b = libraries
    byte = align.byte_of_char()
    want = b" " + (text or "").encode()
    xs = a.encode(" " + (text or ""), add_special_tokens=False).ids
    x = [bytes(byte[c] for c in a.id_to_token(k)) for k in xs]
    ys = b.encode(text or "")
    y = [bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode() for k in ys]
    if not text or b"".join(x) != want or b"".join(y) != want:
        return [], [], []
    ends = [np.cumsum(list(map(len, z))).tolist() for z in (x, y)]
    groups, i, j = [], 0, 0
    for e in sorted(set(ends[0]) & set(ends[1])):
        p, q = ends[0].index(e, i) + 1, ends[1].index(e, j) + 1
        groups.append((xs[i:p], ys[j:q]))
        i, j = p, q
    return xs, ys, groups


def plain_report(docs, libraries):
    made = [plain_groups(t, libraries) for _, t, *_ in docs]
    count = Counter()
    for _, _, groups in made:
        count.update({(x, y) for g, h in groups for x in g for y in h})
    most = defaultdict(int)
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    out = []
    for (i, *_), (xs, ys, groups) in zip(docs, made, strict=True):
        pairs = [(x, y) for g, h in groups for x in g for y in h]
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        out.append((i, len(xs) if groups else 0, len(ys) if groups else 0, len(groups), len(pairs), sum(count[p] == most[p[0]] for p in pairs), sum(count[p] for p in pairs), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return sorted(out, key=str)


def documents():
    draw = random.Random(5)
    some = ["the", "internationalisation", "été", "1234567", "naïve", "  ", "\n", "\t", "日本語", "🙂", "<s>", "</s>", "<|endoftext|>", "don't", "...", "ß", "a b", "X" * 30, "–", "ij"]
    docs = [(k, " ".join(draw.choice(some) for _ in range(draw.randint(0, 60))), "clash") for k in range(120)]
    docs += [(200, None, ""), (201, "", ""), (202, "▁", ""), (203, "a▁b", ""), (204, " ", ""), (205, "\x00", ""), (206, "ﬁ ｆｕｌｌ", ""), (207, "café", ""), docs[3], docs[3], (None, "no id", ""), (208, "aaaaaaa" * 700, ""), (209, " " * 3000 + "x", ""), (210, "word été " * 4000, "")]
    return docs


@pytest.mark.parametrize("most", [align.MOST_PAIRS, 40, 0])
def test_report(spark, libraries, most):
    docs = documents()
    d = spark.createDataFrame(docs, "doc_id long, text string, row string")
    got = align.alignment_report(d, A_PATH, P.PATTERN, B_PATH, most=most)
    assert sorted(map(tuple, got.collect()), key=str) == plain_report(docs, libraries)


def test_op11(spark, libraries, tmp_path):
    docs = documents()
    spark.createDataFrame(docs, "doc_id long, text string, n_a string").write.parquet(f"file://{tmp_path}/documents.parquet")
    got = queries.op11_align(spark, f"file://{tmp_path}")
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == plain_report(docs, libraries)


def test_empty_table(spark):
    assert align.alignment_report(spark.createDataFrame([], "doc_id long, text string"), A_PATH, P.PATTERN, B_PATH).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_encoders_equal_the_libraries(libraries, seed):
    draw = random.Random(seed)
    one = align.ByteTokenizer(A_PATH, P.PATTERN)
    letters = [*(chr(k) for k in range(0x250)), *"    \n\n\t\r'sdtmlver", *"abcXYZ019"]
    texts = []
    for _ in range(150):
        text = "".join(draw.choice(letters) for _ in range(draw.randint(1, 60)))
        texts.append(text + draw.choice(["", " " * draw.randint(1, 700), " " * draw.randint(1, 900), "'s 'll\x85", "\x1c\x1d ", "日本 語"]) + draw.choice(letters))
    words = ["a", "the", "été", " x", "\n", "▁", "▁▁ y", "12", "X" * 9, "", " ", "\u3000", "x\ty", "日本", "'s", "\xa0"]
    texts += [" ".join(draw.choice(words) for _ in range(draw.randint(1, 40))) for _ in range(400)]
    plain = align.plain_texts(pa.array([" " + t for t in texts])).tolist()
    assert 0 < sum(plain) < len(texts)
    for text, p in zip(texts, plain, strict=True):
        assert one.encode(" " + text, p) == libraries[0].encode(" " + text, add_special_tokens=False).ids
    assert align.plain_texts(pa.array(["", "a", " " * 399, "b", " " * 400, "é", "Ȁ", "ʰ", None])).tolist() == [True, True, True, True, False, True, True, False, True]


@pytest.mark.parametrize("seed", range(4))
def test_common_ends_and_links(seed):
    rng = np.random.default_rng(seed)
    texts = []
    for _ in range(60):
        n = int(rng.integers(0, 200))
        cut = lambda share, n=n: np.unique(np.append(np.flatnonzero(rng.random(n) < share) + 1, n)) if n else np.zeros(0, np.int64)
        texts.append((cut(rng.random()), cut(rng.random()), n))
    base = np.concatenate([[0], np.cumsum([n for *_, n in texts])])
    sides = [np.concatenate([t[k] + x for t, x in zip(texts, base[:-1], strict=True)]).astype(np.int64) for k in (0, 1)]
    text, at, to = align.common_ends(sides[0], np.array([len(t[0]) for t in texts]), sides[1], np.array([len(t[1]) for t in texts]))
    both, x, y = np.intersect1d(*sides, return_indices=True)
    assert at.tolist() == x.tolist() and to.tolist() == y.tolist() and text.tolist() == (np.searchsorted(base, both - 1, "right") - 1).tolist()
    m, n = np.diff(at, prepend=-1), np.diff(to, prepend=-1)
    a, b = rng.integers(0, 9, m.sum()), rng.integers(0, 9, n.sum())
    results = []
    for wide in (10**9, 3):
        align.WIDE, keep = wide, align.WIDE
        group, pair, times = align.links(a, b, m, n)
        align.WIDE = keep
        own = Counter()
        for g, p, t in zip(group.tolist(), pair.tolist(), times.tolist(), strict=True):
            own[g, p] += t
        results.append(own)
    assert results[0] == results[1] and sum(results[0].values()) == int((m * n).sum())


def test_groups(spark, libraries):
    docs = documents()[:40]
    rows = align.aligned(spark.createDataFrame(docs, "doc_id long, text string, x string"), A_PATH, P.PATTERN, B_PATH)
    got = sorted((r["doc_id"], r["group"], r["a_ids"], r["b_ids"]) for r in align.groups_of(rows).collect())
    assert got == sorted((i, k, g, h) for i, t, _ in docs for k, (g, h) in enumerate(plain_groups(t, libraries)[2]))
