import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from widestat.llm import packing
from widestat.llm.queries import tokenizer_path

PATH = tokenizer_path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def ids_of(tokenizer, text):
    return np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [2], "<u4")


def checked(out, rows, tokenizer, window=4096):
    """Every id lies in one piece, sequences are gapless, checksums fit; returns
    padding and tokens."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in out:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    docs = defaultdict(list)
    for key, text in rows:
        docs[key].append(ids_of(tokenizer, text))
    assert set(by_doc) == set(docs)
    for key, many in docs.items():
        found = by_doc[key]
        assert sum(r["length"] for r in found) == sum(map(len, many))
        if len(many) == 1:
            at = 0
            for r in sorted(found, key=lambda r: r["start"]):
                assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(many[0])
                assert r["ids_crc32"] == zlib.crc32(many[0][at:at + r["length"]].tobytes())
                at += r["length"]
            assert at == len(many[0])
    padding = 0
    for found in by_sequence.values():
        at = 0
        for r in sorted(found, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding, sum(len(x) for many in docs.values() for x in many)


def corpus(n, seed=3, most=9000):
    rng = random.Random(seed)
    words = ["the", "packing", "of", "Sequences", "élan,", "(x)", "1999", "it's", "..."]
    return [(i, " ".join(rng.choices(words, k=min(most, int(rng.lognormvariate(5.5, 1.3)))))) for i in range(n)]


def test_pack_is_whole_and_tight(spark, docs, tokenizer):
    rows = corpus(1500)
    padding, tokens = checked(packing.digest(docs(rows), PATH).collect(), rows, tokenizer)
    assert padding <= 0.02 * tokens


def test_hot_length_long_texts_nulls_and_clashes(spark, docs, tokenizer):
    rows = [(i, "same text here") for i in range(900)] + [(1000 + i, None) for i in range(5)] + [(2000, ""), (2001, " \n"), (2002, "a " * 50_000)]
    rows += [(3000 + i, "b " * 2100) for i in range(20)] + [(None, "no id"), (None, "no id"), (4000, "twice"), (4000, "twice too")]
    df = docs(rows)
    for name in ("key", "unit", "cls", "nth", "length", "part", "doc", "pieces", "offset", "t"):
        df = df.withColumn(name, F.lit("clash"))
    padding, tokens = checked(packing.digest(df, PATH).collect(), rows, tokenizer)
    assert padding <= 0.02 * tokens


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "a b c d e f")], [(1, "w " * 4095)], [(1, "w " * 4096)], [(1, "w " * 8191), (2, "x")]])
def test_few_rows(docs, tokenizer, rows):
    out = packing.digest(docs(rows), PATH)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    padding, _ = checked(out.collect(), rows, tokenizer)
    assert padding <= 8  # what is left over is cut into powers of two


def test_words_equal_whole_texts(tokenizer):
    rng = random.Random(5)
    pieces = ["the", "The", "ÉLAN", "ß", "'s", "N'T", "'LL", "!!", "42", "x1y", "日本", "́", "é", "ﬁ", "İ", "Σ", "ΟΔΟΣ", "<|endoftext|>", "<|ENDOFTEXT|>",
              "µ", "ª", "×", "÷", "\x00", "\x1c", "\x85", " ", "", "😀", "_", "-", "ǅ", "｡"]
    encoder = packing.WordEncoder(PATH)
    for _ in range(4000):
        text = "".join(rng.choice(pieces) + rng.choice(("", "", " ", "\n", "\t ", "  ")) for _ in range(rng.randint(1, 25)))
        assert encoder.ids(text.encode()) == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), repr(text)


def test_least_squares():
    """A histogram made of combinations is found again; all stays non-negative."""
    combos = packing.combinations(16)
    assert all(sum(k * m for k, m in c) == 16 for c in combos) and len(set(combos)) == len(combos)
    rng = random.Random(1)
    histogram = defaultdict(int)
    for c in rng.sample(combos, 12):
        for k, m in c:
            histogram[k] += 50 * m
    plan = packing.planned(histogram, 16)
    used = defaultdict(int)
    for c, times in plan:
        assert times > 0
        for k, m in c:
            used[k] += times * m
    assert all(used[k] <= histogram[k] for k in used)
    assert sum(k * n for k, n in used.items()) >= 0.97 * sum(k * n for k, n in histogram.items())


def test_nnls_equals_projected_gradient():
    rng = np.random.default_rng(2)
    place = np.array([rng.choice(9, 3, replace=False) for _ in range(25)])
    times = rng.integers(1, 4, (25, 3)).astype(float)
    b = rng.integers(0, 50, 9).astype(float)
    a = np.zeros((9, 25))
    for j in range(25):
        a[place[j], j] += times[j]
    x = np.zeros(25)
    for _ in range(200_000):
        x = np.maximum(0, x - (a.T @ (a @ x - b)) / np.linalg.norm(a, 2) ** 2)
    found = packing.nnls(place, times, b, 100)
    assert (found >= 0).all() and abs(np.linalg.norm(a @ found - b) - np.linalg.norm(a @ x - b)) < 1e-3
