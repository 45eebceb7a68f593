import random

import numpy as np
import pytest
import xxhash

from widestat.llm import simhash
from widestat.llm.components import components

from .conftest import by_id


def brute_print(text, k=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r " else c for c in low).split(" ") if w]
    grams = [" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(prints, most=4):
    """{row: least id reachable} over rows (id, fingerprint)."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= most:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(prints):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(prints))]


def test_fingerprint():
    for text in ("", " \n", "one", "One two\tTHREE", "a b c d", "a b c d e", "a b a b a b a b", "É Ñ ß words here now İ K",
                 "x y z\x85w a b c", "w " * 30_000):
        assert simhash.fingerprint(text, 4) == brute_print(text), text


def test_spark_hash_is_the_same(spark):
    assert spark.sql("select xxhash64('a b c d')").first()[0] & (2**64 - 1) == xxhash.xxh64_intdigest(b"a b c d", 42)


def clustered(n, seed):
    rng = random.Random(seed)
    out = {0}
    while len(out) < n:
        x = rng.getrandbits(64)
        out.add(x)
        for _ in range(rng.choice((0, 0, 1, 5, 40))):
            for _ in range(rng.randint(1, 4)):
                x ^= 1 << rng.randrange(64)
            out.add(x)
    return sorted(out)[:n]


@pytest.mark.parametrize("seed", [1, 2])
def test_walk_finds_every_pair(seed):
    values = np.array(clustered(700, seed), np.uint64)
    got = set()
    simhash.walk(values, values, 0, 0, True, 4, lambda i, j: got.update(zip(i.tolist(), j.tolist())))
    want = {(i, j) for j in range(len(values)) for i in range(j) if (int(values[i]) ^ int(values[j])).bit_count() <= 4}
    assert got == want and want


@pytest.mark.parametrize("node_size", [4, 64, 16_384])
def test_join_equals_brute_force(spark, node_size):
    values = clustered(500, 5)
    signed = [x - (1 << 64) if x >> 63 else x for x in values]
    distinct = spark.createDataFrame([(x,) for x in signed], "fp long")
    roots = {r.node: r.root for r in components(simhash.near_links(distinct, 4, node_size)).collect()}
    want = brute_components(list(enumerate(values)))
    mine = [roots.get(x, x) for x in signed]
    pairs = set(zip(mine, want))
    assert len(pairs) == len(set(mine)) == len(set(want))  # the same partition


def test_dense_group_stays_linear():
    base = 0x1234567890ABCDEF
    values = np.array(sorted({base ^ (1 << i) ^ (1 << j) for i in range(64) for j in range(64)}), np.uint64)
    u, v = simhash.linked(values, values, 0, 0, True, 4)
    assert len(u) == len(values) - 1


def test_whole_table(spark):
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = simhash.digest(simhash.near_duplicates(documents, node_size=16))
    assert out.columns == ["doc_id", "fingerprint", "component_id"]
    rows = documents.orderBy("doc_id").collect()
    prints = [(r.doc_id, brute_print(r.text)) for r in rows]
    got = by_id(out)
    for (d, fp), c in zip(prints, brute_components(prints)):
        assert got[d].fingerprint == f"{fp:016x}" and got[d].component_id == c


def test_edge_rows(docs):
    from pyspark.sql import functions as F

    rows = [(5, None), (3, ""), (7, " \n"), (9, "one two three four five"), (9, "one two three four five"),
            (None, "one two three four five"), (None, "something else entirely here now"), (11, "w " * 50_000)]
    out = simhash.near_duplicates(docs(rows).withColumn("fp", F.lit("clash")).withColumn("id", F.lit(1)))
    assert out.count() == len(rows)
    by = {}
    for r in out.collect():
        by.setdefault(r.doc_id, []).append(r.component_id)
    assert by[3] == by[5] == by[7] == [3] and by[9] == [9, 9] and sorted(by[None], key=str) == [9, None] and by[11] == [11]
    assert simhash.near_duplicates(docs([])).count() == 0


def test_components(spark):
    edges = [(1, 2), (2, 1), (3, 2), (4, 4), (None, 1), (9, 8)] + [(i, i + 1) for i in range(20, 60)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8} | {i: 20 for i in range(20, 61)}
