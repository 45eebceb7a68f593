import itertools
import random

import pytest
from pyspark.sql import functions as F

from widestat.llm import mixing as M

from .conftest import by_id


def test_quotas():
    assert M.quotas({"a": 100, "b": 100, "c": 100}) == {"a": 50.0, "b": 100.0, "c": 150.0}
    got = M.quotas({"a": 1000, "b": 10, None: 90, "c": 0})  # weights 1 2 1 3 in the order a b c null: 1, 2, 3, 1
    assert got["b"] == 30.0 and got["c"] == 0.0 and sum(got.values()) == pytest.approx(1100)
    assert got[None] == 270.0 and got["a"] == pytest.approx(800)
    assert M.quotas({}) == {} and M.quotas({"a": 0}) == {"a": 0.0}


def brute_flow(capacity, members, quota, passes=3):
    """(words routed, least cost) over all integer routings."""
    arcs = [(p, s) for p in capacity for s in members[p]]
    best = None
    for amounts in itertools.product(*(range(min(passes * capacity[p], quota[s]) + 1) for p, s in arcs)):
        out, into = {p: 0 for p in capacity}, {s: 0 for s in quota}
        for (p, s), n in zip(arcs, amounts):
            out[p] += n
            into[s] += n
        if all(out[p] <= passes * capacity[p] for p in out) and all(into[s] <= quota[s] for s in into):
            cost = sum(max(0, out[p] - k * capacity[p]) for p in out for k in range(1, passes))
            key = (-sum(amounts), cost)
            best = key if best is None else min(best, key)
    return best


@pytest.mark.parametrize("seed", range(12))
def test_flow_is_optimal(seed):
    rng = random.Random(seed)
    sources = ["a", "b", "c"]
    capacity = {p: rng.randint(0, 2) for p in "xyz"}
    members = {p: rng.sample(sources, rng.randint(1, 2)) for p in capacity}
    quota = {s: rng.randint(0, 4) for s in sources}
    flow = M.route(capacity, members, quota)
    routed = sum(n for x in flow.values() for n in x.values())
    cost = sum(max(0, sum(x.values()) - k * capacity[p]) for p, x in flow.items() for k in range(1, 3))
    assert (-routed, cost) == brute_flow(capacity, members, quota)
    for s in sources:
        assert sum(x.get(s, 0) for x in flow.values()) <= quota[s]
    assert all(sum(x.values()) <= 3 * capacity[p] for p, x in flow.items())


def corpus(n, seed):
    rng = random.Random(seed)
    return [(i, "w " * rng.choice((0, 1, 5, 40, 200)), "en", f"s{rng.randrange(6)}" if i % 17 else None) for i in range(n)]


def test_contract(docs):
    rows = corpus(600, 2)
    got = M.digest(docs(rows))
    assert got.columns == ["doc_id", "size", "source_size", "target", "taken"]
    out = got.collect()
    assert len(out) == len(rows)
    size = {s: sum(t.count("w") for _, t, _, x in rows if x == s) for s in {r[3] for r in rows}}
    target = M.quotas(size)
    taken = dict.fromkeys(size, 0)
    texts = {r[0]: r for r in rows}
    for r in out:
        s = texts[r.doc_id][3]
        assert r.size == texts[r.doc_id][1].count("w") and r.source_size == size[s] and r.target == pytest.approx(target[s])
        assert r.taken in {r.size * k for k in range(4)}
        taken[s] += r.taken
    for s in size:
        assert abs(taken[s] - target[s]) <= 100  # half of the largest document
    assert sorted(map(tuple, M.digest(docs(rows, 7)).collect())) == sorted(map(tuple, out))  # reruns agree


def test_overlapping_sources(docs, spark):
    rows = [(i, "w " * 10, "en", "a" if i < 50 else "b") for i in range(100)]
    sources = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("a"), F.lit("b"), F.lit("a"))).otherwise(F.array("source"))
    mixed, report = M.mix(docs(rows), sources)
    sizes = {s: size for s, size, _, _ in report}
    assert sizes == {"a": 750, "b": 750}
    assert {s: round(t) for s, _, t, _ in report} == {s: n for s, _, _, n in report}
    out = mixed.collect()
    assert sum(r.taken for r in out) == pytest.approx(1500, abs=10) and max(r.passes for r in out) <= 3


def test_hot_source_and_repeated_rows(docs):
    rows = [(7, "w w w", "en", "a")] * 40 + [(i, "w " * (i % 9), "en", "b") for i in range(100, 400)] + [(None, None, "en", "b")]
    out = M.digest(docs(rows)).collect()
    assert len(out) == len(rows)
    for s, ids in (("a", {7}), ("b", set(range(100, 400)) | {None})):
        part = [r for r in out if r.doc_id in ids]
        assert abs(sum(r.taken for r in part) - part[0].target) <= 125
        assert all(r.taken <= 3 * r.size for r in part)


def test_edge_tables(docs):
    assert M.digest(docs([])).count() == 0
    only = M.digest(docs([(1, None), (2, "")])).collect()
    assert [(r.size, r.taken, r.target) for r in only] == [(0, 0, 0.0)] * 2
    clash = docs([(1, "a b")]).withColumn("size", F.lit("x")).withColumn("pattern", F.lit("y")).withColumn("id", F.lit(0))
    assert [tuple(r) for r in M.digest(clash).collect()] == [(1, 2, 2, 2.0, 2)]


def test_too_many_source_sets(docs, monkeypatch):
    monkeypatch.setattr(M, "MAX_PATTERNS", 2)
    with pytest.raises(ValueError):
        M.digest(docs([(i, "w", "en", f"s{i}") for i in range(5)]))


def test_whole_table(spark):
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = by_id(M.digest(documents))
    for r in documents.collect():
        assert out[r.doc_id].size == len(r.text.encode().split()) and out[r.doc_id].taken <= 3 * out[r.doc_id].size


def test_rows_without_an_id_of_their_own_are_picked_singly(docs):
    """Null ids, one id with many texts, and true repeats: the target is met to
    half a row, on any layout."""
    size = 10
    for rows in ([(None, "w " * size + str(i), "en", "a") for i in range(60)], [(7, "w " * size + str(i), "en", "a") for i in range(60)],
                 [(7, "w " * size + "x", "en", "a")] * 60):
        rows = rows + [(i, "w " * size + "x", "en", "b") for i in range(100, 145)]
        out = [M.digest(docs(rows, n)).collect() for n in (3, 5)]
        assert sorted((r.doc_id or 0, r.taken) for r in out[0]) == sorted((r.doc_id or 0, r.taken) for r in out[1])
        for ids in ({None, 7}, set(range(100, 145))):
            part = [r for r in out[0] if r.doc_id in ids]
            assert len(part) in (60, 45) and abs(sum(r.taken for r in part) - part[0].target) <= (size + 1) / 2


def test_giants_and_small_documents(docs):
    """One document of 3,000 words among many of ten: every source comes within
    the smallest document of its target, whatever the order."""
    for seed in range(3):
        rows = [(1000 * k + i, "w " * (3000 if i == 0 else 10), "en", s) for k, s in enumerate("ab") for i in range(401)]
        mixed, report = M.mix(docs(rows), F.array("source"), seed=seed)
        taken = {}
        for r in mixed.collect():
            taken[r.sources[0]] = taken.get(r.sources[0], 0) + r.taken
            assert r.taken <= 3 * r.size
        for s, _, target, _ in report:
            assert abs(taken[s] - target) <= 10, (seed, s)
