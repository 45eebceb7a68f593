import random
import time

import numpy as np
from pyspark.sql import functions as F

from widestat.llm import decontaminate as D


def brute(doc, item, need=D.MIN_MATCH):
    """Best stretch over all diagonals, common words less substitutions."""
    a, b = D.words(doc or ""), D.words(item or "")
    if len(b) < need:
        return bool(b) and a == b
    best = 0
    for shift in range(-len(b) + 1, len(a)):
        score = run = 0
        for i in range(max(0, shift), min(len(a), shift + len(b))):
            run, score = (run + 1, score + 1) if a[i] == b[i - shift] else (run, score - 1)
            if score <= 0:
                score = run = 0
            best = max(best, run)
    return best >= min(need, len(b) - len(b) // 5)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(15, 40)))) for i in range(12)]
    docs = []
    for i in range(60):
        body = rng.choices(vocabulary, k=rng.randint(5, 120))
        if i % 3 == 0:
            part = items[i % 12][1].split()
            for _ in range(i % 5):
                part[rng.randrange(len(part))] = "changed"
            at = rng.randrange(len(body))
            body[at:at] = part
        docs.append((i, " ".join(body).capitalize() + "."))
    return docs, items


def test_equals_brute_force(spark, docs):
    rows, items = corpus(3)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in D.find_overlaps(docs(rows), benchmark).collect()}
    want = {(d, i) for d, t in rows for i, b in items if brute(t, b)}
    assert got <= want and len(got) >= 0.95 * len(want)  # seeds may miss badly broken copies
    assert {d for d, _ in got} == {d for d, _ in want}


def test_blocks_give_the_same(spark, docs):
    rows, items = corpus(4)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    one = sorted(map(tuple, D.find_overlaps(docs(rows), benchmark).collect()))
    assert one == sorted(map(tuple, D.find_overlaps(docs(rows), benchmark, block_words=200).collect())) and one


def test_substitutions_and_boundaries(spark, docs):
    item = " ".join(f"k{i}" for i in range(20))
    changed = item.split()
    for i in (4, 9, 14):
        changed[i] = "zz"
    rows = [(1, "A b. " + item.upper() + "!"), (2, "x " + " ".join(changed)), (3, " ".join(item.split()[:9])),
            (4, None), (5, ""), (6, "Hello, world"), (None, item), (1, "A b. " + item.upper() + "!"), (8, "y " * 100_000 + item)]
    benchmark = spark.createDataFrame([(7, item), (8, "hello world"), (9, None), (10, "..."), (None, item)],
                                      "item_id long, text string")
    got = sorted(map(tuple, D.find_overlaps(docs(rows), benchmark).collect()), key=repr)
    flat = {(d, i): (a, b, n) for d, i, a, b, n in got}
    assert flat[(1, 7)] == (2, 22, 20) and flat[(2, 7)] == (1, 21, 17) and flat[(6, 8)] == (0, 2, 2)
    assert flat[(8, 7)] == (100_000, 100_020, 20) and (None, 7) in flat and (1, None) in flat
    assert not {3, 4, 5} & {d for d, _ in flat} and sum(d == 1 and i == 7 for d, i, *_ in got) == 2


def test_empty_tables(spark, docs):
    benchmark = spark.createDataFrame([], "item_id long, text string")
    assert D.find_overlaps(docs([(1, "a b c")]), benchmark).count() == 0
    assert D.find_overlaps(docs([]), spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0


def test_removal_goes_by_id_and_text(spark, docs):
    item = " ".join(f"k{i}" for i in range(20))
    rows = docs([(1, item), (2, "clean text"), (None, item), (None, "clean, no id"), (3, item + " more"), (3, "clean, shared id"), (4, None)])
    benchmark = spark.createDataFrame([(7, item)], "item_id long, text string")
    left = D.remove_contaminated(rows.withColumn("item", F.lit("clash")).withColumn("__row", F.lit(1)), benchmark)
    assert sorted((r.doc_id or 0, r.text or "") for r in left.collect()) == [(0, "clean, no id"), (2, "clean text"), (3, "clean, shared id"), (4, "")]


def test_repeated_words_cost_their_diagonals():
    rng = random.Random(3)
    index = D.Index([(1, "same " * 1000), (2, " ".join(rng.choice("ab") for _ in range(300)))], D.MIN_MATCH)
    begun = time.monotonic()
    assert index.matches("same " * 4000) == [(1, 0, 1000, 1000)]
    assert index.matches("a b " * 3000)[0][0] == 2
    assert time.monotonic() - begun < 5


def test_runs_and_intervals():
    h, owner, at = np.array([5, 5, 5, 5, 9], np.uint64), np.array([0, 0, 0, 1, 1]), np.array([2, 3, 7, 8, 9])
    assert [x.tolist() for x in D.runs(h, owner, at)] == [[5, 5, 5, 9], [0, 0, 1, 1], [2, 7, 8, 9], [3, 7, 8, 9]]
    assert [x.tolist() for x in D.merged(np.array([8, 1, 3, 20]), np.array([9, 4, 3, 22]))] == [[1, 8, 20], [4, 9, 22]]
    empty = np.empty(0, np.int64)
    assert [len(x) for x in (*D.runs(empty, empty, empty), *D.merged(empty, empty))] == [0] * 6
