import hashlib
import os
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from widestat.llm import merkle

COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[3], row[2], row[4], text)))


def tree(nodes):
    """The root and, for every node, its steps (left, right) upwards."""
    steps, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for i, p in enumerate(at):
            lo = p - p % 3
            steps[i].append((level[lo:p], level[p + 1:lo + 3]))
        level = [H(*level[i:i + 3]) for i in range(0, len(level), 3)]
        at = [p // 3 for p in at]
    return level[0], steps


def brute(rows):
    """rows (doc_id, text, lang, source, n_chars)"""
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    subs, within = {}, {}
    for s in names:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        subs[s], within[s] = tree([leaf(r, r[1]) for r in by[s]])
    if not names:
        return []
    root, above = tree([subs[s] for s in names])
    out = []
    for k, s in enumerate(names):
        for r, steps in zip(by[s], within[s]):
            steps = steps + above[k]
            own = leaf(r, r[1])
            now = own
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                now = leaf(r, None if r[1] is None else r[1].replace("\n", ""))
            for left, right in steps:
                now = H(*left, now, *right)
            out.append((r[0], own, subs[s], root, H(*(x for a, b in steps for x in a + b)), now, now == root))
    return out


def rows_of(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def corpus(sizes, seed=1):
    rng = random.Random(seed)
    rows = []
    for s, n in sizes.items():
        for _ in range(n):
            text = "".join(rng.choice(("a", "é", "\n", " ", "x" * 50)) for _ in range(rng.randint(0, 8)))
            rows.append((len(rows) * 7 % 100_003, text, "en", s, len(text)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 4, None: 1}, {"a": 10, "b": 27, "é": 28, None: 2, **{f"s{i}": 1 + i % 5 for i in range(30)}}])
def test_equals_brute_force(spark, docs, sizes):
    rows = corpus(sizes)
    assert rows_of(merkle.digest(docs(rows))) == sorted(brute(rows), key=repr)


def test_several_tiers(spark, docs):
    """A group of more than a block, one of exactly a block, one of a block and one."""
    rows = corpus({"hot": 2500, "one": merkle.BLOCK, "more": merkle.BLOCK + 1, "few": 5})
    assert rows_of(merkle.digest(docs(rows))) == sorted(brute(rows), key=repr)


def test_three_tiers(spark, docs, monkeypatch):
    monkeypatch.setattr(merkle, "DIGITS", 2)
    monkeypatch.setattr(merkle, "BLOCK", 9)
    rows = corpus({"hot": 300, "b": 9, "c": 10, **{f"s{i}": 1 for i in range(12)}})
    assert rows_of(merkle.digest(docs(rows))) == sorted(brute(rows), key=repr)


def test_nulls_ties_and_clashing_columns(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(None, None, None, None, None), (None, "x\ny", "en", "a", 3), (1, "p\nq", "en", "a", 3), (1, "p\nq", "en", "a", 3),
            (1, "other", "de", "a", 5), (2, "", None, "a", 0), (3, "long " * 200_000, "en", "b", 1_000_000), (4, "- \n", "en", "", 3)]
    df = spark.createDataFrame(rows, schema)
    for name in ("grp", "id", "hash", "rank", "n", "info", "kids", "path", "top", "place", "part", "lost"):
        df = df.withColumn(name, F.lit("clash"))
    assert rows_of(merkle.digest(df)) == sorted(brute(rows), key=repr)


def test_empty(docs):
    out = merkle.digest(docs([]))
    assert out.columns == list(COLUMNS) and out.count() == 0


def test_proofs_detect_changes(spark, docs):
    rows = corpus({"a": 30, "b": 4})
    found = merkle.manifest(docs(rows))
    good = found.where(merkle.folded(F.col("leaf"), F.col("path")) == F.col("root"))
    assert good.count() == len(rows)
    assert found.where(merkle.folded(F.sha2("leaf", 256), F.col("path")) == F.col("root")).count() == 0


def test_sql(spark, docs, tmp_path):
    rows = corpus({"a": 40, "b": 3, None: 1, "é": 12}) + [(None, "n\n", None, "b", 2)]
    docs(rows).coalesce(1).write.parquet(str(tmp_path / "d"))
    file = next(f for f in os.listdir(tmp_path / "d") if f.endswith(".parquet"))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/d/{file}'")
    got = con.sql(f"select {', '.join(COLUMNS)} from ({merkle.oracle_sql()})").fetchall()
    assert sorted(got, key=repr) == sorted(brute(rows), key=repr)
