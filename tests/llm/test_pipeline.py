"""The pipeline against plain Python versions of its stages."""

import random
import shutil

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from widestat.llm import stages

from . import test_decontaminate, test_line_dedup, test_simhash
from .test_quality import brute as base_measures

SOURCES = ["a", "b", None]


def corpus(seed=3):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(2000)]

    def sentence():
        return " ".join(rng.choices(vocabulary, k=rng.randint(4, 20))).capitalize() + "."

    items = [(i, " ".join(rng.choices(vocabulary, k=20))) for i in range(5)]
    boiler = "All rights of this collection stay with the owners of the collection."
    rows = []
    for i in range(90):
        lines = [" ".join(sentence() for _ in range(4)) for _ in range(4)]
        if i % 4 == 0:
            lines.append(boiler)
        if i % 9 == 0:
            lines[1] += " " + items[i % 5][1] + "."
        if i % 11 == 0:
            lines = ["short " * (i % 30)]
        rows.append((i, "\n".join(lines), "en", SOURCES[i % 3]))
    rows.append((95, rows[1][1], "en", "b"))                                   # an exact copy
    rows.append((96, rows[2][1].upper().capitalize(), "en", "b"))              # the same but for case
    rows.append((97, None, "en", "a"))
    return rows, items


@pytest.fixture
def tables(spark, docs, tmp_path):
    rows, items = corpus()
    d = str(tmp_path)
    docs(rows).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 90, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d, rows, items


def brute(rows, items):
    """{id: text} after each of the first four stages; no rule is certified on
    45 labels, so the base rule decides alone."""
    out = [{r[0]: r[1] for r in rows if not base_measures(r[1])[5]}]
    kept = test_line_dedup.brute(list(out[0].items()))
    out.append({d: "\n".join(x for i, x in enumerate(t.split("\n")) if kept.get((d, i), True)) for d, t in out[0].items()})
    ids = sorted(out[1])
    group = test_simhash.brute_components([(d, test_simhash.brute_print(out[1][d])) for d in ids])
    out.append({d: out[1][d] for d, c in zip(ids, group) if c == d})
    out.append({d: t for d, t in out[2].items() if not any(test_decontaminate.brute(t, b) for _, b in items)})
    return out


def test_every_stage_equals_brute_force(spark, tables):
    d, rows, items = tables
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for (name, stage), want in zip(corpus_pipeline.STAGES, brute(rows, items)):
        after = stage(spark, docs, d)
        assert after.columns == docs.columns, name
        got = {r.doc_id: r.text for r in after.collect()}
        assert got == want, name
        assert len(got) < len(rows) and all(r.n_chars == len(r.text) for r in after.collect())
        docs = after
    assert len(want) > 20


def test_run_mixes_what_the_stages_keep(spark, tables):
    d, rows, items = tables
    want = brute(rows, items)[-1]
    out = corpus_pipeline.run(spark, d).collect()
    assert {r.doc_id: r.size for r in out} == {i: len(t.split()) for i, t in want.items()}
    source = {r[0]: r[3] for r in rows}
    for s in SOURCES:
        part = [r for r in out if source[r.doc_id] == s]
        assert sum(r.size for r in part) == part[0].source_size
        assert abs(sum(r.taken for r in part) - part[0].target) <= max(r.size for r in part) / 2
        assert all(r.taken <= 3 * r.size for r in part)


def test_extra_columns_and_null_ids_pass_through(spark, tables, docs):
    d, rows, _ = tables
    extra = docs([(None, rows[1][1]), (500, rows[3][1]), (500, rows[3][1])] + rows[:40])
    for name in ("id", "fp", "size", "component_id", "kept", "node", "u", "h1", "line_no", "stratum", "__x"):
        extra = extra.withColumn(name, F.lit("clash"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, extra, d)
        assert out.columns == extra.columns and out.where("node <> 'clash'").count() == 0, name
        assert out.where("doc_id is null").count() == (name != "simhash"), name  # a copy of another row
    assert stages.mixed(spark, extra, d).count() == extra.count()


def test_rows_without_an_id_of_their_own_stay_or_go_alone(spark, tables, docs):
    """Two null ids and two equal ids with different texts, and equal rows: a
    text is never lost because another row with its id goes."""
    d, _, items = tables
    rng = random.Random(9)

    def own():
        return " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(80))
    clean = [own() for _ in range(6)]
    dirty = f"{own()} {items[0][1]} {own()}"
    for a, b in ((None, None), (700, 700)):
        def left(stage, rows):
            return sorted(((r.doc_id, r.text) for r in stage(spark, docs(rows), d).collect()), key=repr)
        kept = [(a, clean[0]), (1, clean[1])]
        assert left(stages.quality_kept, [*kept, (b, "too short")]) == sorted(kept, key=repr)
        assert left(stages.decontaminated, [*kept, (b, dirty)]) == sorted(kept, key=repr)
        assert left(stages.lines_deduped, [*kept, (b, f"{clean[1]}\n{clean[2]}")]) == sorted([*kept, (b, clean[2])], key=repr)
        copies = [(1, clean[1]), (b, clean[1]), (b, clean[3]), (b, clean[4])]
        assert left(stages.near_deduped, copies) == sorted([(1, clean[1]), (b, clean[3]), (b, clean[4])], key=repr)
        assert left(stages.near_deduped, [(a, clean[5])] * 5 + [(b, clean[0])]) == sorted([(a, clean[5]), (b, clean[0])], key=repr)
    both = docs([(3, clean[0], "en", "x"), (3, clean[0], "de", "y")] * 3)
    one = stages.near_deduped(spark, both, d).collect()
    assert len(one) == 1 and one == stages.near_deduped(spark, both.repartition(1), d).collect()


def test_empty_documents(spark, tables, docs):
    d = tables[0]
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs([]), d).count() == 0, name


def test_registered_and_removable(tmp_path):
    """Without this subpackage the entry still imports, with the other queries."""
    import os
    import subprocess
    import sys

    assert {"pipeline", *(n for n in E.queries() if n.startswith("op"))} >= {"pipeline", "op1_decontaminate", "op10_lm_score"}
    assert sum(n.startswith("op") for n in E.queries()) == 13
    root = os.path.dirname(os.path.abspath(E.__file__))
    shutil.copytree(root, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert set(q) == set(e.oracle_sql()) and 'pipeline' not in q and len(q) > 50"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True, timeout=120)
