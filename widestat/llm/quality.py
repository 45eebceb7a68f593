"""Quality rules with risk-controlled thresholds.

Every document gets counts and ratios (see ``measures``).  Each rule rejects
documents whose ratio lies beyond a cutoff.  Its cutoffs form a fixed ladder,
from lenient to strict, and the strictest one that is safe is chosen for every
stratum: on the labelled good documents of the stratum that pass the base
rule, ``n`` of them, ``k`` are rejected by the cutoff, and the exact binomial
tail P(Bin(n, risk) <= k) must not exceed the error level.  The ladder is
climbed until the first cutoff that fails, which keeps the error of the climb
at one test's; the level is ``delta`` over the number of strata times rules
(Bonferroni).  So with probability 1 - ``delta`` no rule rejects more than its
``risk`` of the good documents of any stratum, and all rules together no more
than ``alpha``.  A stratum with too few labels gets no cutoff and keeps
everything that passes the base rule.

Base rule: fewer than 50 words, or more than half of the words inside repeated
three-word windows.

All of it is built-in column functions and aggregates: the counts of a text
come from array functions over its words, the tail from a fold over a sequence.

A null or empty text has no words, so it fails the base rule.  Repeated rows
are each judged.  A null stratum is a stratum; a null id has no label.  A
document is good if all its labels say quality 1; null labels are left out.
Window identity is a 64-bit hash of the three words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from widestat.llm.common import WHITE, let, materialized, text_of

SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MIN_WORDS = 50
ALPHA, DELTA = 0.01, 0.05

#: (rule, ratio, ladder of cutoffs from lenient to strict): a document is
#: rejected if its ratio exceeds the cutoff.  Fixed before any label is seen.
RULES = (
    ("symbols", "n_symbols / word_chars", (0.5, 0.35, 0.25, 0.18, 0.12, 0.08, 0.05, 0.03)),
    ("dup_lines", "n_dup_lines / n_lines", (0.9, 0.75, 0.6, 0.5, 0.4, 0.3)),
    ("repeats", "n_repeat_words / n_words", (0.45, 0.4, 0.35, 0.3, 0.25, 0.2)),
    ("capitals", "n_capitals / word_chars", (0.8, 0.65, 0.5, 0.4, 0.3, 0.2)),
    ("long_words", "word_chars / n_words", (40.0, 30.0, 20.0, 15.0, 12.0)),
)


def without(text: Column, chars: str) -> Column:
    """Length of the text without these characters."""
    return F.length(F.translate(text, chars, ""))


def words_of(text: Column) -> Column:
    inner = F.btrim(text, F.lit(WHITE))
    return F.when(F.length(inner) == 0, F.array().cast("array<string>")).otherwise(F.split(inner, r"[\x20\x09-\x0D]+"))


def repeated_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more."""
    def covered(hashes: Column) -> Column:
        by_hash = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            twice = F.filter(s, lambda x, i: F.get(s, i - 1)["h"].eqNullSafe(x["h"]) | F.get(s, i + 1)["h"].eqNullSafe(x["h"]))
            return F.sort_array(F.transform(twice, lambda x: x["i"]))

        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        return F.aggregate(let(by_hash, places), start, lambda a, x: F.struct(
            (a["n"] + x + 3 - F.greatest(x, a["end"])).alias("n"), (x + 3).alias("end")), lambda a: a["n"])

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def counted(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(covered(hashes))

    return let(words, lambda w: F.when(F.size(w) < 4, 0).otherwise(let(windows(w), counted)))


def measures(docs: DataFrame, stratum: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_hash, stratum, counts, base_failed), one row for each input row."""
    text = text_of(text_col)
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(WHITE))) > 0)
    counted = docs.select(
        F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"), F.col(stratum).alias("stratum"),
        let(words_of(text), lambda w: F.struct(F.size(w).alias("n"), repeated_words(w).alias("r"))).alias("w"),
        without(text, WHITE).cast("long").alias("word_chars"),
        (F.length(text) - without(text, SYMBOLS)).cast("long").alias("n_symbols"),
        (F.length(text) - without(text, CAPITALS)).cast("long").alias("n_capitals"),
        let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("d"))).alias("l"))
    return counted.select(
        "id", "text_hash", "stratum", F.col("w.n").cast("long").alias("n_words"), "word_chars", "n_symbols",
        F.col("l.d").cast("long").alias("n_dup_lines"), F.col("w.r").cast("long").alias("n_repeat_words"),
        F.col("l.n").cast("long").alias("n_lines"), "n_capitals").withColumn(
        "base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def ratio(rule: tuple) -> Column:
    top, bottom = rule[1].split(" / ")
    return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))


def log_tail(n: Column, k: Column, risk: float) -> Column:
    """ln P(Bin(n, risk) <= k), for k at most n * risk; null beyond, where the
    tail is no evidence.  A fold over i = 0..k of the logarithms of the terms."""
    log_odds = F.log(F.lit(risk)) - F.log1p(F.lit(-risk))
    first = F.struct((n * F.log1p(F.lit(-risk))).alias("term"), (n * F.log1p(F.lit(-risk))).alias("total"))

    def step(a: Column, i: Column) -> Column:
        term = a["term"] + F.log((n - i + 1) / i) + log_odds
        more = F.greatest(a["total"], term) + F.log1p(F.exp(-F.abs(a["total"] - term)))
        return F.struct(term.alias("term"), more.alias("total"))

    tail = F.aggregate(F.slice(F.sequence(F.lit(0), k), F.lit(2), F.greatest(k.cast("int"), F.lit(1))), first,
                       lambda a, i: step(a, i), lambda a: a["total"])
    return F.when(k <= n * risk, tail)


def thresholds(measured: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, one cutoff column for each rule): null where none is safe."""
    good = (labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("id"))
            .agg(F.min("quality").alias("good")).where("good = 1").select("id"))
    held = measured.where(~F.col("base_failed")).join(good, "id", "left_semi")
    strata = measured.select("stratum").distinct().count()
    risk, level = alpha / len(RULES), delta / (max(1, strata) * len(RULES))
    steps = [(rule, i, cut) for rule in RULES for i, cut in enumerate(rule[2])]
    counts = held.groupBy("stratum").agg(F.count("*").alias("n"), *(
        F.sum((ratio(rule) > cut).cast("long")).alias(f"{rule[0]}_{i}") for rule, i, cut in steps))
    tests = counts.select("stratum", "n", F.explode(F.array(*(
        F.struct(F.lit(rule[0]).alias("rule"), F.lit(i).alias("step"), F.lit(float(cut)).alias("cut"),
                 F.col(f"{rule[0]}_{i}").alias("k")) for rule, i, cut in steps))).alias("t")).select("stratum", "n", "t.*")
    climb = Window.partitionBy("stratum", "rule").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    safe = (tests.withColumn("safe", F.coalesce(log_tail(F.col("n"), F.col("k"), risk) <= F.log(F.lit(level)), F.lit(False)))
            .withColumn("safe", F.min("safe").over(climb)).where("safe"))
    return safe.groupBy("stratum").agg(*(
        F.min(F.when(F.col("rule") == name, F.col("cut"))).alias(f"cut_{name}") for name, _, _ in RULES))


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA,
          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, stratum, counts, base_failed, rejected_by, kept), one row for
    each input row; ``rejected_by`` lists the rules that reject it."""
    measured = materialized(measures(docs, stratum, id_col, text_col), "quality-measures")
    # Written first, so the planner knows its size before it chooses the join.
    cuts = materialized(thresholds(measured, labels, alpha, delta).withColumnRenamed("stratum", "of"), "quality-cuts")
    joined = measured.join(cuts, F.col("stratum").eqNullSafe(F.col("of")), "left")
    rejecting = F.filter(F.array(*(F.when(ratio(r) > F.col(f"cut_{r[0]}"), F.lit(r[0])) for r in RULES)), lambda x: x.isNotNull())
    return (joined.withColumn("rejected_by", rejecting)
            .withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0))
            .withColumnRenamed("id", id_col).drop("of", *(f"cut_{r[0]}" for r in RULES)))


def digest(judged: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return judged.select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                         F.array_join("rejected_by", ",").alias("rejected_by"))


def keep_good(docs: DataFrame, judged: DataFrame, stratum: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that are kept.  A row is known by its id, text and stratum,
    on which the verdict rests, so rows that share an id, or have none, stay or
    go by themselves."""
    gone = judged.where(~F.col("kept")).select(
        F.col(id_col).alias("__gone"), F.col("text_hash").alias("__hash"), F.col("stratum").alias("__stratum")).distinct()
    same = (F.col(id_col).eqNullSafe(F.col("__gone")) & (F.xxhash64(text_of(text_col)) == F.col("__hash"))
            & F.col(stratum).eqNullSafe(F.col("__stratum")))
    return docs.join(gone, same, "left_anti")


def oracle_sql(alpha: float = ALPHA, delta: float = DELTA) -> str:
    """The digest as DuckDB SQL over documents and labels (ids unique)."""
    risk = alpha / len(RULES)
    ratios = {name: f"coalesce({expr.split(' / ')[0]}::double / nullif({expr.split(' / ')[1]}, 0), 0)" for name, expr, _ in RULES}
    tests = " UNION ALL ".join(
        f"SELECT stratum, '{name}' AS rule, {i} AS step, {cut}::double AS cut, count(*) AS n, "
        f"count(*) FILTER (WHERE {ratios[name]} > {cut}) AS k FROM held GROUP BY stratum"
        for name, _, ladder in RULES for i, cut in enumerate(ladder))
    rejecting = ", ".join(f"CASE WHEN {ratios[name]} > cut_{name} THEN '{name}' END" for name, _, _ in RULES)
    cuts = ", ".join(f"min(cut) FILTER (WHERE rule = '{name}') AS cut_{name}" for name, _, _ in RULES)
    return f"""
    WITH t AS (SELECT doc_id, lang AS stratum, coalesce(text, '') AS text FROM documents),
    w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w,
                 generate_subscripts(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), 1) AS i FROM t),
    g AS (SELECT doc_id, i, w, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
    d AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w, w2, w3) > 1 AND w3 IS NOT NULL AS twice FROM g),
    r AS (SELECT doc_id, count(*) FILTER (WHERE hit) AS n_repeat_words FROM (
            SELECT doc_id, bool_or(twice) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS hit FROM d)
          GROUP BY doc_id),
    l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (
            SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t)
          WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
    c AS (SELECT doc_id, stratum, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS n_words,
                 length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
                 length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
                 length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_capitals FROM t),
    m AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM (
            SELECT c.*, coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines,
                   coalesce(n_repeat_words, 0) AS n_repeat_words
            FROM c LEFT JOIN l USING (doc_id) LEFT JOIN r USING (doc_id))),
    held AS (SELECT * FROM m WHERE NOT base_failed AND doc_id IN (
            SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1)),
    tests AS ({tests}),
    tails AS (SELECT *, CASE WHEN k <= n * {risk!r} THEN list_sum(list_transform(range(k + 1), lambda i:
                 exp(lgamma(n + 1) - CASE WHEN i = 0 THEN 0 ELSE lgamma(i + 1) END - CASE WHEN i = n THEN 0 ELSE lgamma(n - i + 1) END
                     + i * ln({risk!r}) + (n - i) * ln(1 - {risk!r})))) ELSE 1 END AS tail FROM tests),
    climbed AS (SELECT *, bool_and(tail <= {delta!r} / ((SELECT count(*) FROM (SELECT DISTINCT stratum FROM m)) * {len(RULES)}))
                   OVER (PARTITION BY stratum, rule ORDER BY step) AS safe FROM tails),
    cuts AS (SELECT stratum, {cuts} FROM climbed WHERE safe GROUP BY stratum)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT base_failed AND rejected_by = '' AS kept, rejected_by FROM (
        SELECT m.*, array_to_string(list_filter([{rejecting}], lambda x: x IS NOT NULL), ',') AS rejected_by
        FROM m LEFT JOIN cuts ON m.stratum IS NOT DISTINCT FROM cuts.stratum)
    """
