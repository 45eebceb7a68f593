"""License scan with a positional index of rare template words.

A template is the word sequence of a license notice.  Its rarest words, by
inverse document frequency over all documents, are its index terms, each with
its position in the template.  A file looks up the index terms it holds; hits
whose position in the file minus position in the template agree (within
``SLACK`` words, so a wrapped or slightly edited notice still lines up) propose
a place; the place is accepted when the template's mandatory key phrases stand
there.  The score is the share of template words found in order at the best
accepted place.  A long notice has more index terms, and half of a template's
terms must agree.

Words are runs of ASCII digits, letters (A-Z lowered) and non-ASCII
characters.  A null text counts as empty: no words, no labels, score 0.
Repeated rows are each scanned; a null id stays null.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from widestat.llm.common import text_of
from widestat.llm.notices import NOTICES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}

# Phrases of the contract and their labels (fixed values).
BASE_PHRASES = (
    (("mit", "license"), "mit"),
    (("apache", "license"), "apache"),
    (("general", "public", "license"), "gpl"),
)

TEMPLATES = NOTICES
#: Rarest words of a template that enter the index: at least so many, and one
#: for each so many words.
INDEX_TERMS, WORDS_A_TERM = 4, 16
SLACK = 3


def words(text: str) -> list[str]:
    return WORD.findall(text.translate(UPPER))


def template_words() -> frozenset[str]:
    return frozenset(w for _, notice, _ in TEMPLATES for w in words(notice))


def document_frequencies(docs: DataFrame, text_col: str = "text") -> dict[str, int]:
    """Number of documents that hold each template word, and ``""`` for all
    documents; one counter of the fixed template vocabulary for each task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, seen = template_words(), Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen[""] += 1
                seen.update(vocabulary.intersection(words(text)))
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(list(seen)), pa.array(list(seen.values()), pa.int64())], ["w", "n"])

    counts = (docs.select(text_of(text_col).alias("t")).mapInArrow(run, "w string, n long")
              .groupBy("w").agg(F.sum("n").alias("n")))
    return {r["w"]: r["n"] for r in counts.collect()}  # at most the template words


def build_index(frequency: dict[str, int]):
    """(postings: word -> [(template, position)], templates as word lists, the
    terms of each that must agree, their key phrases as word lists)."""
    total = frequency.get("", 0) + 1
    sequences = [words(notice) for _, notice, _ in TEMPLATES]
    postings: dict[str, list[tuple[int, int]]] = {}
    need = []
    for t, seq in enumerate(sequences):
        rarity = {w: math.log(total / (frequency.get(w, 0) + 1)) for w in seq}
        terms = set(sorted(rarity, key=lambda w: (-rarity[w], w))[:max(INDEX_TERMS, len(seq) // WORDS_A_TERM)])
        need.append(max(2, (len(terms) + 1) // 2))
        for at, w in enumerate(seq):
            if w in terms:
                postings.setdefault(w, []).append((t, at))
    return postings, sequences, need, [[p.split() for p in phrases] for _, _, phrases in TEMPLATES]


def phrase_in(seq: list[str], phrase: list[str]) -> bool:
    n = len(phrase)
    return any(seq[i:i + n] == phrase for i in range(len(seq) - n + 1))


def in_order(template: list[str], window: list[str]) -> int:
    """Length of the longest common subsequence."""
    row = [0] * (len(window) + 1)
    for w in template:
        before = 0
        for j, x in enumerate(window):
            before, row[j + 1] = row[j + 1], before + 1 if w == x else max(row[j + 1], row[j])
    return row[-1]


def match_templates(seq: list[str], present: set[str], index) -> list[tuple[str, int, float]]:
    """(label, first word, score) of every accepted place."""
    postings, sequences, need, phrases = index
    places: dict[int, list[tuple[int, str]]] = {}
    for at, w in enumerate(seq):
        if w in present:
            for t, q in postings[w]:
                places.setdefault(t, []).append((at - q, w))
    found = []
    for t, hits in places.items():
        label = TEMPLATES[t][0]
        hits.sort()
        low, open_to = 0, -1
        inside: Counter = Counter()
        for offset, w in hits:
            inside[w] += 1
            while hits[low][0] < offset - SLACK:
                gone = hits[low][1]
                inside[gone] -= 1
                if not inside[gone]:
                    del inside[gone]
                low += 1
            start = max(0, hits[low][0])
            if len(inside) >= need[t] and start > open_to:
                size = len(sequences[t])
                window = seq[max(0, start - SLACK):offset + size + SLACK]
                if all(phrase_in(window, p) for p in phrases[t]):
                    found.append((label, start, in_order(sequences[t], window) / size))
                    open_to = start + SLACK
    return found


def scan(text: str, index) -> tuple[int, int, int | None, int | None, list[str], list[str], float]:
    seq = words(text)
    held = set(seq)
    base, places = set(), []
    if "license" in held:
        for at, w in enumerate(seq):
            if w == "license":
                for phrase, label in BASE_PHRASES:
                    n = len(phrase)
                    if at + 1 >= n and tuple(seq[at + 1 - n:at + 1]) == phrase:
                        base.add(label)
                        places.append(at + 1 - n)
    present = held.intersection(index[0])
    found = match_templates(seq, present, index) if len(present) > 1 else []
    labels = base | {label for label, _, _ in found}
    return (len(seq), len(places), min(places, default=None), max(places, default=None), sorted(base),
            sorted(labels), max((s for _, _, s in found), default=0.0))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: n_words, n_base, first_word, last_word,
    base_labels and labels (arrays, sorted), score (0 to 1)."""
    frequency = document_frequencies(docs, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = build_index(frequency)
        for batch in batches:
            cols = list(zip(*(scan(t, index) for t in batch.column(1).to_pylist()))) or [[]] * 7
            kinds = (pa.int64(),) * 4 + (pa.list_(pa.string()),) * 2 + (pa.float64(),)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))],
                                             ["id", "n_words", "n_base", "first_word", "last_word", "base_labels",
                                              "labels", "score"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return (docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("t"))
            .mapInArrow(run, f"id {id_type}, n_words long, n_base long, first_word long, last_word long, "
                             "base_labels array<string>, labels array<string>, score double")
            .withColumnRenamed("id", id_col))


def digest(scanned: DataFrame) -> DataFrame:
    return (scanned.withColumn("base_labels", F.array_join("base_labels", ","))
            .withColumn("labels", F.array_join("labels", ",")))
