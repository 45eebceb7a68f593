"""Benchmark decontamination by spaced-seed hashing.

Texts are compared as words (runs of letters and digits, lower case).  A mask
slides over a word sequence and hashes the words under its 1s; the words under
its 0s are ignored, so a substituted word there does not hide a match.  Hashes
of the benchmark items are joined with those of the documents, and each hit is
verified on its diagonal: over the stretch where item and document lie side by
side, a common word counts 1 and a substitution -1, and the best stretch must
hold ``min_match`` common words (or all but a fifth of a shorter item).

Items under ``min_match`` words are matched only by documents that consist of
exactly their words; an item without words matches nothing.  Null texts have no
words; rows of the benchmark with a null id are kept under that id.  Repeated
documents each give their rows; an empty table gives none.

The benchmark goes to the tasks in blocks of at most about ``block_words``
words, one scan of the documents for each block, so its size is bounded
whatever the benchmark holds; the rows of several blocks are written under the
checkpoint folder, and a block is taken back before the next is sent.

Neighbouring places with one hash are one run, and two runs give an interval of
diagonals, so a text and an item of the same words over and over cost their
diagonals and not every pair of places.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from widestat.llm.common import text_of
from widestat.session import scratch_path

#: 1: the word counts; 0: it is ignored.  Every mask has six 1s.
MASKS = ("11011011", "1110100101", "1011001011", "111010011")
MIN_MATCH = 10
BLOCK_WORDS = 1_000_000
#: Pairs of runs that are held at once.
PAIRS = 1_000_000
WORD = re.compile(r"[^\W_]+")
MULTIPLIER = 0x9E3779B97F4A7C15


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def seeds(ids: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """(start positions, hashes) of the mask's windows over the word ids;
    windows with an id of 0 under a 1 are left out."""
    keep = [i for i, c in enumerate(mask) if c == "1"]
    n = len(ids) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    known = ids != 0
    whole = np.ones(n, bool)
    for k in keep:
        whole &= known[k:k + n]
    at = np.flatnonzero(whole)
    h = np.zeros(len(at), np.uint64)
    for k in keep:
        h = (h ^ ids[at + k]) * np.uint64(MULTIPLIER)
        h ^= h >> np.uint64(29)
    return at, h


def runs(h: np.ndarray, owner: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """(hash, owner, first, last) of each run of neighbouring places with one
    hash and owner; sorted by hash, owner and place, as the rows are."""
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    return h[first], owner[first], at[first], at[np.append(first[1:], len(h)) - 1] if len(h) else at


def merged(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of the intervals as disjoint ones."""
    order = np.argsort(low, kind="stable")
    low, reach = low[order], np.maximum.accumulate(high[order])
    new = np.ones(len(low), bool)
    new[1:] = low[1:] > reach[:-1] + 1
    first = np.flatnonzero(new)
    return low[first], reach[np.append(first[1:], len(low)) - 1] if len(low) else reach


class Index:
    """Spaced-seed index of one block of benchmark items."""

    def __init__(self, items: list[tuple[object, str]], min_match: int):
        self.min_match = min_match
        self.ids: list[object] = []
        self.items: list[np.ndarray] = []
        self.short: dict[tuple[str, ...], list[object]] = {}
        self.vocabulary: dict[str, int] = {}
        for item, text in items:
            seq = words(text or "")
            if len(seq) < min_match:
                if seq:
                    self.short.setdefault(tuple(seq), []).append(item)
                continue
            self.ids.append(item)
            self.items.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in seq], np.uint64))
        self.longest = max(map(len, self.items), default=0)
        self.tables = []
        for mask in MASKS:
            found = [(h, np.full(len(h), i), at) for i, seq in enumerate(self.items) for at, h in [seeds(seq, mask)]]
            h, i, at = (np.concatenate([f[k] for f in found]) if found else np.empty(0, np.int64) for k in range(3))
            order = np.argsort(h, kind="stable")
            self.tables.append((mask, *runs(h[order].astype(np.uint64), i[order].astype(np.int64), at[order].astype(np.int64))))

    def matches(self, text: str) -> list[tuple[object, int, int, int]]:
        """(item, first word, end word, common words), the best place of each
        item; places in the document's words, the end exclusive."""
        seq = words(text)
        out = [(item, 0, len(seq), len(seq)) for item in self.short.get(tuple(seq), ())] if len(seq) < self.min_match else []
        get = self.vocabulary.get
        ids = np.fromiter((get(w, 0) for w in seq), np.uint64, len(seq))
        width = len(ids) + self.longest + 2  # more than an item has diagonals
        hit = []
        for mask, table, items, low, high in self.tables:
            at, h = seeds(ids, mask)
            if not len(at) or not len(table):
                continue
            known = table[np.minimum(np.searchsorted(table, h), len(table) - 1)] == h
            if not known.any():
                continue
            at, h = at[known], h[known]
            order = np.argsort(h, kind="stable")
            h, _, first, last = runs(h[order], np.zeros(len(h), np.int64), at[order])
            begin, end = np.searchsorted(table, h), np.searchsorted(table, h, side="right")
            for part in np.split(np.arange(len(h)), np.flatnonzero(np.diff(np.cumsum(end - begin) // PAIRS)) + 1):
                n = (end - begin)[part]
                run = np.repeat(part, n)  # every run of the text with every run of the items
                post = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[part], n)
                base = items[post] * width + width - len(ids) - 1
                hit.append(merged(base + first[run] - high[post], base + last[run] - low[post]))
        if hit:
            lo, hi = merged(*(np.concatenate(x) for x in zip(*hit)))
            n = hi - lo + 1
            found = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
            places = zip((found // width).tolist(), (found % width - (width - len(ids) - 1)).tolist())
        else:
            places = ()
        best: dict[int, tuple[int, int, int]] = {}
        for i, shift in places:
            item = self.items[i]
            a, b = max(0, shift), min(len(ids), shift + len(item))
            same = ids[a:b] == item[a - shift:b - shift]
            run = np.concatenate(([0], np.cumsum(np.where(same, 1, -1))))
            gain = run - np.minimum.accumulate(run)
            end = int(gain.argmax())
            start = int(run[:end + 1].argmin())
            common = int(same[start:end].sum())
            if common >= min(self.min_match, len(item) - len(item) // 5) and common > best.get(i, (0, 0, 0))[2]:
                best[i] = (a + start, a + end, common)
        return out + [(self.ids[i], *place) for i, place in sorted(best.items())]


def find_overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text: str = "text", min_match: int = MIN_MATCH,
                  block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id, first_word, end_word, common_words): each document row
    with each benchmark item that it overlaps, at the best place."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).alias("item"), text_of(item_text).alias("t"))
    sizes = items.agg(F.sum(F.length("t")).alias("chars"), F.count("*").alias("n")).first()
    blocks = max(1, -(-max((sizes["chars"] or 0) // 2, sizes["n"]) // block_words))
    doc_type, item_type = (d.schema[c].dataType.simpleString() for d, c in ((docs, id_col), (benchmark, item_col)))
    chosen = docs.select(F.col(id_col).alias("doc"), text_of(text_col).alias("t"))
    item_arrow = spark.createDataFrame([], f"item {item_type}").toArrow().schema.field("item").type

    def scan(block: int) -> tuple[DataFrame, Broadcast]:
        part = items.where(F.pmod(F.xxhash64("item", "t"), F.lit(blocks)) == block)
        sent = spark.sparkContext.broadcast([(r["item"], r["t"]) for r in part.collect()])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = Index(sent.value, min_match)
            for batch in batches:
                found = [(i, *m) for i, t in enumerate(batch.column(1).to_pylist()) if t for m in index.matches(t)]
                if found:
                    row, item, first, end, common = zip(*found)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(row, pa.int64())), pa.array(item, item_arrow),
                         *(pa.array(x, pa.int64()) for x in (first, end, common))],
                        ["doc", "item", "first_word", "end_word", "common_words"])

        return chosen.mapInArrow(run, f"doc {doc_type}, item {item_type}, first_word long, end_word long, common_words long"), sent

    if blocks == 1:
        found, _ = scan(0)
    else:  # a block's items leave the executors before the next come
        path = scratch_path(spark, "overlaps")
        for b in range(blocks):
            part, sent = scan(b)
            part.write.mode("append").parquet(path)
            sent.destroy()
        found = spark.read.schema(part.schema).parquet(path)
    out = [id_col, item_col if item_col != id_col else f"benchmark_{item_col}"]
    return found.withColumnsRenamed({"doc": out[0], "item": out[1]})


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents without any overlap (``find_overlaps``).  A row is known by
    its id and text, on which the overlap rests, so rows that share an id, or
    have none, stay or go by themselves."""
    keyed = docs.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(text_of(text_col)).alias("hash")).alias("__row"),
                        F.col(text_col).alias("__text"))
    found = find_overlaps(keyed, benchmark, id_col="__row", text_col="__text", **options)
    gone = found.select(F.col("__row.id").alias("__gone"), F.col("__row.hash").alias("__hash")).distinct()
    same = F.col(id_col).eqNullSafe(F.col("__gone")) & (F.xxhash64(text_of(text_col)) == F.col("__hash"))
    return docs.join(gone, same, "left_anti")
