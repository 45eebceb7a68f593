"""Substring dedup over sliding sentence spans.

A text is cut into sentences (after ``.``, ``!`` or ``?`` and white space, and
at line ends), and a sentence of more than ``window`` words into pieces: of
every ``window`` consecutive words in it, a piece starts at the one with the
least hash.  So no piece is longer than ``window`` words, and words that are
repeated are cut alike whatever stands around them, but for the ``window - 1``
words next to an end of the repeat that lies inside a sentence.  From every
piece, forwards and backwards, the shortest run of consecutive pieces with
``min_words`` words is a span; a longer run that is repeated is the union of
such spans, so hashing these finds what hashing every run would.  Any repeat of
``4 * window + min_words - 3`` whole words (49) holds a span.  Spans are
compared by their lower-case words under a 128-bit hash.  Over all documents the
first place of a span, by document and then position, is kept; pieces covered by
any later place are removed.

The texts are cut once.  A task folds the equal spans of a slice of its texts
into one row, the first place and the others packed; one exchange brings equal
spans together, sorted, and a scan that holds nothing but the first place of the
present span hands on all others.  A span of very many documents is thus a row a
slice, never a group held in memory.

Null and empty texts have no spans, nor has a text too short for one.  A
document is known by its id and the 64-bit hash of its text: rows that share an
id, or have none, are documents of their own, and rows equal in both are one
(the same span at the same place of theirs is one place).  Documents are ordered
by id, those with a null id last, then by text hash, so ties cannot occur.
Offsets are code points, the end exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from widestat.llm.common import text_of

MIN_WORDS = 20
WINDOW = 8
SENTENCE = re.compile(r"[^\s](?:[^.!?\n]|[.!?]+(?![.!?\s]))*[.!?]*")
#: Which code points are white space; the last entry stands for all above.
SPACE = np.array([chr(i).isspace() for i in range(0x3001)] + [False])
LAST_ID = (1 << 63) - 1
#: Spans that a task folds and hands on at once.
SLICE = 200_000
#: A place: document id, text hash, start, end.
PLACE = np.dtype([("doc", "<i8"), ("key", "<i8"), ("start", "<i4"), ("end", "<i4")])


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of every sentence."""
    return [m.span() for m in SENTENCE.finditer(text)]


def word_places(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = np.zeros(len(codes) + 2, np.int8)
    inside[1:-1] = ~SPACE[np.minimum(codes, len(SPACE) - 1)]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def breaks(starts: np.ndarray, sentence_starts: list[int], hashes: list[int], window: int = WINDOW) -> np.ndarray:
    """The words at which a piece starts, and the number of words."""
    opens = np.zeros(len(starts) + 1, bool)
    opens[np.searchsorted(starts, sentence_starts)], opens[-1] = True, True
    if len(starts) > window:
        number = np.cumsum(opens[:-1])
        whole = np.flatnonzero(number[:len(starts) - window + 1] == number[window - 1:])
        seen = np.lib.stride_tricks.sliding_window_view(np.array(hashes, np.uint64), window)[whole]
        long = np.bincount(number)[number[whole]] > window  # a sentence of one window stays whole
        opens[(whole + seen.argmin(axis=1))[long]] = True
    return np.flatnonzero(opens)


def spans(text: str, min_words: int = MIN_WORDS, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes (two 64-bit halves each), starts and ends of the spans, by start and end."""
    from xxhash import xxh3_64_intdigest, xxh3_128_digest

    starts, ends = word_places(text)
    none = np.empty((0, 2), np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    if len(starts) < min_words:
        return none
    lowered = " ".join(text.lower().split()).encode("utf-8", "surrogatepass")
    after = np.flatnonzero(np.frombuffer(lowered + b" ", np.uint8) == 32)
    at = np.concatenate(([0], after + 1))
    cuts = breaks(starts, [s for s, _ in sentences(text)], list(map(xxh3_64_intdigest, lowered.split(b" "))), window)
    n = len(cuts)
    to = np.searchsorted(cuts, cuts + min_words)  # the shortest run from each piece
    forward = np.flatnonzero(to < n)
    back = np.searchsorted(cuts, cuts - min_words, side="right") - 1  # and the shortest one to each
    backward = np.flatnonzero(back >= 0)
    runs = np.unique(np.concatenate((forward * n + to[forward], back[backward] * n + backward)))
    if not len(runs):
        return none
    i, j = cuts[runs // n], cuts[runs % n]
    digests = b"".join([xxh3_128_digest(lowered[a:b]) for a, b in zip(at[i].tolist(), (at[j] - 1).tolist())])
    return np.frombuffer(digests, np.int64).reshape(-1, 2), starts[i], ends[j - 1]


def folded(hashes: np.ndarray, places: np.ndarray) -> pa.RecordBatch:
    """A row for each hash: its first place, and the others packed."""
    order = np.lexsort((places["end"], places["start"], places["key"], places["doc"], hashes[:, 1], hashes[:, 0]))
    hashes, places = hashes[order], places[order]
    first = np.flatnonzero(np.concatenate(([True], (hashes[1:] != hashes[:-1]).any(axis=1))))
    ends = np.append(first[1:], len(places))
    data = places.tobytes()
    size = PLACE.itemsize
    more = [data[a * size:b * size] if a < b else None for a, b in zip((first + 1).tolist(), ends.tolist())]
    head = places[first]
    return pa.RecordBatch.from_arrays(
        [pa.array(hashes[first, 0]), pa.array(hashes[first, 1]), *(pa.array(np.ascontiguousarray(head[c])) for c in PLACE.names),
         pa.array(more, pa.binary())], ["h1", "h2", *PLACE.names, "more"])


def later_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by hash and first place, every place but the first of its hash."""
    hash_, kept = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        hashes = np.stack([batch.column(c).to_numpy() for c in (0, 1)], axis=1)
        head = np.empty(batch.num_rows, PLACE)
        for k, c in enumerate(PLACE.names):
            head[c] = batch.column(k + 2).to_numpy()
        new = np.concatenate(([hash_ is None or (hashes[0] != hash_).any()], (hashes[1:] != hashes[:-1]).any(axis=1)))
        owner = np.maximum.accumulate(np.where(new, np.arange(len(new)), -1))
        first = head[np.maximum(owner, 0)]  # the kept place of each row's hash
        if kept is not None:
            first[owner < 0] = kept
        out = [head[~new & (head != first)]]
        more = batch.column(6)
        packed = np.flatnonzero(more.is_valid().to_numpy(zero_copy_only=False))
        for row, data in zip(packed.tolist(), more.drop_null().to_pylist()):
            places = np.frombuffer(data, PLACE)
            out.append(places[places != first[row]])
        hash_, kept = hashes[-1], first[-1]
        found = np.concatenate(out)
        for k in range(0, len(found), SLICE):
            part = found[k:k + SLICE]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(part[c])) for c in PLACE.names], list(PLACE.names))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   min_words: int = MIN_WORDS, window: int = WINDOW) -> DataFrame:
    """(doc_id, text_hash, start, end): what to remove, as disjoint ranges in each document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, places, held = [], [], 0
        for batch in batches:
            for doc, key, text in zip(*(c.to_pylist() for c in batch.columns)):
                h, start, end = spans(text, min_words, window)
                if not len(h):
                    continue
                at = np.empty(len(h), PLACE)
                at["doc"], at["key"], at["start"], at["end"] = doc, key, start, end
                hashes.append(h)
                places.append(at)
                held += len(h)
                if held >= SLICE:
                    yield folded(np.concatenate(hashes), np.concatenate(places))
                    hashes, places, held = [], [], 0
        if held:
            yield folded(np.concatenate(hashes), np.concatenate(places))

    columns = "doc long, key long, start int, end int"
    later = (docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("doc"),
                         F.xxhash64(text_of(text_col)).alias("key"), text_of(text_col).alias("t"))
             .mapInArrow(run, f"h1 long, h2 long, {columns}, more binary")
             .repartition("h1", "h2").sortWithinPartitions("h1", "h2", *PLACE.names)
             .mapInArrow(later_places, columns))
    by_start = Window.partitionBy("doc", "key").orderBy("start", "end")
    islands = (later.withColumn("reach", F.max("end").over(by_start.rowsBetween(Window.unboundedPreceding, -1)))
               .withColumn("island", F.sum(F.when(F.col("start") <= F.col("reach"), 0).otherwise(1)).over(
                   by_start.rowsBetween(Window.unboundedPreceding, 0))))
    return (islands.groupBy("doc", "key", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
            .select(F.when(F.col("doc") != LAST_ID, F.col("doc")).alias(id_col), F.col("key").alias("text_hash"), "start", "end"))


def digest(ranges: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row for each document that loses pieces."""
    return (ranges.groupBy(id_col, "text_hash").agg(
        F.count("*").alias("n_ranges"), F.sum(F.col("end") - F.col("start")).alias("removed_chars"),
        F.array_sort(F.collect_list(F.struct("start", "end"))).alias("ranges"))
        .withColumn("ranges", F.array_join(F.transform("ranges", lambda r: F.concat_ws(":", r["start"], r["end"])), ",")))


def remove_ranges(docs: DataFrame, ranges: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with the ranges cut out of their texts; other columns and
    documents without ranges stay as they are."""
    cut = (ranges.groupBy(F.col(id_col).alias("__doc"), F.col("text_hash").alias("__hash"))
           .agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("__cut")))
    same = F.col(id_col).eqNullSafe(F.col("__doc")) & (F.xxhash64(text_of(text_col)) == F.col("__hash"))
    joined = docs.join(cut, same, "left")
    bounds = F.concat(F.array(F.lit(0)), F.transform("__cut", lambda r: r["end"]))
    starts = F.concat(F.transform("__cut", lambda r: r["start"]), F.array(F.length(text_col)))
    kept = F.array_join(F.zip_with(bounds, starts, lambda a, b: F.substring(F.col(text_col), a + 1, b - a)), "")
    return joined.withColumn(text_col, F.when(F.col("__cut").isNull(), F.col(text_col)).otherwise(kept)).select(*docs.columns)
