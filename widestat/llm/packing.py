"""Packing of tokenized documents into windows by non-negative least squares.

1. Tasks tokenize their documents and cut them into units: a full window of a
   longer document, its rest, a document of its own, or, of documents shorter
   than ``MIN_UNIT`` tokens, several in a row.  Units get a length class (their
   tokens over ``WIDTH``, rounded up) and their number in it.
2. The histogram of the classes, ``window / WIDTH`` numbers whatever the data,
   is all that the driver sees.  Combinations of few lengths that fill a window
   exactly are enumerated (one or two lengths, each repeated, and three
   lengths once each); non-negative least squares finds how often each is
   repeated so that they use up the histogram; the counts are rounded, and
   cut where a class has no more units.
3. Units are dealt to the windows of the combinations by their number in the
   class, which is a count of the parts before plus their own.  What the rounded
   combinations leave over is packed greedily: the residual units follow each other
   and are cut wherever a window is full; the last window is cut into powers
   of two, which need no padding.

So only the windows of combinations have padding: less than ``WIDTH`` tokens for a
unit.  Tokens of a unit travel nowhere: pieces carry their documents' ids, places and
checksums; only the residual's ids are read again to be cut.

A null text is an empty one, which is the end mark alone.  Rows with a null or
repeated id are documents of their own.  An empty table gives no sequences.
The result depends on how the input files are split into tasks, as the order of
the documents does; the units are written once, so it does not change within a run.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from widestat.llm.common import materialized, text_of, worker_cached

WINDOW_TOKENS, WIDTH, MIN_UNIT = 4096, 8, 512
END = 2
ROW_BITS = 33
#: Combinations that the least squares take in at most.
ROUNDS = 600
#: Words a task remembers before it starts afresh (about 100 MB).
CACHE_WORDS = 400_000
#: Words of these characters are cut like the tokenizer does, by the pattern below.
PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+").fullmatch
#: Fixed value: the tokenizer's own pattern, for the characters of PLAIN in lower case.
PRETOKENS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+").findall
PIECE = "struct<doc:long,start:long,length:long,crc:long,tokens:long>"


class Parts(dict):
    """Ids of lower-case pretokens, as bytes, filled on first use."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenize = tokenizer.model.tokenize
        self.packed = [i.to_bytes(4, "little") for i in range(tokenizer.get_vocab_size())]
        letters = [*range(223, 247), *range(248, 256)]
        self.letters = {i: tokenizer.pre_tokenizer.pre_tokenize_str(chr(i))[0][0] for i in letters}

    def __missing__(self, part: str) -> bytes:
        shown = part if part.isascii() else part.translate(self.letters)
        ids = self[part] = b"".join([self.packed[t.id] for t in self.tokenize(shown)])
        return ids


class WordEncoder(dict):
    """Token ids of a lower-casing tokenizer that drops white space, word by
    word with a cache.  Words are cut at ASCII white space, over which neither
    normalization nor merges reach."""

    def __init__(self, path: str):
        import os

        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: How units keep their ids.
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.parts = Parts(self.tokenizer)

    def __missing__(self, raw: bytes) -> bytes:
        text = raw.decode("utf-8")
        if PLAIN(text) and not ("<" in text and any(s in text for s in self.special)):
            low = text.lower()
            ids = self.parts[low] if low.isalpha() else b"".join([self.parts[p] for p in PRETOKENS(low)])
        else:
            ids = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        self[raw] = ids
        return ids

    def ids(self, text: bytes) -> bytes:
        """The ids of a UTF-8 text as little-endian 32-bit numbers."""
        if len(self) > CACHE_WORDS:
            self.clear()
            self.parts.clear()
        return b"".join([self[w] for w in text.split()])


def units_of(docs: DataFrame, tokenizer_path: str, text_col: str, window: int, width: int, min_unit: int) -> DataFrame:
    """(cls, nth, length, pieces, ids): the units of every task."""
    end = np.array([END], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_cached(("words", tokenizer_path), lambda: WordEncoder(tokenizer_path))
        seen = {}
        rows, held = [], 0
        open_pieces, open_ids, open_length = [], [], 0

        def unit(length: int, pieces: list, ids: bytes) -> None:
            nonlocal held
            cls = -(-length // width)
            rows.append((cls, seen.get(cls, 0), length, pieces, np.frombuffer(ids, "<u4").astype(encoder.kind).tobytes()))
            seen[cls] = seen.get(cls, 0) + 1
            held += len(ids) + 100 * len(pieces)

        def table() -> pa.RecordBatch:
            nonlocal held
            cls, nth, lengths, pieces, ids = zip(*rows)
            flat = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in zip(*(p for unit in pieces for p in unit))],
                                              ["doc", "start", "length", "crc", "tokens"])
            ends = np.concatenate(([0], np.cumsum([len(unit) for unit in pieces]))).astype(np.int32)
            out = pa.RecordBatch.from_arrays([pa.array(cls, pa.int32()), pa.array(nth, pa.int64()), pa.array(lengths, pa.int64()),
                                              pa.ListArray.from_arrays(ends, flat), pa.array(ids, pa.binary())],
                                             ["cls", "nth", "length", "pieces", "ids"])
            rows.clear()
            held = 0
            return out

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encoder.ids(text.as_py()) + end
                n = len(ids) // 4
                for start in range(0, n, window):
                    part = ids[4 * start:4 * (start + window)]
                    length = len(part) // 4
                    piece = (key, start, length, zlib.crc32(part), n)
                    if length >= min_unit:
                        unit(length, [piece], part)
                        continue
                    open_pieces.append(piece)
                    open_ids.append(part)
                    open_length += length
                    if open_length >= min_unit:
                        unit(open_length, open_pieces, b"".join(open_ids))
                        open_pieces, open_ids, open_length = [], [], 0
                if held > 4_000_000:
                    yield table()
        if open_pieces:
            unit(open_length, open_pieces, b"".join(open_ids))
        if rows:
            yield table()

    return docs.select("key", text_of(text_col).cast("binary").alias("t")).mapInArrow(
        run, f"cls int, nth long, length long, pieces array<{PIECE}>, ids binary")


def combinations(size: int) -> list[tuple[tuple[int, int], ...]]:
    """((class, times), ...) of few classes whose lengths add up to ``size`` classes."""
    found = []
    for x in range(1, size + 1):
        for i in range(1, size // x + 1):
            rest = size - i * x
            if not rest:
                found.append(((x, i),))
            for j in range(1, rest // (x + 1) + 1):  # one greater length, repeated
                if rest % j == 0:
                    found.append(((x, i), (rest // j, j)))
        for y in range(x + 1, (size - x + 1) // 2):  # three lengths, x < y < z
            found.append(((x, 1), (y, 1), (size - x - y, 1)))
    return found


def nnls(place: np.ndarray, times: np.ndarray, b: np.ndarray, rounds: int) -> np.ndarray:
    """x >= 0 that makes |A x - b| small, by the active-set method on the normal
    equations.  Column j of A holds ``times[j]`` in the rows ``place[j]``; at
    most ``rounds`` columns are taken in."""
    n = len(place)
    x, passive, blocked = np.zeros(n), np.zeros(n, bool), np.zeros(n, bool)

    def dense(columns: np.ndarray) -> np.ndarray:
        out = np.zeros((len(b), len(columns)))
        for t in range(place.shape[1]):
            out[place[columns, t], np.arange(len(columns))] += times[columns, t]
        return out

    residual, least = b.copy(), 1e-9 * max(1.0, float(np.abs(b).max(initial=0)))
    for _ in range(rounds):
        gain = (times * residual[place]).sum(axis=1)
        gain[passive | blocked] = -np.inf
        j = int(gain.argmax())
        if gain[j] <= least:
            break
        passive[j] = True
        while True:
            columns = np.flatnonzero(passive)
            a = dense(columns)
            square = a.T @ a
            square[np.diag_indices(len(columns))] *= 1 + 1e-9
            z = np.linalg.solve(square, a.T @ b)
            if z.min() > 0:
                break
            low, now = z <= 0, x[columns]
            step = (now[low] / (now[low] - z[low])).min()
            x[columns] = now + step * (z - now)
            gone = columns[low & (x[columns] <= 1e-9)]
            passive[gone if len(gone) else columns[low]] = False
            x[~passive] = 0
            if not passive.any():
                a, columns, z = np.zeros((len(b), 0)), np.zeros(0, int), np.zeros(0)
                break
        blocked[j] = not passive[j]  # rounding: it would be taken in and out for ever
        x[:] = 0
        x[columns] = z
        residual = b - a @ z
    return x


def planned(histogram: dict[int, int], size: int, rounds: int = ROUNDS) -> list[tuple[tuple, int]]:
    """[(combination, repeats)] that never use more units of a class than there are."""
    left = np.zeros(size + 1, np.int64)
    for cls, n in histogram.items():
        left[cls] = n
    plan = []
    if left[size]:  # full windows stand alone
        plan.append((((size, 1),), int(left[size])))
        left[size] = 0
    live = [c for c in combinations(size) if all(left[k] >= m for k, m in c)]
    if not live:
        return plan
    place, times = np.zeros((len(live), 3), np.int64), np.zeros((len(live), 3))
    for j, c in enumerate(live):
        for t, (k, m) in enumerate(c):
            place[j, t], times[j, t] = k, m * k  # weighted by length: a token counts the same in every class
    found = nnls(place, times, left * np.arange(size + 1.0), rounds)
    for j in np.argsort(-found, kind="stable"):
        repeats = min(round(float(found[j])), *(int(left[k]) // m for k, m in live[j]))
        if repeats > 0:
            plan.append((live[j], repeats))
            for k, m in live[j]:
                left[k] -= repeats * m
    return plan


def powers(n: int) -> list[int]:
    """Powers of two, falling, that add up to ``n``."""
    return [1 << k for k in reversed(range(n.bit_length())) if n >> k & 1]


def slots(plan: list[tuple[tuple, int]]) -> tuple[list[tuple], int]:
    """Rows (cls, low, high, sequence, places, place): the units of a class
    numbered from low to high fill ``places`` places a window from ``place`` on in the
    windows from ``sequence`` on.  And the number of windows."""
    out, taken, sequence = [], {}, 0
    for combination, times in plan:
        place = 0
        for cls, m in sorted(combination, reverse=True):
            low = taken.get(cls, 0)
            taken[cls] = low + times * m
            out.append((cls, low, taken[cls], sequence, m, place))
            place += m
        sequence += times
    return out, sequence


def cut(residual: DataFrame, first: int, total: int, window: int) -> DataFrame:
    """Pieces of the residual units, which follow each other from ``at`` on."""
    tail = total // window * window
    edges = np.cumsum([tail, *powers(total - tail)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for at, pieces, ids in zip(*(batch.column(i).to_pylist() for i in range(3))):
                done = 0
                for p in pieces:
                    start = 0
                    while start < p["length"]:
                        where = at + done
                        if where < tail:
                            sequence, begin, stop = where // window, where // window * window, (where // window + 1) * window
                        else:
                            k = int(np.searchsorted(edges, where, "right"))
                            sequence, begin, stop = tail // window + k - 1, int(edges[k - 1]), int(edges[k])
                        n = min(p["length"] - start, stop - where)
                        kind = np.dtype(f"<u{len(ids) // sum(q['length'] for q in pieces)}")
                        crc = p["crc"] if n == p["length"] else zlib.crc32(
                            np.frombuffer(ids, kind, n, kind.itemsize * done).astype("<u4").tobytes())
                        out.append((p["doc"], p["start"] + start, n, crc, p["tokens"], first + sequence, where - begin))
                        start, done = start + n, done + n
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)],
                                                 ["doc", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return residual.select("at", "pieces", "ids").mapInArrow(
        run, "doc long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer_path: str, text_col: str = "text", window: int = WINDOW_TOKENS, width: int = WIDTH,
         min_unit: int = MIN_UNIT) -> DataFrame:
    """(doc, start, length, ids_crc32, doc_tokens, sequence_id, offset), one row
    a piece, of ``docs`` (key, text)."""
    spark = docs.sparkSession
    units = materialized(units_of(docs, tokenizer_path, text_col, window, width, min_unit)
                         .withColumn("unit", F.monotonically_increasing_id()), "pack-units")
    part = F.shiftright("unit", ROW_BITS)
    sizes = units.groupBy("cls", part.alias("part")).agg(F.count("*").alias("n"))
    # A class has as many rows here as tasks that hold it.
    before = F.sum("n").over(Window.partitionBy("cls").orderBy("part")) - F.col("n")
    offsets = materialized(sizes.select(F.col("cls").alias("of"), F.col("part").alias("in"), "n", before.alias("before")), "pack-offsets")
    histogram = {r["of"]: r["n"] for r in offsets.groupBy("of").agg(F.sum("n").alias("n")).collect()}  # window / width rows at most
    plan = planned(histogram, window // width)
    rows, windows = slots(plan)
    numbered = (units.select("unit", "cls", "nth", "length", part.alias("part"))
                .join(offsets, (F.col("cls") == F.col("of")) & (F.col("part") == F.col("in")))
                .select("unit", "part", "cls", "length", (F.col("before") + F.col("nth")).alias("rank")))
    # A bounded table: a few rows a combination.
    table = F.broadcast(spark.createDataFrame(rows, "of int, low long, high long, first long, m int, place int"))
    dealt = materialized(
        numbered.join(table, (F.col("cls") == F.col("of")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")), "left")
        .select("unit", "part", "length", F.expr("first + (rank - low) div m").alias("sequence_id"),
                F.expr("place + (rank - low) % m").alias("place")), "pack-dealt")

    in_window = Window.partitionBy("sequence_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.where("sequence_id is not null").select(
        "unit", "sequence_id", F.coalesce(F.sum("length").over(in_window), F.lit(0)).alias("base"))
    inner = F.transform("pieces", lambda p, i: F.struct(p.alias("p"), F.aggregate(
        F.slice("pieces", F.lit(1), i), F.lit(0).cast("long"), lambda s, q: s + q["length"]).alias("in")))
    fitted = (units.select("unit", "pieces").join(placed, "unit").select("sequence_id", "base", F.explode(inner).alias("x"))
              .select(F.col("x.p.doc").alias("doc"), F.col("x.p.start").alias("start"), F.col("x.p.length").alias("length"),
                      F.col("x.p.crc").alias("ids_crc32"), F.col("x.p.tokens").alias("doc_tokens"), "sequence_id",
                      (F.col("base") + F.col("x.in")).alias("offset")))

    over = dealt.where("sequence_id is null")
    shares, at = [], 0
    for r in over.groupBy("part").agg(F.sum("length").alias("n")).orderBy("part").collect():  # one row a task
        shares.append((r["part"], at))
        at += r["n"]
    if not at:
        return fitted
    begin = spark.createDataFrame(shares, "in long, begin long")
    along = Window.partitionBy("part").orderBy("unit").rowsBetween(Window.unboundedPreceding, -1)
    residual = (over.withColumn("run", F.coalesce(F.sum("length").over(along), F.lit(0)))
                .join(begin, F.col("part") == F.col("in")).select("unit", (F.col("begin") + F.col("run")).alias("at")))
    # In every class the residual begins at one unit: a row a class tells which
    # ids are read, so those of other units are not moved.
    covered: dict[int, int] = {}
    for cls, _, high, *_ in rows:
        covered[cls] = max(covered.get(cls, 0), high)
    cover = F.broadcast(spark.createDataFrame([(c, covered.get(c, 0)) for c in histogram], "cls int, cover long"))
    split = F.broadcast(offsets.join(cover, F.col("of") == F.col("cls")).where("before <= cover and cover < before + n")
                        .select("of", F.col("in").alias("first_part"), (F.col("cover") - F.col("before")).alias("first_nth")))
    left = units.join(split, F.col("cls") == F.col("of")).where(
        (part > F.col("first_part")) | ((part == F.col("first_part")) & (F.col("nth") >= F.col("first_nth"))))
    return fitted.unionByName(cut(left.select("unit", "pieces", "ids").join(residual, "unit"), windows, at, window))


def digest(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    slim = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).alias(text_col))
    return pack(slim, tokenizer_path, text_col).withColumnRenamed("doc", id_col)
