"""Alignment of two tokenizers with external spill counting.

A document is encoded by two tokenizers, A and B, and both token sequences are
laid over the bytes of a space and the text.  Offsets at which both end a token
cut them into groups; every A token and B token with common bytes are a link.
The count of a pair of ids is the number of documents that hold it linked.

1. A scan task aligns its documents, drops their ids and keeps pair-document
   records (pair, document, links).  It deals them into ``RUN_DOCS`` documents a
   run and, inside a run, by the high bits of the A id into ``BUCKETS`` buckets
   (radix partitions); each part is sorted by pair and written as zstd frames:
   the pairs with their numbers of documents, and apart from these the documents.
2. Only the pairs are shuffled, folded already: one record a run and pair,
   however frequent the pair is.  A task that has all runs of a bucket merges
   them by a heap, A id by A id.  When an A id is done its counts and maximum
   are known, and what each run needs (count and whether it is the A id's
   highest) streams back into that run's own order.  More than ``FAN_IN``
   runs are merged in rounds; the way back goes through the same rounds.
3. What came back meets the run's documents, which were never shuffled by pair,
   and is summed by document.

So one hot pair, or one hot A id, costs a record a run, not one a document.

Encoding: a text with single spaces between its words is encoded word by word,
with a cache.  No B piece has a space inside or at its end but the runs of
spaces, and A's words are cut before the last space of a run, so this equals
the encoding of the whole; other texts are encoded whole.  Tests hold both
against the libraries.

A null or empty text, and one whose joined tokens of either side are not its
own bytes, has no tokens: zeros and an empty digest.  Rows with a null or
repeated id are documents of their own, so repeated rows count apart.  An empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from widestat.llm.common import materialized, text_of, worker_cached

#: Documents of a run, radix partitions, and runs merged at a time.
RUN_DOCS, BUCKETS, FAN_IN = 4096, 32, 512
#: Links of a run after which it is closed early, so very long texts do not fill a task.
RUN_LINKS = 8_000_000
#: Words a task remembers before it starts afresh (about 200 MB).
CACHE_WORDS = 500_000
LEVEL = 3
B_BITS = 16
#: White space other than single spaces between words and line ends.
ODD_SPACE = re.compile(r"[^\S \n]|  |\n \n")
#: Words of these characters are cut into parts like A does, by the pattern below.
PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+").fullmatch
#: Fixed value: A's own pattern, for a space and the characters of PLAIN.
PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^\sA-Za-zÀ-ÖØ-öø-ÿ0-9]+").findall
#: Bits of each of the three numbers kept as one.
COUNT_BITS = 40


def a_token_bytes(vocabulary: dict[str, int]) -> list[bytes]:
    """The bytes of every id of a byte-level vocabulary: printable Latin-1
    stands for itself, the other bytes follow from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    byte_of = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(own))}
    out = [b""] * (max(vocabulary.values()) + 1)
    for piece, i in vocabulary.items():
        out[i] = bytes(byte_of[c] for c in piece) if all(c in byte_of for c in piece) else piece.encode()
    return out


def b_token_bytes(pieces: list[str], is_byte: list[bool]) -> list[bytes]:
    return [bytes([int(p[1:-1], 16)]) if raw else p.replace("▁", " ").encode() for p, raw in zip(pieces, is_byte)]


def aligned(a: list[int], b: list[int], a_bytes: list[bytes], b_bytes: list[bytes], shown: list[str]) -> tuple[int, list[int], str]:
    """(groups, link pairs, groups as text) of two sequences of tokens over the
    same bytes, not none; ``shown`` holds the decimals of all ids."""
    links, groups = [], []
    i = j = first_a = first_b = 0
    a_end, b_end = len(a_bytes[a[0]]), len(b_bytes[b[0]])
    while True:
        links.append(a[i] << B_BITS | b[j])
        if a_end < b_end:
            i += 1
            a_end += len(a_bytes[a[i]])
        elif b_end < a_end:
            j += 1
            b_end += len(b_bytes[b[j]])
        else:  # both end here
            i, j = i + 1, j + 1
            groups.append(",".join([shown[x] for x in a[first_a:i]]) + "|" + ",".join([shown[x] for x in b[first_b:j]]))
            if i == len(a):
                return len(groups), links, ";".join(groups)
            first_a, first_b = i, j
            a_end += len(a_bytes[a[i]])
            b_end += len(b_bytes[b[j]])


class Parts(dict):
    """A ids of the parts of plain words, filled on first use."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenize = tokenizer.model.tokenize
        self.shown = {i: tokenizer.pre_tokenizer.pre_tokenize_str("!" + chr(i))[-1][0].removeprefix("!") for i in (32, *range(192, 256))}

    def __missing__(self, part: str) -> list[int]:
        ids = self[part] = [t.id for t in self.tokenize(part.translate(self.shown))]
        return ids


class Aligner:
    """Both tokenizers and a cache of aligned words.

    A word, or a whole text, is (links, groups as text, counts): its packed
    link pairs, and the numbers of groups, B ids and A ids in one integer,
    which is negative where the tokens are not the text's bytes."""

    def __init__(self, a_path: str, b_path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a_bytes = a_token_bytes(self.a.get_vocab())
        n = self.b.get_piece_size()
        self.b_bytes = b_token_bytes([self.b.id_to_piece(i) for i in range(n)], [self.b.is_byte(i) for i in range(n)])
        #: Whether no piece holds a space but at its start: words do not meet then.
        self.by_word = not any("▁" in self.b.id_to_piece(i).lstrip("▁") for i in range(n))
        self.shown = [str(i) for i in range(max(len(self.a_bytes), n))]
        self.words: dict[str, tuple[bytes, str, int]] = {}
        self.parts = Parts(self.a)

    def a_ids(self, texts: list[str]) -> list[list[int]]:
        """The A ids of a space and each text; plain words by their parts."""
        out = [[i for p in PARTS(" " + t) for i in self.parts[p]] if PLAIN(t) else None for t in texts]
        odd = [k for k, ids in enumerate(out) if ids is None]
        for k, found in zip(odd, self.a.encode_batch_fast([" " + texts[k] for k in odd], add_special_tokens=False)):
            out[k] = found.ids
        return out

    def encoded(self, texts: list[str]) -> list[tuple[bytes, str, int]]:
        """A space and each text, encoded whole."""
        out = []
        for text, a, b in zip(texts, self.a_ids(texts), self.b.encode(texts, num_threads=1)):
            raw = (" " + text).encode()
            if b"".join([self.a_bytes[i] for i in a]) != raw or b"".join([self.b_bytes[i] for i in b]) != raw:
                out.append((b"", "", -1 << 3 * COUNT_BITS))
                continue
            groups, links, shown = aligned(a, b, self.a_bytes, self.b_bytes, self.shown)
            out.append((np.array(links, np.uint32).tobytes(), shown, groups << 2 * COUNT_BITS | len(b) << COUNT_BITS | len(a)))
        return out

    def batch(self, texts: list[str]) -> list[tuple | None]:
        """(A ids, B ids, groups, links, groups as text) of whole texts, word by
        word where words do not meet; None for an empty text and for one that
        is not whole."""
        split = [t.split(" ") if self.by_word and t and t[0] != " " and t[-1] != " " and not ODD_SPACE.search(t) else () for t in texts]
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
            self.parts.clear()
        known = self.words
        new = list(set().union(*split).difference(known))
        for k in range(0, len(new), 20_000):
            part = new[k:k + 20_000]
            known.update(zip(part, self.encoded(part)))
        out, low = [], (1 << COUNT_BITS) - 1
        for text, words in zip(texts, split):
            if not text:
                out.append(None)
                continue
            found = [known[w] for w in words] if words else self.encoded([text])
            counts = sum([f[2] for f in found])
            out.append(None if counts < 0 else (counts & low, counts >> COUNT_BITS & low, counts >> 2 * COUNT_BITS,
                                                b"".join([f[0] for f in found]), ";".join([f[1] for f in found])))
        return out


def packed(*arrays: np.ndarray) -> bytes:
    import zstandard

    body = b"".join(len(x).to_bytes(8, "little") + x.tobytes() for x in arrays)
    return zstandard.ZstdCompressor(level=LEVEL).compress(body)


def unpacked(frame: bytes, *kinds: str) -> list[np.ndarray]:
    import zstandard

    body, at, out = zstandard.ZstdDecompressor().decompress(frame), 0, []
    for kind in kinds:
        n, size = int.from_bytes(body[at:at + 8], "little"), np.dtype(kind).itemsize
        out.append(np.frombuffer(body, kind, n, at + 8))
        at += 8 + n * size
    return out


class Run:
    """The pair-document records of consecutive documents."""

    def __init__(self):
        self.docs, self.pairs, self.of, self.times = 0, [], [], []
        self.links = 0

    def add(self, links: bytes) -> None:
        if links:
            pairs, times = np.unique(np.frombuffer(links, np.uint32), return_counts=True)
            self.pairs.append(pairs)
            self.times.append(times.astype(np.uint32))
            self.of.append(np.full(len(pairs), self.docs, np.uint32))
            self.links += len(pairs)
        self.docs += 1

    def parts(self) -> Iterator[tuple[int, bytes, bytes]]:
        """(bucket, pairs frame, documents frame), sorted by pair and document."""
        if not self.pairs:
            return
        pairs, of, times = (np.concatenate(x) for x in (self.pairs, self.of, self.times))
        order = np.argsort(pairs, kind="stable")
        pairs, of, times = pairs[order], of[order], times[order]
        start = np.flatnonzero(np.concatenate(([True], pairs[1:] != pairs[:-1])))
        n = np.diff(np.concatenate((start, [len(pairs)]))).astype(np.uint64)
        keys = pairs[start]
        bucket = radix(keys)
        edges = np.searchsorted(bucket, np.arange(BUCKETS + 1))
        rows = np.concatenate((start, [len(pairs)]))
        for k in range(BUCKETS):
            lo, hi = edges[k], edges[k + 1]
            if lo < hi:
                x, y = rows[lo], rows[hi]
                yield k, packed(np.diff(keys[lo:hi], prepend=np.uint32(0)), n[lo:hi]), packed(of[x:y], times[x:y])


def radix(keys: np.ndarray) -> np.ndarray:
    """The bucket of a pair, by the high bits of its A id."""
    return ((keys.astype(np.uint64) * BUCKETS) >> 32).astype(np.int64)


def pairs_of(frame: bytes) -> tuple[np.ndarray, np.ndarray]:
    steps, n = unpacked(frame, "<u4", "<u8")
    return np.cumsum(steps, dtype=np.uint32), n


def merged(frames: list[bytes], back: bool) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Runs merged by a heap over their next A ids: (pairs, counts), and with
    ``back`` for every run its pairs' counts and whether each is its A id's highest."""
    runs = [pairs_of(f) for f in frames]
    sides = [p >> B_BITS for p, _ in runs]
    counts = [np.zeros(len(p), np.uint64) for p, _ in runs]
    best = [np.zeros(len(p), bool) for p, _ in runs]
    heap = [(int(s[0]), r, 0) for r, s in enumerate(sides) if len(s)]
    heapq.heapify(heap)
    out_pairs, out_counts = [], []
    while heap:
        a, parts = heap[0][0], []
        while heap and heap[0][0] == a:  # every run that holds this A id
            _, r, lo = heap[0]
            hi = int(np.searchsorted(sides[r], a, "right"))
            parts.append((r, lo, hi))
            if hi < len(sides[r]):
                heapq.heapreplace(heap, (int(sides[r][hi]), r, hi))
            else:
                heapq.heappop(heap)
        keys, place = np.unique(np.concatenate([runs[r][0][lo:hi] for r, lo, hi in parts]), return_inverse=True)
        total = np.zeros(len(keys), np.uint64)
        np.add.at(total, place, np.concatenate([runs[r][1][lo:hi] for r, lo, hi in parts]))
        out_pairs.append(keys)
        out_counts.append(total)
        if back:
            top, at = total == total.max(), 0
            for r, lo, hi in parts:
                own = place[at:at + hi - lo]
                counts[r][lo:hi], best[r][lo:hi] = total[own], top[own]
                at += hi - lo
    none = np.zeros(0, np.uint32)
    return (np.concatenate(out_pairs) if out_pairs else none, np.concatenate(out_counts) if out_counts else none.astype(np.uint64), counts, best)


def scanned(docs: DataFrame, a_path: str, b_path: str, text_col: str) -> DataFrame:
    """One row a document (its base columns) and one a run's bucket (its frames)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        aligner = worker_cached(("aligner", a_path, b_path), lambda: Aligner(a_path, b_path))
        current, at = Run(), 0
        task = TaskContext.get().partitionId() << 32
        columns = ("key", "run", "slot", "n_a", "n_b", "n_groups", "n_links", "sha", "bucket", "pairs", "docs")
        schema = pa.schema([("key", pa.int64()), ("run", pa.int64()), ("slot", pa.int32()), *((c, pa.int64()) for c in columns[3:7]),
                            ("sha", pa.string()), ("bucket", pa.int32()), ("pairs", pa.binary()), ("docs", pa.binary())])

        def table(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        def closed() -> Iterator[pa.RecordBatch]:
            for bucket, pairs, of in current.parts():
                yield table([(None, task | at, None, None, None, None, None, None, bucket, pairs, of)])

        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part, rows = batch.slice(lo, 256), []
                for key, found in zip(part.column(0).to_pylist(), aligner.batch(part.column(1).to_pylist())):
                    a, b, groups, links, shown = found or (0, 0, 0, b"", "")
                    sha = hashlib.sha256(shown.encode()).hexdigest() if found else ""
                    rows.append((key, task | at, current.docs, a, b, groups, len(links) // 4, sha, None, None, None))
                    current.add(links)
                    if current.docs >= RUN_DOCS or current.links >= RUN_LINKS:
                        yield from closed()
                        current, at = Run(), at + 1
                if rows:
                    yield table(rows)
        yield from closed()

    kinds = ("key long, run long, slot int, n_a long, n_b long, n_groups long, n_links long, sha string, bucket int, pairs binary, docs binary")
    return docs.select("key", text_of(text_col).alias("t")).mapInArrow(run, kinds)


def upwards(runs: DataFrame) -> DataFrame:
    """(run, bucket, pairs): ``FAN_IN`` runs of a bucket as one."""
    def fold(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        pairs, counts, _, _ = merged(list(rows["pairs"]), back=False)
        return pd.DataFrame({"run": [key[1]], "bucket": [key[0]], "pairs": [packed(np.diff(pairs, prepend=np.uint32(0)), counts)]})

    return runs.groupBy("bucket", "parent").applyInPandas(fold, "run long, bucket int, pairs binary")


def downwards(runs: DataFrame, above: DataFrame | None) -> DataFrame:
    """(run, bucket, back): for every run its pairs' counts over all runs and
    whether each is its A id's highest.  ``above``: the same of the merged runs,
    None if one merge holds all runs."""
    def spread(rows: pd.DataFrame, over: pd.DataFrame | None) -> pd.DataFrame:
        frames = list(rows["pairs"])
        pairs, _, counts, best = merged(frames, back=over is None)
        if over is not None:
            total, top = unpacked(over["back"].iloc[0], "<u8", "?")
            places = [np.searchsorted(pairs, pairs_of(f)[0]) for f in frames]
            counts, best = [total[p] for p in places], [top[p] for p in places]
        return pd.DataFrame({"run": rows["run"], "bucket": rows["bucket"], "back": [packed(c, b) for c, b in zip(counts, best)]})

    kinds = "run long, bucket int, back binary"
    if above is None:
        return runs.groupBy("bucket").applyInPandas(lambda rows: spread(rows, None), kinds)
    return runs.groupBy("bucket", "parent").cogroup(above.groupBy("bucket", "run")).applyInPandas(spread, kinds)


def counted(runs: DataFrame) -> DataFrame:
    """(run, bucket, back) of ``runs`` (run, bucket, pairs), merged in rounds of ``FAN_IN``."""
    rounds, most = [], runs.groupBy("bucket").count().agg(F.max("count")).first()[0] or 0
    while most > FAN_IN:
        # Every round cuts the runs of a bucket by its fan, whatever their numbers.
        parent = F.pmod(F.xxhash64("run"), F.lit(-(-most // FAN_IN) * 2))
        rounds.append(materialized(runs.withColumn("parent", parent), "align-round"))
        runs = materialized(upwards(rounds[-1]), "align-merged")
        before, most = most, runs.groupBy("bucket").count().agg(F.max("count")).first()[0]
        if most >= before:
            break
    back = downwards(runs, None)
    for level in reversed(rounds):
        back = downwards(level, materialized(back, "align-back"))
    return back


def align(docs: DataFrame, a_path: str, b_path: str, text_col: str = "text") -> DataFrame:
    """``docs`` columns n_a, n_b, n_groups, n_links, n_best, count_sum and
    groups_sha256 by ``key`` (a unique long)."""
    found = materialized(scanned(docs, a_path, b_path, text_col), "align-scan")
    runs = found.where("bucket is not null")
    back = counted(runs.select("run", "bucket", "pairs"))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run, frame, of, told in zip(*(batch.column(i) for i in range(4))):
                _, n = pairs_of(frame.as_py())
                slot, times = unpacked(of.as_py(), "<u4", "<u4")
                total, top = unpacked(told.as_py(), "<u8", "?")
                rows = np.repeat(np.arange(len(n)), n.astype(np.int64))
                size = int(slot.max()) + 1
                best, count = np.zeros(size, np.int64), np.zeros(size, np.int64)
                np.add.at(best, slot, times * top[rows])
                np.add.at(count, slot, times.astype(np.int64) * total[rows].astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(size, run.as_py(), np.int64)), pa.array(np.arange(size, dtype=np.int32)),
                                                  pa.array(best), pa.array(count)], ["run", "slot", "n_best", "count_sum"])

    told = (runs.select("run", "bucket", "pairs", "docs").join(back, ["run", "bucket"]).select("run", "pairs", "docs", "back")
            .mapInArrow(sums, "run long, slot int, n_best long, count_sum long")
            .groupBy("run", "slot").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum")))
    return (found.where("bucket is null").drop("bucket", "pairs", "docs").join(told, ["run", "slot"], "left")
            .select("key", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).alias("n_best"),
                    F.coalesce("count_sum", F.lit(0)).alias("count_sum"), F.col("sha").alias("groups_sha256")))


def digest(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document."""
    slim = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).alias(text_col))
    return align(slim, a_path, b_path, text_col).withColumnRenamed("key", id_col)
