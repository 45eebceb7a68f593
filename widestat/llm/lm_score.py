"""Cross-entropy difference of two n-gram models.

Tokens are characters; a text is read after ``ORDER - 1`` begin marks and ends
with an end mark.  Both models count the same n-grams and share one vocabulary
(the characters of the corpus): the target model over every document labelled
good, the background model over all documents.  They are matched: the
background's counts are scaled to the target's total, and both are smoothed
alike, order by order,

    p_k(w | h) = (c(h w) + mu p_{k-1}(w | h')) / (c(h) + mu),

where h' drops the first character of h, down to add-one over the vocabulary.
A document's score is the mean over its tokens of background loss less target
loss, so higher is closer to the target.

Counts cover every character of every document; which ones are good is a join,
so neither their ids nor their number pass through the driver.  They are folded by Arrow batch
and by task and summed in a shuffle, so what is gathered grows with the input.
Only n-grams of the highest order are counted; the lower orders are sums of
these.  The finished model, one row for each n-gram seen, goes to the tasks in
blocks of at most ``BLOCK_GRAMS`` n-grams, one scan of the documents for each
block, whose sums are written before the next block is fetched; every loss is a
sum over n-grams, so the blocks' sums add up.

A null text counts as empty: its only token is the end mark.  Repeated rows are
each counted and scored.  Labels: a document is good if all its labels say so;
null labels and ids are left out.  Without any good document the target counts
nothing and every score says so by the smoothing alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from widestat.llm.common import materialized, text_of
from widestat.session import scratch_path

ORDER = 5
MU = 5.0
BLOCK_GRAMS = 4_000_000
BITS = 21
LOW = (1 << BITS) - 1
BEGIN, END = 0x110000, 0x110001
#: Characters counted at a time by a task.
SLICE = 500_000


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(high, low, length): the n-gram that ends at each token of the texts,
    packed in 2 and 3 characters, and the tokens of each text."""
    pad = np.full(ORDER - 1, BEGIN, np.int64)
    parts, lengths = [], np.array([len(t) + 1 for t in texts], np.int64)
    for t in texts:
        parts += [pad, np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64), np.array([END])]
    flat = np.concatenate(parts)
    ends = np.concatenate([np.arange(n) for n in lengths]) + np.repeat(
        np.cumsum(lengths + ORDER - 1) - lengths, lengths)
    a, b, c, d, e = (flat[ends - back] for back in range(ORDER - 1, -1, -1))
    return (a << BITS) | b, (c << 2 * BITS) | (d << BITS) | e, lengths


def keys(high: np.ndarray, low: np.ndarray, salt: int = 0) -> np.ndarray:
    """One 64-bit key for each packed n-gram."""
    h = high.astype(np.uint64) + np.uint64(salt)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h ^= low.astype(np.uint64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about SLICE characters, at least one text each."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t) + ORDER
        if size >= SLICE:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def good_documents(labels: DataFrame) -> DataFrame:
    """(doc_id) of every document labelled good and not toxic, once each."""
    return (labels.where("doc_id is not null").groupBy("doc_id")
            .agg(F.min("quality").alias("good"), F.max("toxic").alias("bad"))
            .where("good = 1 and coalesce(bad, 0) = 0").select("doc_id"))


def target_ids(labels: DataFrame, limit: int) -> np.ndarray:
    """Sorted ids of at most ``limit`` good documents, those with the least
    hashes: a look at the labels; the model is fitted on all of them."""
    rows = good_documents(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit).collect()
    return np.sort(np.array([r[0] for r in rows], np.int64))


def count_grams(docs: DataFrame, good: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(high, low, target, background): counts of every n-gram seen, in the
    documents of ``good`` (doc_id) and in all."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            is_good, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            for i, j in slices(texts):
                high, low, lengths = grams(texts[i:j])
                is_target = np.repeat(is_good[i:j], lengths)
                _, at, back, n = np.unique(keys(high, low), return_index=True, return_inverse=True, return_counts=True)
                t = np.bincount(back, is_target, len(n)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (high[at], low[at], t, n)],
                                                 ["high", "low", "target", "background"])

    # A shuffle join at every size: the ids of a partition are its hash table, no text is sorted.
    own = good.select(F.col("doc_id").cast("long").alias("id"), F.lit(True).alias("good")).hint("shuffle_hash")
    parts = (docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("t")).join(own, "id", "left")
             .select(F.coalesce("good", F.lit(False)).alias("good"), "t")
             .mapInArrow(run, "high long, low long, target long, background long"))
    return parts.groupBy("high", "low").agg(F.sum("target").alias("target"), F.sum("background").alias("background"))


def suffix(high: Column, low: Column, k: int) -> list[Column]:
    """The last ``k`` characters of a packed n-gram."""
    if k > 3:
        return [high.bitwiseAND(F.lit((1 << BITS * (k - 3)) - 1)), low]
    return [F.lit(0).cast("long"), low.bitwiseAND(F.lit((1 << BITS * k) - 1))]


def before_last(high: Column, low: Column) -> list[Column]:
    """All characters but the last."""
    return [F.shiftright(high, BITS),
            F.shiftright(low, BITS).bitwiseOR(F.shiftleft(high.bitwiseAND(F.lit(LOW)), 2 * BITS))]


def fit(counts: DataFrame, mu: float = MU) -> DataFrame:
    """(high, low, target_loss, background_loss) of every n-gram seen, in nats."""
    counts = materialized(counts, "lm-counts")
    of_one = counts.groupBy(F.col("low").bitwiseAND(F.lit(LOW)).alias("low")).agg(
        F.sum("target").alias("target"), F.sum("background").alias("background"))
    total = of_one.agg(F.count("*").alias("v"), F.sum("target").alias("t"), F.sum("background").alias("b")).first()
    ratio = (total["t"] or 0) / max(1, total["b"] or 0)
    size = (total["t"] or 0) + total["v"]
    model = of_one.select(F.lit(0).cast("long").alias("high"), "low",
                          ((F.col("target") + 1) / F.lit(float(size))).alias("pt"),
                          ((F.col("background") * ratio + 1) / F.lit(float(size))).alias("pb"))
    for k in range(2, ORDER + 1):
        h, lo = suffix(F.col("high"), F.col("low"), k)
        of_k = counts.groupBy(h.alias("high"), lo.alias("low")).agg(
            F.sum("target").alias("target"), (F.sum("background") * ratio).alias("background"))
        bh, bl = before_last(F.col("high"), F.col("low"))
        of_k = of_k.withColumns({"bh": bh, "bl": bl})
        sums = of_k.groupBy("bh", "bl").agg(F.sum("target").alias("ct"), F.sum("background").alias("cb"))
        sh, sl = suffix(F.col("high"), F.col("low"), k - 1)
        shorter = model.select(F.col("high").alias("sh"), F.col("low").alias("sl"), "pt", "pb")
        model = (of_k.withColumns({"sh": sh, "sl": sl}).join(sums, ["bh", "bl"]).join(shorter, ["sh", "sl"])
                 .select("high", "low",
                         ((F.col("target") + mu * F.col("pt")) / (F.col("ct") + mu)).alias("pt"),
                         ((F.col("background") + mu * F.col("pb")) / (F.col("cb") + mu)).alias("pb")))
    return materialized(model.select("high", "low", (-F.log("pt")).alias("target_loss"), (-F.log("pb")).alias("background_loss")),
                        "lm-model")


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          block_grams: int = BLOCK_GRAMS) -> DataFrame:
    """(doc_id, n_tokens, target_loss, background_loss, score), losses in nats
    a token, one row for each input row."""
    spark = docs.sparkSession
    model = fit(count_grams(docs, good_documents(labels), id_col, text_col))
    blocks = max(1, -(-model.count() // block_grams))
    id_type = docs.schema[id_col].dataType.simpleString()
    chosen = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_of(text_col)).alias("text_key"), text_of(text_col).alias("t"))

    def scan(block: int) -> tuple[DataFrame, Broadcast]:
        part = model.where(F.pmod(F.xxhash64("high", "low"), F.lit(blocks)) == block).toArrow()
        high, low, target, background = (part.column(i).to_numpy() for i in range(4))
        salt, key = 0, keys(high, low)
        while len(np.unique(key)) < len(key):
            salt += 1
            key = keys(high, low, salt)
        order = np.argsort(key)
        sent = spark.sparkContext.broadcast((key[order], target[order], background[order], salt))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table, target, background, salt = sent.value
            for batch in batches:
                texts = batch.column(2).to_pylist()
                sums = np.zeros((2, len(texts)))
                for i, j in slices(texts):
                    high, low, lengths = grams(texts[i:j])
                    seen, back = np.unique(keys(high, low, salt), return_inverse=True)
                    at = np.minimum(np.searchsorted(table, seen), max(0, len(table) - 1))
                    here = table[at] == seen if len(table) else np.zeros(len(seen), bool)
                    starts = np.cumsum(lengths) - lengths
                    for k, loss in enumerate((target, background)):
                        value = np.where(here, loss[at], 0.0) if len(table) else np.zeros(len(seen))
                        sums[k, i:j] = np.add.reduceat(value[back], starts)
                tokens = pa.array([len(t) + 1 for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), tokens, pa.array(sums[0]), pa.array(sums[1])],
                                                 ["id", "text_key", "n_tokens", "target_sum", "background_sum"])

        return chosen.mapInArrow(run, f"id {id_type}, text_key long, n_tokens long, target_sum double, background_sum double"), sent

    if blocks == 1:
        sums, _ = scan(0)
    else:
        path = scratch_path(spark, "lm-sums")
        for b in range(blocks):  # one block of the model in the driver and the executors at a time
            sums, sent = scan(b)
            sums.write.mode("append").parquet(path)
            sent.destroy()
        sums = spark.read.schema(sums.schema).parquet(path)
        # equal rows give equal sums: add over the blocks, then repeat by their number
        sums = (sums.groupBy("id", "text_key", "n_tokens").agg(
            F.sum("target_sum").alias("ts"), F.sum("background_sum").alias("bs"), (F.count("*") / blocks).cast("int").alias("n"))
            .select("id", "n_tokens", F.expr("ts / n").alias("target_sum"), F.expr("bs / n").alias("background_sum"),
                    F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy")))
    t, b = F.col("target_sum") / F.col("n_tokens"), F.col("background_sum") / F.col("n_tokens")
    return sums.select(F.col("id").alias(id_col), "n_tokens", t.alias("target_loss"), b.alias("background_loss"),
                       (b - t).alias("score"))
