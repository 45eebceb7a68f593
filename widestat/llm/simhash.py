"""SimHash near-duplicates by a binary trie self-join.

Fingerprints (64 bits, see ``fingerprint``) form a binary trie: a node is a
prefix, its leaves are the distinct fingerprints below it.  The self-join walks
pairs of nodes of the same depth together, adds the bits in which their
prefixes differ, and drops a pair once the sum exceeds ``max_bits``.  The upper
part of the walk is a sequence of joins that opens every pair with a node of
more than ``node_size`` fingerprints by ``STEP`` bits; the rest of each
remaining pair is walked inside one task over two sorted arrays of at most
``node_size`` fingerprints each.  A task hands on a forest of the links it
found, not all pairs, so a dense group stays linear; the links of all tasks are
joined to connected components.

Definition: A-Z are lowered, words are runs without ASCII white space, shingles
are runs of ``shingle`` words joined by a space, repeats included (fewer words:
the whole sequence).  A bit is set if it is set in over half of the shingles'
XXH64 values (UTF-8, seed 42).  A null or empty text, and one without words,
has fingerprint zero, which is linked like any other.  Repeated rows share a
fingerprint and so a component.  A null id stays null and never names a
component; the component of rows without any id is null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from widestat.llm.common import materialized, text_of
from widestat.llm.components import components

STEP = 2
NODE_SIZE = 16_384
SEED = 42
#: Node pairs walked at a time, and the product of sizes below which a pair is
#: compared directly: at most their product of fingerprint pairs is held at once.
CHUNK, DIRECT = 4_096, 64


def fingerprint(text: str, shingle: int) -> int:
    """The unsigned 64-bit fingerprint of a text."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split()  # both touch ASCII only
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    hashes = np.fromiter((xxh64_intdigest(b" ".join(words[i:i + shingle]), SEED) for i in range(n)), "<u8", n)
    ones = np.zeros(64, np.int64)
    for part in range(0, n, 8192):
        ones += np.unpackbits(hashes[part:part + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the fingerprint as a signed long, one row for each input row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["id", "fp"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("t")).mapInArrow(run, f"id {id_type}, fp long")


class Forest:
    """Union-find over the positions of one task's fingerprints."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.parent[i], self.parent[j]
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = self.parent[self.parent]
                if (up == self.parent).all():
                    break
                self.parent = up


def walk(a: np.ndarray, b: np.ndarray, depth: int, differing: int, same: bool, max_bits: int, link) -> None:
    """Call ``link(i, j)`` with the positions of all pairs within ``max_bits``
    below the nodes ``a`` and ``b``: sorted unsigned arrays that agree within
    themselves in their first ``depth`` bits and differ from each other in
    ``differing`` of these.  ``same``: both are one node; then i < j."""
    one = lambda x: np.array([x])
    stack = [(depth, one(0), one(len(a)), one(0), one(len(b)), one(differing))]
    while stack:
        depth, alo, ahi, blo, bhi, err = stack.pop()
        if len(alo) > CHUNK:
            half = len(alo) // 2
            for part in (slice(half, None), slice(None, half)):
                stack.append((depth, *(x[part] for x in (alo, ahi, blo, bhi, err))))
            continue
        na, nb = ahi - alo, bhi - blo
        direct = na * nb <= DIRECT
        if direct.any():
            n, width, lo_a, lo_b = (na * nb)[direct], nb[direct], alo[direct], blo[direct]
            row = np.repeat(np.arange(len(n)), n)
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            i, j = lo_a[row] + k // width[row], lo_b[row] + k % width[row]
            near = np.bitwise_count(a[i] ^ b[j]) <= max_bits
            if same:
                near &= i < j
            if near.any():
                link(i[near], j[near])
        rest = ~direct
        if not rest.any():
            continue
        alo, ahi, blo, bhi, err = (x[rest] for x in (alo, ahi, blo, bhi, err))
        bit = np.uint64(1) << np.uint64(63 - depth)
        high = ~((bit << np.uint64(1)) - np.uint64(1)) if depth else np.uint64(0)
        amid = np.searchsorted(a, (a[alo] & high) | bit)
        bmid = np.searchsorted(b, (b[blo] & high) | bit)
        children = [(alo, amid, blo, bmid, err), (amid, ahi, bmid, bhi, err), (alo, amid, bmid, bhi, err + 1),
                    (amid, ahi, blo, bmid, err + 1)]
        if same:  # the mirrored child of a node paired with itself
            twin = alo == blo
            children[3] = tuple(x[~twin] for x in children[3])
        parts = [np.concatenate([c[k] for c in children]) for k in range(5)]
        live = (parts[0] < parts[1]) & (parts[2] < parts[3]) & (parts[4] <= max_bits)
        if live.any():
            stack.append((depth + 1, *(x[live] for x in parts)))


def linked(a: np.ndarray, b: np.ndarray, depth: int, differing: int, same: bool, max_bits: int):
    """A forest (u, v) with the connectivity of all links between ``a`` and ``b``."""
    values = a if same else np.concatenate([a, b])
    forest = Forest(len(values))
    shift = 0 if same else len(a)
    walk(a, b, depth, differing, same, max_bits, lambda i, j: forest.add(i, j + shift))
    child = np.flatnonzero(forest.parent != np.arange(len(values)))
    return values[child], values[forest.parent[child]]


def node_pairs(distinct: DataFrame, max_bits: int, node_size: int) -> tuple[DataFrame, list[int]]:
    """(depth, a, b, differing) for every pair of trie nodes within
    ``max_bits`` whose nodes hold at most ``node_size`` fingerprints, a <= b,
    and the depths that occur."""
    spark = distinct.sparkSession
    open_pairs = spark.createDataFrame([(0, 0, 0)], "a long, b long, differing int")
    done, depths = None, []
    for depth in range(STEP, 65, STEP):
        nodes = (distinct.groupBy(F.shiftrightunsigned("fp", 64 - depth).alias("node")).agg(F.count("*").alias("n"))
                 .withColumn("parent", F.shiftrightunsigned("node", STEP)))
        first = nodes.select(F.col("parent").alias("a"), F.col("node").alias("ca"), F.col("n").alias("na"))
        second = nodes.select(F.col("parent").alias("b"), F.col("node").alias("cb"), F.col("n").alias("nb"))
        met = (open_pairs.join(first, "a").join(second, "b").where("a <> b or ca <= cb")
               .withColumn("differing", (F.col("differing") + F.bit_count(
                   F.col("ca").bitwiseXOR(F.col("cb")).bitwiseAND(F.lit((1 << STEP) - 1)))).cast("int"))
               .where(F.col("differing") <= max_bits)
               .select(F.col("ca").alias("a"), F.col("cb").alias("b"), "differing",
                       (F.greatest("na", "nb") > node_size).alias("large")))
        met = materialized(met, "simhash-pairs")
        found = {r["large"] for r in met.groupBy("large").count().collect()}
        if False in found:
            small = met.where(~F.col("large")).select(F.lit(depth).alias("depth"), "a", "b", "differing")
            done = small if done is None else done.unionByName(small)
            depths.append(depth)
        if True not in found:
            break
        open_pairs = met.where("large").drop("large")
    if done is None:  # an empty table
        done = spark.createDataFrame([], "depth int, a long, b long, differing int")
    return done, depths


def near_links(distinct: DataFrame, max_bits: int, node_size: int = NODE_SIZE) -> DataFrame:
    """Edges (u, v) between distinct fingerprints (column ``fp``) that connect
    exactly the fingerprints that a chain of links connects."""
    pairs, depths = node_pairs(distinct, max_bits, node_size)
    blocks = None
    for depth in depths:
        block = _small_blocks(distinct, depth, node_size)
        blocks = block if blocks is None else blocks.unionByName(block)
    if blocks is None:
        return distinct.sparkSession.createDataFrame([], "u long, v long")
    first = blocks.select("depth", F.col("node").alias("a"), F.col("fps").alias("fa"))
    second = blocks.select("depth", F.col("node").alias("b"), F.col("fps").alias("fb"))
    both = (pairs.join(first, ["depth", "a"]).join(second, ["depth", "b"])
            .select("depth", "differing", (F.col("a") == F.col("b")).alias("same"), "fa", "fb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for depth, differing, same, fa, fb in zip(*(batch.column(i) for i in range(5))):
                a, b = (np.sort(x.values.to_numpy().view(np.uint64)) for x in (fa, fb))
                u, v = linked(a, b, depth.as_py(), differing.as_py(), same.as_py(), max_bits)
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    return both.mapInArrow(run, "u long, v long")


def _small_blocks(distinct: DataFrame, depth: int, node_size: int) -> DataFrame:
    """The nodes of one depth that hold at most ``node_size``
    fingerprints; larger ones are counted out before anything is gathered."""
    prefix = F.shiftrightunsigned("fp", 64 - depth)
    small = distinct.groupBy(prefix.alias("node")).agg(F.count("*").alias("n")).where(F.col("n") <= node_size).select("node")
    return (distinct.select(prefix.alias("node"), "fp").join(small, "node").groupBy("node")
            .agg(F.collect_list("fp").alias("fps")).select(F.lit(depth).alias("depth"), "node", "fps"))


def near_duplicates(docs: DataFrame, shingle: int = 4, max_bits: int = 4, id_col: str = "doc_id",
                    text_col: str = "text", node_size: int = NODE_SIZE) -> DataFrame:
    """(doc_id, fp, component_id), one row for each input row: the least id
    reachable over links of at most ``max_bits`` differing bits."""
    prints = materialized(fingerprints(docs, shingle, id_col, text_col), "simhash-fp")
    distinct = materialized(prints.groupBy("fp").agg(F.min("id").alias("least")), "simhash-distinct")
    roots = components(near_links(distinct, max_bits, node_size))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return prints.join(named, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The fingerprint as 16 hex digits."""
    return found.select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
