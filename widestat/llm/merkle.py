"""Merkle manifest of a dataset by nested-struct rollup.

Every row is a leaf: a hash of its fields.  The leaves of a group (a source)
ascend by id; every three consecutive nodes become one until one remains, the
subroot.  The subroots, ordered by group, become the root the same way.  H is
lowercase hex SHA-256 of the concatenated inputs, digests as hex text.

The rank of a leaf in its group is written in base three.  Six digits make a
block of at most 729 leaves.  Inside a block the digits are grouped away one
after the other: the rows that differ in the lowest digit left become the child
structs of one row, which gets their hash.  The block ends as one row that
holds its tree.  The roots of the blocks are the leaves of the next tier, until
a group has one block.  On the way down a block's row takes the path above it,
a transform opens its tree level by level, and an explode emits each leaf with
its whole path.  A path comes to its block in one grouping of both by block,
so a leaf never meets its siblings in a join, and no row holds more than one block.

Ranks need no single task: the leaves are range-partitioned, written with
their place, and get the counts of the partitions before.  A group with a third
of all rows, or one row repeated many times, is spread like any other.

Nulls: a null field hashes as ``-``, a null group is a group and comes first, a
null id comes first in its group.  Rows with equal ids are ordered by their
leaf, equal rows get equal leaves and a place each.  An empty text hashes as
``0:``.  An empty table has no rows in the manifest.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from widestat.llm.common import materialized

FAN, DIGITS = 3, 6
BLOCK = FAN ** DIGITS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: ``monotonically_increasing_id`` holds the partition above this bit.
ROW_BITS = 33
PATH = "array<struct<left:string,right:string>>"


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def hashed(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf_of(fields: Sequence[Column]) -> Column:
    return hashed(*map(field, fields))


def ranked(nodes: DataFrame, order: Sequence[str]) -> DataFrame:
    """``nodes`` (grp, ...) with ``rank`` from 0 in the group's order and ``n``,
    the size of the group."""
    placed = materialized(
        nodes.repartitionByRange("grp", *order).sortWithinPartitions("grp", *order)
        .withColumn("place", F.monotonically_increasing_id()), "merkle-placed")
    part = F.shiftright("place", ROW_BITS)
    sizes = placed.groupBy("grp", part.alias("part")).agg(F.count("*").alias("here"), F.min("place").alias("start"))
    # A group has as many rows here as partitions that hold it.
    along = Window.partitionBy("grp")
    sizes = (sizes.withColumn("n", F.sum("here").over(along))
             .withColumn("before", F.sum("here").over(along.orderBy("part")) - F.col("here"))
             .select(F.col("grp").alias("of"), F.col("part").alias("in"), "n", (F.col("before") - F.col("start")).alias("shift")))
    return (placed.join(sizes, (F.col("grp") == F.col("of")) & (part == F.col("in")))
            .withColumn("rank", F.col("place") + F.col("shift")).drop("of", "in", "place", "shift"))


def levels(n: Column) -> Column:
    """How often the nodes of a group are folded in one tier."""
    out = F.lit(DIGITS)
    for k in reversed(range(DIGITS)):
        out = F.when(n <= FAN ** k, k).otherwise(out)
    return out


def rolled(nodes: DataFrame) -> DataFrame:
    """(grp, block, n, hash, kids) of ``nodes`` (grp, rank, n, hash, info): one
    row for each block, its tree in ``kids``."""
    digits = [f"d{k}" for k in range(DIGITS)]
    rows = nodes.select(
        "grp", F.expr(f"rank div {BLOCK}").alias("block"), "n",
        *(F.expr(f"rank div {FAN ** k} % {FAN}").cast("tinyint").alias(f"d{k}") for k in range(DIGITS)),
        F.col("hash"), F.col("info").alias("kids")).repartition("grp", "block")
    for k, digit in enumerate(digits):
        child = F.struct(F.col(digit).alias("d"), "hash", "kids")
        rows = rows.groupBy("grp", "block", "n", *digits[k + 1:]).agg(F.array_sort(F.collect_list(child)).alias("kids"))
        own = hashed(F.array_join(F.transform("kids", lambda c: c["hash"]), ""))
        rows = rows.withColumn("hash", F.when(levels(F.col("n")) > k, own).otherwise(F.col("kids")[0]["hash"]))
    return rows.select("grp", "block", "n", "hash", "kids")


def tiers(nodes: DataFrame) -> list[DataFrame]:
    """The block tables from the leaves up; the last has one row a group."""
    most, found = nodes.agg(F.max("n")).first()[0] or 1, []
    while True:
        found.append(materialized(rolled(nodes), "merkle-blocks"))
        most = -(-most // BLOCK)
        if most <= 1:
            return found
        nodes = found[-1].select("grp", F.col("block").alias("rank"), F.ceil(F.col("n") / BLOCK).alias("n"), "hash",
                                 F.struct("block").alias("info"))


def opened(blocks: DataFrame, above: DataFrame) -> DataFrame:
    """(grp, info, hash, path, top) of every leaf of ``blocks``.  ``above``: (grp, block,
    path, top), the path from each block's root upwards."""
    both = (blocks.select("grp", "block", "n", "kids", F.lit(None).cast(PATH).alias("path"), F.lit(None).cast(above.schema["top"].dataType).alias("top"))
            .unionByName(above.select("grp", "block", F.lit(None).cast("long").alias("n"),
                                      F.lit(None).cast(blocks.schema["kids"].dataType).alias("kids"), "path", "top")))
    met = both.groupBy("grp", "block").agg(*(F.first(c, ignorenulls=True).alias(c) for c in ("n", "kids", "path", "top")))
    met = met.withColumn("levels", levels(F.col("n")))

    def joined(kids: Column, where) -> Column:
        return F.array_join(F.transform(F.filter(kids, where), lambda c: c["hash"]), "")

    def below(k: int):
        def children(node: Column) -> Column:
            def child(c: Column) -> Column:
                step = F.struct(joined(node["kids"], lambda x: x["d"] < c["d"]).alias("left"),
                                joined(node["kids"], lambda x: x["d"] > c["d"]).alias("right"))
                path = F.when(F.col("levels") > k, F.concat(F.array(step), node["path"])).otherwise(node["path"])
                return F.struct(c["hash"].alias("hash"), c["kids"].alias("kids"), path.alias("path"))
            return F.transform(node["kids"], child)
        return children

    front = F.array(F.struct(F.lit("").alias("hash"), "kids", "path"))
    for k in reversed(range(DIGITS)):
        front = F.flatten(F.transform(front, below(k)))
    return met.select("grp", "top", F.explode(front).alias("x")).select(
        "grp", F.col("x.kids").alias("info"), F.col("x.hash").alias("hash"), F.col("x.path").alias("path"), "top")


def climbed(found: list[DataFrame], above: DataFrame) -> DataFrame:
    """Every leaf of the tiers with its whole path; ``above`` (grp, path, top)
    holds the path from each group's own root."""
    above = above.select("grp", F.lit(0).cast("long").alias("block"), "path", "top")
    for blocks in reversed(found[1:]):
        above = opened(blocks, above).select("grp", F.col("info.block").alias("block"), "path", "top")
    return opened(found[0], above)


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, group_col: str = "source", id_col: str = "doc_id",
             extra: dict[str, Column] | None = None) -> DataFrame:
    """(id, extra columns, leaf, subroot, root, path): one row for each input
    row.  ``path`` leads from the leaf to the root: at each level the digests
    that stand left and right of the node in its run, joined."""
    extra = extra or {}
    leaves = materialized(docs.select(
        F.coalesce(F.concat(F.lit("s"), F.col(group_col).cast("string")), F.lit("n")).alias("grp"),  # null first
        leaf_of([F.col(c) for c in fields]).alias("hash"), F.col(id_col).alias("id"),
        F.struct(F.col(id_col).alias("id"), *(c.alias(f"x_{name}") for name, c in extra.items())).alias("info"),
        F.xxhash64(F.monotonically_increasing_id()).alias("salt")), "merkle-leaves")
    within = tiers(materialized(ranked(leaves, ["id", "hash", "salt"]).select("grp", "rank", "n", "hash", "info"), "merkle-ranked"))
    sources = within[-1].select(F.lit("").alias("grp"), F.col("grp").alias("name"), "hash",
                                F.struct(F.col("grp").alias("name")).alias("info"))
    across = tiers(ranked(sources, ["name"]).select("grp", "rank", "n", "hash", "info"))
    root = across[-1].select("grp", F.array().cast(PATH).alias("path"), F.col("hash").alias("top"))
    above = climbed(across, root).select(F.col("info.name").alias("grp"), "path",
                                         F.struct(F.col("hash").alias("subroot"), F.col("top").alias("root")).alias("top"))
    return climbed(within, above).select(F.col("info.id").alias(id_col), *(F.col(f"info.x_{name}").alias(name) for name in extra),
                                         F.col("hash").alias("leaf"), "top.subroot", "top.root", "path")


def proof_text(path: Column) -> Column:
    """All digests of a path, level by level, left to right."""
    return F.array_join(F.transform(path, lambda p: F.concat(p["left"], p["right"])), "")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and a path give."""
    return F.aggregate(path, leaf, lambda node, p: hashed(p["left"], node, p["right"]))


def digest(docs: DataFrame) -> DataFrame:
    """The manifest with a check of every proof against the rows as found
    later: where 2 divides the CRC-32 of the id, the text lost its newlines."""
    lost = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0,
                  leaf_of([F.replace(F.col(c), F.lit("\n"), F.lit("")) if c == "text" else F.col(c) for c in FIELDS]))
    found = manifest(docs, extra={"lost": lost})
    checked = found.withColumn("folded_root", folded(F.coalesce("lost", "leaf"), F.col("path")))
    return checked.select("doc_id", "leaf", "subroot", "root", F.sha2(proof_text(F.col("path")), 256).alias("proof_sha256"),
                          "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def oracle_sql() -> str:
    """The digest as DuckDB SQL, level by level."""
    def leaf(text: str) -> str:
        parts = ", ".join(f"coalesce(strlen({c}::varchar)::varchar || ':' || {c}::varchar, '-')" for c in
                          ("doc_id", "source", "lang", "n_chars", text))
        return f"sha256(concat({parts}))"

    crc = ("xor(list_reduce(list_concat([4294967295], list_transform(range(1, strlen(doc_id::varchar) + 1), "
           "lambda i: ascii(substr(doc_id::varchar, i::integer, 1))::bigint)), lambda c, b: list_reduce("
           "[xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)")
    return f"""
    WITH RECURSIVE leaves AS (
        SELECT doc_id, source, {leaf('text')} AS leaf,
               CASE WHEN doc_id IS NOT NULL AND {crc} % 2 = 0 THEN {leaf("replace(text, chr(10), '')")} ELSE {leaf('text')} END AS now FROM documents),
    r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r,
                 count(*) OVER (PARTITION BY source) AS n FROM leaves),
    up(source, lvl, pos, n, h) AS (
        SELECT source, 0, r, n, leaf FROM r
        UNION ALL
        SELECT source, lvl + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM up WHERE n > 1
        GROUP BY source, lvl, pos // 3, n),
    sub AS (SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS s, count(*) OVER () AS n FROM up WHERE n = 1),
    top(lvl, pos, n, h) AS (
        SELECT 0, s, n, subroot FROM sub
        UNION ALL
        SELECT lvl + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY lvl, pos // 3, n),
    steps AS (
        SELECT r.source, r.r, up.lvl, up.pos, up.h, up.pos = r.r // (3 ** up.lvl)::bigint AS own
        FROM r JOIN up ON up.source IS NOT DISTINCT FROM r.source AND up.n > 1 AND up.pos // 3 = r.r // (3 ** (up.lvl + 1))::bigint
        UNION ALL
        SELECT r.source, r.r, 1000 + top.lvl, top.pos, top.h, top.pos = sub.s // (3 ** top.lvl)::bigint
        FROM r JOIN sub ON sub.source IS NOT DISTINCT FROM r.source
        JOIN top ON top.n > 1 AND top.pos // 3 = sub.s // (3 ** (top.lvl + 1))::bigint),
    sides AS (
        SELECT source, r, lvl, coalesce(string_agg(h, '' ORDER BY pos) FILTER (WHERE pos < mine), '') AS l,
               coalesce(string_agg(h, '' ORDER BY pos) FILTER (WHERE pos > mine), '') AS rt,
               row_number() OVER (PARTITION BY source, r ORDER BY lvl) AS k
        FROM (SELECT *, max(pos) FILTER (WHERE own) OVER (PARTITION BY source, r, lvl) AS mine FROM steps) GROUP BY source, r, lvl),
    proofs AS (SELECT source, r, sha256(string_agg(l || rt, '' ORDER BY lvl)) AS proof FROM sides GROUP BY source, r),
    fold(source, r, k, h) AS (
        SELECT source, r, 0::bigint, now FROM r
        UNION ALL
        SELECT f.source, f.r, f.k + 1, sha256(s.l || f.h || s.rt) FROM fold f
        JOIN sides s ON s.source IS NOT DISTINCT FROM f.source AND s.r = f.r AND s.k = f.k + 1),
    ends AS (SELECT source, r, arg_max(h, k) AS folded_root FROM fold GROUP BY source, r)
    SELECT r.doc_id, r.leaf, sub.subroot, t.h AS root, coalesce(p.proof, sha256('')) AS proof_sha256, e.folded_root,
           e.folded_root = t.h AS verified
    FROM r JOIN sub ON sub.source IS NOT DISTINCT FROM r.source CROSS JOIN (SELECT h FROM top WHERE n = 1) t
    JOIN ends e ON e.source IS NOT DISTINCT FROM r.source AND e.r = r.r
    LEFT JOIN proofs p ON p.source IS NOT DISTINCT FROM r.source AND p.r = r.r
    """
