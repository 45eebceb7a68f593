"""Mixing sources to target weights by min-cost flow.

A document belongs to one or more sources.  Documents with the same set of
sources form a pattern; only the patterns and their word totals reach the
driver.  There a min-cost flow routes words from patterns to the quotas of
their sources: a pattern's first pass over its words costs nothing, a second
pass 1 and a third 2 for each word, so nothing is repeated while a quota can be
met without it, and no document is taken more than ``MAX_PASSES`` times.

A pattern's share is turned into whole passes and a rest.  The rest is filled
by documents in a seeded order: word totals by order bucket find the bucket in
which the rest ends, documents before it are taken, and only that bucket is
walked document by document.  Where the document at the edge does not fit, those
larger than the gap are set aside and the filling goes on with the others, until
no document that is left fits.  A round takes the largest one that fits if that is
more than half of the gap, else as many as fit in the seeded order, so it halves
the gap at least and the rounds are few whatever the sizes.  At the end one
document more is taken where that ends nearer to the share.

Quotas: sources in code-point order, null last, weigh 1, 2, 3, repeating, and
share all words by weight; a quota stops at ``MAX_PASSES`` times its source's
words and the excess goes to the others by weight.

A null text has no words; such a document, like an empty one, is taken for 0
words.  The place in the order is a hash of id and text, of repeated rows also
of their number, so every row is a document of its own.  A null source is a
source; a null id sorts by its hash like any other.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from widestat.llm.common import WORD, materialized, text_of

MAX_PASSES = 3
SEED = 7
BUCKET_BITS = 14
LEAST_LONG, LAST_LONG = -(1 << 63), (1 << 63) - 1
#: More distinct source sets than this are refused: they no longer fit the driver.
MAX_PATTERNS = 200_000


def quotas(sizes: dict[str | None, int], weights=(1, 2, 3), passes: int = MAX_PASSES) -> dict[str | None, float]:
    """Target words by source."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_to, target = float(sum(sizes.values())), set(order), {}
    while open_to:
        unit = left / sum(weight[s] for s in open_to)
        full = {s for s in open_to if weight[s] * unit > passes * sizes[s]}
        for s in full or open_to:
            target[s] = float(passes * sizes[s]) if full else weight[s] * unit
        if not full:
            break
        left -= sum(target[s] for s in full)
        open_to -= full
    return target


def route(capacity: dict, members: dict, quota: dict, passes: int = MAX_PASSES) -> dict:
    """Min-cost max-flow: {pattern: {source: words}}.  ``capacity`` words by
    pattern, ``members`` its sources, ``quota`` whole words by source.
    Successive shortest paths with potentials."""
    nodes: dict = {}
    graph: list[list[int]] = []
    arcs: list[list] = []  # to, capacity left, cost

    def node(key) -> int:
        if key not in nodes:
            nodes[key] = len(graph)
            graph.append([])
        return nodes[key]

    def arc(a, b, room: int, cost: int) -> int:
        for start, end, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            graph[start].append(len(arcs))
            arcs.append([end, r, c])
        return len(arcs) - 2

    begin, end, used = node("begin"), node("end"), {}
    for p in sorted(capacity):
        for cost in range(passes):
            arc(begin, node(("p", p)), capacity[p], cost)
        for s in members[p]:
            used[p, s] = arc(node(("p", p)), node(("s", s)), passes * capacity[p], 0)
    for s in quota:
        arc(node(("s", s)), end, quota[s], 0)
    potential = [0] * len(graph)
    while True:
        distance, by, heap = [None] * len(graph), [-1] * len(graph), [(0, begin)]
        distance[begin] = 0
        while heap:
            d, v = heapq.heappop(heap)
            if d > distance[v]:
                continue
            for a in graph[v]:
                to, room, cost = arcs[a]
                new = d + cost + potential[v] - potential[to]
                if room > 0 and (distance[to] is None or new < distance[to]):
                    distance[to], by[to] = new, a
                    heapq.heappush(heap, (new, to))
        if distance[end] is None:
            break
        potential = [p + (d if d is not None else distance[end]) for p, d in zip(potential, distance)]
        path, v = [], end
        while v != begin:
            path.append(by[v])
            v = arcs[by[v] ^ 1][0]
        push = min(arcs[a][1] for a in path)
        for a in path:
            arcs[a][1] -= push
            arcs[a ^ 1][1] += push
    out: dict = {p: {} for p in capacity}
    for (p, s), a in used.items():
        out[p][s] = arcs[a ^ 1][1]
    return out


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def placed_apart(slim: DataFrame) -> DataFrame:
    """Rows of a pattern that share a place are numbered and, but for the first,
    placed by their number too.  Numbers are counted within the parts that
    wrote the rows, so no task holds all repeats of a row."""
    repeats = slim.groupBy("pattern", "place").agg(F.count("*").alias("n")).where("n > 1").select("pattern", "place")
    again = materialized(slim.join(repeats, ["pattern", "place"]).select(
        "pattern", "place", "id", "size", "row", F.shiftright("row", 33).alias("part")), "mix-repeats")
    if again.isEmpty():
        return slim.drop("row")
    parts = again.groupBy("pattern", "place", "part").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(
        Window.partitionBy("pattern", "place").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    numbered = again.withColumn("nth", F.row_number().over(
        Window.partitionBy("pattern", "place", "part").orderBy("id", "size", "row"))).join(parts, ["pattern", "place", "part"])
    apart = numbered.withColumn("nth", F.col("nth") + F.col("before")).where("nth > 1").select(
        "row", F.xxhash64("place", "nth").alias("apart"))
    return materialized(slim.join(apart, "row", "left").withColumn("place", F.coalesce("apart", "place"))
                        .select("id", "sources", "pattern", "size", "place"), "mix-apart")


def mix(docs: DataFrame, sources: Column, weights=(1, 2, 3), seed: int = SEED, id_col: str = "doc_id",
        text_col: str = "text") -> tuple[DataFrame, list[tuple]]:
    """``sources``: an array column, the sources of a document.

    Returns (doc_id, sources, size, passes, taken), one row for each input row,
    and the report: (source, size, target, routed) of each source; the words of
    a document in several sources count for each in ``size``."""
    spark = docs.sparkSession
    members = F.array_sort(F.array_distinct(sources))
    slim = materialized(docs.select(
        F.col(id_col).alias("id"), members.alias("sources"), F.to_json(members).alias("pattern"),
        word_count(text_of(text_col)).alias("size"), F.xxhash64(F.lit(seed), F.col(id_col), text_of(text_col)).alias("place"),
        F.monotonically_increasing_id().alias("row")), "mix")
    slim = placed_apart(slim)
    totals = (slim.groupBy("pattern").agg(F.sum("size").alias("size"), F.first("sources").alias("sources"))
              .limit(MAX_PATTERNS + 1).collect())
    if len(totals) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} distinct source sets")
    belongs = {r["pattern"]: list(r["sources"]) for r in totals}
    capacity = {r["pattern"]: r["size"] for r in totals}
    sizes: dict = {}
    for p, ss in belongs.items():
        for s in ss:
            sizes[s] = sizes.get(s, 0) + capacity[p]
    target = quotas(sizes, weights)
    flow = route(capacity, belongs, {s: round(t) for s, t in target.items()})
    want = {p: sum(x.values()) for p, x in flow.items()}
    shares = [(p, want[p] // c if c else 0, want[p] % c if c else 0) for p, c in capacity.items()]

    def by_pattern(rows: list[tuple], schema: str) -> DataFrame:
        return F.broadcast(spark.createDataFrame(rows, schema))  # a few rows a pattern, MAX_PATTERNS at most

    plan = by_pattern(shares, "pattern string, passes long, rest long")

    rest = {p: r for p, _, r in shares}
    chosen = slim.join(plan, "pattern").select("id", "sources", "pattern", "size", "place", "passes", F.col("place").bitwiseXOR(F.lit(LEAST_LONG)).alias("turn"))
    # What is taken beyond the whole passes: of a pattern, documents of at most
    # ``room`` words up to ``turn`` in the order.  A few rows a pattern, one a round.
    rounds: list[tuple] = []

    def taken_by(rows: list[tuple]) -> DataFrame:
        return by_pattern(rows, "pattern string, upto_size long, upto_turn long")

    def untaken(df: DataFrame) -> DataFrame:
        if not rounds:
            return df
        limit = taken_by(rounds).withColumnRenamed("pattern", "of")
        return df.join(limit, (F.col("pattern") == F.col("of")) & (F.col("size") <= F.col("upto_size")) & (F.col("turn") <= F.col("upto_turn")), "left_anti")

    def fill(room: list[tuple]) -> None:
        """Take what fits in the seeded order; ``room``: (pattern, words left, largest size)."""
        open_to = untaken(chosen.where("size > 0")).join(by_pattern(room, "pattern string, room long, largest long"), "pattern").where("size <= largest")
        bucket = F.shiftright("turn", 64 - BUCKET_BITS)
        upto = Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        totals = (open_to.groupBy("pattern", "room", "largest", bucket.alias("bucket")).agg(F.sum("size").alias("words"), F.max("turn").alias("last"))
                  .withColumn("through", F.sum("words").over(upto)))
        # The buckets that fit whole, and the one in which the room ends.
        found = totals.groupBy("pattern", "room", "largest").agg(
            F.max(F.when(F.col("through") <= F.col("room"), F.struct("through", "last"))).alias("whole"),
            F.min(F.when(F.col("through") > F.col("room"), F.struct("bucket", (F.col("through") - F.col("words")).alias("before")))).alias("edge")).collect()
        ends = {r["pattern"]: (r["largest"], r["whole"]["last"] if r["whole"] else None, r["whole"]["through"] if r["whole"] else 0) for r in found}
        edges = [(r["pattern"], r["edge"]["bucket"], r["room"] - r["edge"]["before"]) for r in found if r["edge"]]
        if edges:
            inside = open_to.join(by_pattern(edges, "pattern string, bucket long, gap long"), "pattern").where(bucket == F.col("bucket"))
            run = inside.withColumn("run", F.sum("size").over(
                Window.partitionBy("pattern").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)))
            for r in run.where("run <= gap").groupBy("pattern").agg(F.max("turn").alias("turn"), F.max("run").alias("run"), F.max("room").alias("room"),
                                                                     F.max("gap").alias("gap")).collect():
                ends[r["pattern"]] = (ends[r["pattern"]][0], r["turn"], r["room"] - r["gap"] + r["run"])
        for p, (largest, turn, words) in ends.items():
            if turn is not None:
                rounds.append((p, largest, turn))
                rest[p] -= words

    added: list[tuple] = []
    while room := [(p, r) for p, r in rest.items() if r > 0]:
        fits = untaken(chosen.where("size > 0")).join(by_pattern(room, "pattern string, room long"), "pattern").where("size <= room")
        if added:
            fits = fits.join(by_pattern(added, "pattern string, place long"), ["pattern", "place"], "left_anti")
        best = fits.groupBy("pattern").agg(F.max(F.struct("size", "place")).alias("best"), F.max("room").alias("room")).collect()
        if not best:
            break
        many = []
        for r in best:
            if 2 * r["best"]["size"] > r["room"]:
                added.append((r["pattern"], r["best"]["place"]))
                rest[r["pattern"]] -= r["best"]["size"]
            else:
                many.append((r["pattern"], r["room"], r["best"]["size"]))
        if many:
            fill(many)
    over = [(p, r) for p, r in rest.items() if r > 0]
    if over:  # one document more where that ends nearer to the share
        near = (untaken(chosen).join(by_pattern(over, "pattern string, room long"), "pattern")
                .where("size > room and size < 2 * room"))
        if added:
            near = near.join(by_pattern(added, "pattern string, place long"), ["pattern", "place"], "left_anti")
        for r in near.groupBy("pattern").agg(F.min(F.struct("size", "place")).alias("best")).collect():
            added.append((r["pattern"], r["best"]["place"]))
    # A document without words is taken for none.
    limits = by_pattern([(p, [(x[1], x[2]) for x in rounds if x[0] == p], [x[1] for x in added if x[0] == p]) for p in rest],
                        "pattern string, limits array<struct<size:long,turn:long>>, more array<long>")
    extra = F.exists("limits", lambda x: (F.col("size") <= x["size"]) & (F.col("turn") <= x["turn"])) | F.array_contains("more", F.col("place"))
    result = (chosen.join(limits, "pattern").withColumn("passes", F.col("passes") + extra.cast("long"))
              .select(F.col("id").alias(id_col), "sources", "size", "passes", (F.col("size") * F.col("passes")).alias("taken")))
    routed: dict = {}
    for x in flow.values():
        for s, n in x.items():
            routed[s] = routed.get(s, 0) + n
    return result, [(s, sizes[s], target[s], routed.get(s, 0)) for s in sizes]


def digest(docs: DataFrame, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document with its only source's size and target."""
    mixed, report = mix(docs, F.array(source_col), id_col=id_col, text_col=text_col)
    by_source = docs.sparkSession.createDataFrame([r[:3] for r in report], "source string, source_size long, target double")
    return (mixed.join(F.broadcast(by_source), mixed["sources"][0].eqNullSafe(by_source["source"]))
            .select(id_col, "size", "source_size", "target", "taken"))
