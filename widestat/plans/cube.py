"""Wide statistical tables derived from the driver's order tables.

The notebooks' inputs (wide TSVs of flagged strings, XML code lists) are not
shipped, so same-shaped inputs are built from ``orders``/``customer``/
``nation``/``region``; their size grows with the order tables.

Role map: ``o_orderstatus`` = attainment, ``c_mktsegment`` = citizenship,
``o_orderpriority`` = age band, ``c_nationkey`` = country (via ``nation``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed parameters of the order-table analog.
YEARS = tuple(range(1995, 2002))
EDU_KEY_NAMES = ("Education_Attainment", "Citizen", "Age", "Country")
CITIZEN_TOTAL = "BUILDING"
ATTAINMENT_VALUES = ("F", "O", "P")
STRATA = {
    "global": ("3-MEDIUM",),
    "young": ("1-URGENT", "2-HIGH"),
    "middle": ("4-NOT SPECIFIED",),
    "old": ("5-LOW",),
}
BIRTHS_INDICATOR = "NORD"
LINE_KEY_NAMES = ("Flag", "Status", "Country")
FLAG_VALUES = ("A", "N", "R")
LINE_STRATA = {"finished": ("F",), "open": ("O",)}
GEO_LIST = "GEO"
REGION_LIST = "REGION"
CUSTOMER_LIST = "CUSTOMER"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The driver table ``name``."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def listed_year(day: str) -> F.Column:
    """The year of a date; a year without a column is an error, not a loss."""
    y = F.year(day)
    message = F.concat(F.lit(f"{day} lies outside {YEARS[0]} to {YEARS[-1]}: year "), F.coalesce(y.cast("string"), F.lit("null")))
    return F.when(y.between(YEARS[0], YEARS[-1]), y).otherwise(F.raise_error(message).cast("int"))


def order_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders per (status, segment, priority, nation, year).

    Join first: the orders are shuffled once by customer, or not at all while
    the customers fit a broadcast, and the count after it folds per task, so
    its own exchange holds a few rows per task and key.  A customer with very
    many orders is cut by the adaptive skew join.
    """
    orders = table(spark, sf_dir, "orders").select(
        "o_custkey", "o_orderstatus", "o_orderpriority", listed_year("o_orderdate").alias("y"))
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    return (orders.join(customer, orders["o_custkey"] == customer["c_custkey"])
            .groupBy("o_orderstatus", "c_mktsegment", "o_orderpriority", "c_nationkey", "y")
            .agg(F.count(F.lit(1)).alias("n")))


def _flagged(count_col: str, flag: str, every: int) -> F.Column:
    """Count -> published cell: the number, plus `` <flag>`` when
    ``n % every == 1`` (odd counts for every=2); ``:`` when missing."""
    n = count_col
    return F.expr(f"coalesce(concat(CAST({n} AS STRING), "
                  f"CASE WHEN {n} % {every} = 1 THEN ' {flag}' ELSE '' END), ':')")


def _year_sums(inner: str = "n", as_type: str | None = None) -> list[F.Column]:
    sums = [f"sum(CASE WHEN y = {y} THEN {inner} END)" for y in YEARS]
    if as_type:
        sums = [f"CAST({e} AS {as_type})" for e in sums]
    return [F.expr(e).alias(f"n{y}") for e, y in zip(sums, YEARS)]


def _year_cells(counts: DataFrame, keys: list[F.Column], flag: str, every: int) -> DataFrame:
    sums = counts.groupBy(*keys).agg(*_year_sums())
    return sums.select("key", *[_flagged(f"n{y}", flag, every).alias(str(y)) for y in YEARS])


def orders_wide(spark: SparkSession, sf_dir: str, counts: DataFrame | None = None) -> DataFrame:
    """``W``: key ``status,segment,priority,nationkey`` and one flagged text
    cell per year (``12 b`` for odd counts, ``:`` for no orders).

    Pass ``counts`` (from ``order_counts``) to share one scan, count and join
    with ``births_wide`` in the same plan."""
    counts = order_counts(spark, sf_dir) if counts is None else counts
    key = F.concat_ws(",", "o_orderstatus", "c_mktsegment", "o_orderpriority",
                      F.col("c_nationkey").cast("string")).alias("key")
    return _year_cells(counts, [key], "b", 2)


def births_wide(spark: SparkSession, sf_dir: str, counts: DataFrame | None = None) -> DataFrame:
    """Births-shaped table: key ``NORD,<nationkey>`` per nation plus a bare
    ``NORD`` total row and the same total under a null key (both of which the
    births flow drops), cells flagged `` p`` when the count is 1 mod 3."""
    counts = order_counts(spark, sf_dir) if counts is None else counts
    per_nation = counts.groupBy(
        F.concat(F.lit(BIRTHS_INDICATOR + ","), F.col("c_nationkey").cast("string")).alias("key")
    ).agg(*_year_sums())
    total = per_nation.agg(*[F.expr(f"sum(n{y})").alias(f"n{y}") for y in YEARS]).select(
        F.lit(BIRTHS_INDICATOR).alias("key"), *[f"n{y}" for y in YEARS])
    both = per_nation.unionByName(total).unionByName(total.withColumn("key", F.lit(None).cast("string")))
    return both.select("key", *[_flagged(f"n{y}", "p", 3).alias(str(y)) for y in YEARS])


def dirty_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``W`` with cells as they should not be, by the count modulo six: several
    dots, a flag, two numbers, no digit, no text at all, a plain number; ``:``
    where there are no orders."""
    def cell(n: str) -> F.Column:
        return F.expr(f"""CASE WHEN {n} IS NULL THEN ':' WHEN {n} % 6 = 0 THEN concat_ws('.', {n}, {n}, {n}) WHEN {n} % 6 = 1 THEN concat({n}, ' b')
            WHEN {n} % 6 = 2 THEN concat({n}, ' ', {n}) WHEN {n} % 6 = 3 THEN 'n/a' WHEN {n} % 6 = 4 THEN NULL ELSE CAST({n} AS STRING) END""")

    key = F.concat_ws(",", "o_orderstatus", "c_mktsegment", "o_orderpriority", F.col("c_nationkey").cast("string")).alias("key")
    sums = order_counts(spark, sf_dir).groupBy(key).agg(*_year_sums())
    return sums.select("key", *[cell(f"n{y}").alias(str(y)) for y in YEARS])


def nation_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code table ``(code_list, code, lang, description, code_pos)``: nations
    as list ``GEO`` then regions as list ``REGION`` — codes 0-4 exist in both.
    ``code_pos`` orders lists then codes, so a flattened lookup is
    deterministic (the later list wins, as in the notebooks)."""
    def pos(list_pos: int, key: str) -> F.Column:
        return F.struct(F.lit(list_pos).cast("bigint").alias("list_pos"),
                        F.col(key).cast("bigint").alias("pos"))

    nation = table(spark, sf_dir, "nation").select(
        F.lit(GEO_LIST).alias("code_list"), F.col("n_nationkey").cast("string").alias("code"),
        F.lit("en").alias("lang"), F.col("n_name").alias("description"),
        pos(0, "n_nationkey").alias("code_pos"))
    region = table(spark, sf_dir, "region").select(
        F.lit(REGION_LIST).alias("code_list"), F.col("r_regionkey").cast("string").alias("code"),
        F.lit("en").alias("lang"), F.col("r_name").alias("description"),
        pos(1, "r_regionkey").alias("code_pos"))
    return nation.unionByName(region)


def code_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows for XML code lists: customers (``CUSTOMER``), nations (``GEO``)
    and regions (``REGION``), with English and French descriptions; German
    only for nations."""
    def d(lang: str, text: F.Column) -> F.Column:
        return F.struct(F.lit(lang).alias("lang"), text.alias("text"))

    customer = table(spark, sf_dir, "customer").select(
        F.lit(CUSTOMER_LIST).alias("code_list"), F.col("c_custkey").cast("string").alias("code"),
        F.array(d("en", F.col("c_name")), d("fr", F.lower("c_name"))).alias("descriptions"))
    nation = table(spark, sf_dir, "nation").select(
        F.lit(GEO_LIST).alias("code_list"), F.col("n_nationkey").cast("string").alias("code"),
        F.array(d("en", F.col("n_name")), d("fr", F.lower("n_name")), d("de", F.concat(F.lit("de:"), F.col("n_name"))))
        .alias("descriptions"))
    region = table(spark, sf_dir, "region").select(
        F.lit(REGION_LIST).alias("code_list"), F.col("r_regionkey").cast("string").alias("code"),
        F.array(d("en", F.col("r_name")), d("fr", F.lower("r_name"))).alias("descriptions"))
    return customer.unionByName(nation).unionByName(region)


def structure_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code rows for structure files of unequal sizes, several lists each:
    customers in lists of a thousand, then nations, then regions.  Codes 0-4
    stand in all three, so a flattened lookup takes the region."""
    def d(lang: str, text: F.Column) -> F.Column:
        return F.struct(F.lit(lang).alias("lang"), text.alias("text"))

    def rows(name: str, key: str, text: str, file: F.Column, code_list: F.Column) -> DataFrame:
        return table(spark, sf_dir, name).select(
            file.alias("file"), code_list.alias("code_list"), F.col(key).cast("string").alias("code"),
            F.col(key).cast("bigint").alias("code_pos"),
            F.array(d("en", F.col(text)), d("fr", F.lower(text))).alias("descriptions"))

    thousand = F.floor(F.col("c_custkey") / 1000)
    return (rows("customer", "c_custkey", "c_name", F.concat(F.lit("a-customer-"), F.lpad(F.floor(thousand / 100).cast("string"), 6, "0")),
                 F.concat(F.lit("CUSTOMER_"), F.lpad(thousand.cast("string"), 9, "0")))
            .unionByName(rows("nation", "n_nationkey", "n_name", F.lit("b-geo"), F.lit(GEO_LIST)))
            .unionByName(rows("region", "r_regionkey", "r_name", F.lit("c-region"), F.lit(REGION_LIST))))


def one_list_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code rows for one structure file: a list of all customers, with the
    nations and regions as lists after it."""
    rows = structure_rows(spark, sf_dir)
    listed = F.when(F.col("file").startswith("a-customer"), F.lit("A_CUSTOMER")).otherwise(F.col("code_list"))
    return rows.withColumn("code_list", listed).withColumn("file", F.lit("lists"))


# Descriptions of the order table's own codes, for the flow from files.
STATUS_TEXT = {"F": "Finished", "O": "Open", "P": "Pending"}
PRIORITY_TEXT = {"1-URGENT": "From 18 to 24 years", "2-HIGH": "From 25 to 34 years", "3-MEDIUM": "From 18 to 74 years",
                 "4-NOT SPECIFIED": "From 25 to 54 years", "5-LOW": "From 55 to 74 years"}
SEGMENT_TEXT = {CITIZEN_TOTAL: "Total"}


def education_structure_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structure files for the four-part order key, two files: the nations in
    one, statuses, priorities and segments in the other.  Codes and texts come
    from the tables; only the wording of the fixed codes is declared."""
    def d(text: F.Column) -> F.Column:
        return F.array(F.struct(F.lit("en").alias("lang"), text.alias("text")))

    def worded(name: str, col: str, code_list: str, texts: dict[str, str]) -> DataFrame:
        text = F.col(col)
        for code, words in texts.items():
            text = F.when(F.col(col) == code, F.lit(words)).otherwise(text)
        return (table(spark, sf_dir, name).select(F.col(col)).distinct()
                .select(F.lit("b-dimensions").alias("file"), F.lit(code_list).alias("code_list"), F.col(col).alias("code"),
                        F.lit(0).cast("bigint").alias("code_pos"), d(text).alias("descriptions")))

    nation = table(spark, sf_dir, "nation").select(
        F.lit("a-geo").alias("file"), F.lit(GEO_LIST).alias("code_list"), F.col("n_nationkey").cast("string").alias("code"),
        F.col("n_nationkey").cast("bigint").alias("code_pos"), d(F.col("n_name")).alias("descriptions"))
    return (nation.unionByName(worded("orders", "o_orderstatus", "STATUS", STATUS_TEXT))
            .unionByName(worded("orders", "o_orderpriority", "PRIORITY", PRIORITY_TEXT))
            .unionByName(worded("customer", "c_mktsegment", "SEGMENT", SEGMENT_TEXT)))


def price_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One money cell per order, written like a published decimal cell:
    ``112946.26`` plain, `` e`` flagged for finished orders, a trailing dot
    for low priority, and ``: p`` (missing) for pending orders.  Built from
    integer cents so the text does not depend on float formatting."""
    orders = table(spark, sf_dir, "orders")
    return orders.selectExpr(
        "o_orderkey",
        "o_orderstatus",
        "o_orderpriority",
        "CAST(round(o_totalprice * 100) AS BIGINT) AS cents",
    ).selectExpr(
        "o_orderkey",
        """CASE WHEN o_orderstatus = 'P' THEN ': p'
                WHEN o_orderpriority = '5-LOW' THEN money || '.'
                WHEN o_orderstatus = 'F' THEN money || ' e'
                ELSE money END AS cell""".replace(
            "money", "(CAST(cents DIV 100 AS STRING) || '.' || lpad(CAST(cents % 100 AS STRING), 2, '0'))"),
    )


def customer_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One prefixed key per customer: ``NORD,<nationkey>``; automobile
    customers carry another indicator (``XORD,..``, not translated) and
    machinery customers the bare indicator."""
    nk = F.col("c_nationkey").cast("string")
    key = (F.when(F.col("c_mktsegment") == "AUTOMOBILE", F.concat(F.lit("XORD,"), nk))
           .when(F.col("c_mktsegment") == "MACHINERY", F.lit(BIRTHS_INDICATOR))
           .otherwise(F.concat(F.lit(BIRTHS_INDICATOR + ","), nk)))
    return table(spark, sf_dir, "customer").select("c_custkey", key.alias("key"))


def customer_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code table for list ``CUSTOMER`` (customer key -> name): a dictionary
    that grows with the data, so it is broadcast only while it is small."""
    return table(spark, sf_dir, "customer").select(
        F.lit(CUSTOMER_LIST).alias("code_list"), F.col("c_custkey").cast("string").alias("code"),
        F.lit("en").alias("lang"), F.col("c_name").alias("description"),
        F.struct(F.lit(0).cast("bigint").alias("list_pos"), F.col("c_custkey").alias("pos")).alias("code_pos"))


def lineitem_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A larger wide table: shipped quantity per ``returnflag,linestatus,
    supplier nation`` and ship year, as flagged text (`` e`` when odd).

    Quantities are summed per (supplier, flag, status, year) before the
    supplier join — hundreds of line items per supplier fold into a few dozen
    rows per task — and the supplier table is broadcast only while small.
    """
    lines = table(spark, sf_dir, "lineitem").select(
        "l_suppkey", "l_returnflag", "l_linestatus", "l_quantity", listed_year("l_shipdate").alias("y"))
    summed = (lines.groupBy("l_suppkey", "l_returnflag", "l_linestatus", "y")
              .agg(F.sum("l_quantity").alias("q")))
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    joined = summed.join(supplier, summed["l_suppkey"] == supplier["s_suppkey"], "inner")
    key = F.concat_ws(",", "l_returnflag", "l_linestatus", F.col("s_nationkey").cast("string")).alias("key")
    sums = joined.groupBy(key).agg(*_year_sums("q", "BIGINT"))
    return sums.select("key", *[_flagged(f"n{y}", "e", 2).alias(str(y)) for y in YEARS])
