"""Code lists (SDMX-style XML): ``Code`` elements with a ``value`` attribute and
one ``Description`` child per language, grouped in ``CodeList`` elements.

Read with Spark's XML source, so a set of structure files is split across
tasks; nothing is parsed on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from widestat.session import scratch_path

CODES_COLUMNS = ["code_list", "code", "lang", "description", "code_pos"]

_DESCRIPTIONS = T.ArrayType(T.StructType([
    T.StructField("_VALUE", T.StringType()),
    T.StructField("_lang", T.StringType()),
]))
_CODE = T.StructType([
    T.StructField("_value", T.StringType()),
    T.StructField("Description", _DESCRIPTIONS),
])
LIST_SCHEMA = T.StructType([
    T.StructField("_id", T.StringType()),
    T.StructField("Code", T.ArrayType(_CODE)),
])
CODE_ROW_SCHEMA = T.StructType([
    T.StructField("_value", T.StringType()),
    T.StructField("Description", _DESCRIPTIONS),
    T.StructField("code_list", T.StringType()),
])


def _pick_description(descriptions: Column, lang: str) -> Column:
    """The description in ``lang``; several are joined, none is null."""
    texts = F.transform(F.filter(descriptions, lambda d: d["_lang"] == F.lit(lang)),
                        lambda d: F.coalesce(d["_VALUE"], F.lit("")))
    return F.when(F.size(texts) > 0, F.array_join(texts, ""))


def _file_place() -> Column:
    """Where a row stands: file path, block, order within the block.  The file
    path decides first, so the sizes of the files and the tasks they are
    packed into do not matter."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                    F.monotonically_increasing_id().alias("row"))


def load_codes(spark: SparkSession, path: str, lang: str = "en", row_tag: str = "CodeList",
               missing: str = "keep") -> DataFrame:
    """Code list(s) -> ``(code_list, code, lang, description, code_pos)``.

    row_tag ``CodeList``: structure files as published, one row per list
        (``code_list`` = the list's ``id``).
    row_tag ``Code``: one row per code; ``code_list`` comes from a
        ``code_list=<id>`` folder level when there is one, else null.
    missing ``keep``: a code without a description in ``lang`` gets null (the
        translator then keeps the code); ``empty`` gives ``''`` (parity).
    ``code_pos`` orders codes by file path, place of the list in the file and
    place in the list, for last-wins parity.
    """
    if missing not in ("keep", "empty"):
        raise ValueError("missing must be 'keep' or 'empty'")
    reader = spark.read.format("xml").option("ignoreNamespace", True)
    if row_tag == "CodeList":
        lists = (reader.option("rowTag", "CodeList").schema(LIST_SCHEMA).load(path)
                 .select("_id", "Code", _file_place().alias("list_pos")))
        codes = lists.select(
            F.col("_id").alias("code_list"), "list_pos",
            F.posexplode("Code").alias("pos_in_list", "c"))
        codes = codes.select(
            "code_list",
            F.col("c._value").alias("code"),
            _pick_description(F.col("c.Description"), lang).alias("description"),
            F.struct(F.col("list_pos"), F.col("pos_in_list").cast("bigint").alias("pos")).alias("code_pos"))
    elif row_tag == "Code":
        rows = reader.option("rowTag", "Code").schema(CODE_ROW_SCHEMA).load(path)
        codes = rows.select(
            "code_list",
            F.col("_value").alias("code"),
            _pick_description(F.col("Description"), lang).alias("description"),
            F.struct(_file_place().alias("list_pos"), F.lit(0).cast("bigint").alias("pos")).alias("code_pos"))
    else:
        raise ValueError("row_tag must be 'CodeList' or 'Code'")
    if missing == "empty":
        codes = codes.withColumn("description", F.coalesce("description", F.lit("")))
    return codes.select("code_list", "code", F.lit(lang).alias("lang"), "description", "code_pos")


#: A tag up to its end, and the text after it; ``>`` may stand in attributes.
_TAG = r"""(?s)^(/?)(?:[^\s:>/]+:)?([^\s:>/]+)((?:[^>"']|"[^"]*"|'[^']*')*)>(.*)$"""


def _attribute(attributes: Column, name: str) -> Column:
    """An attribute's value, by its local name; null without it."""
    found = rf"""(?s)(?:^|[\s:]){name}\s*=\s*(?:"([^"]*)"|'([^']*)')"""
    value = F.concat(F.regexp_extract(attributes, found, 1), F.regexp_extract(attributes, found, 2))
    return F.when(attributes.rlike(found), _decoded(value))


def _decoded(text: Column) -> Column:
    """Entities and character references, read by Spark's XML functions."""
    return F.when(text.contains("&"), F.xpath_string(F.concat(F.lit("<a>"), text, F.lit("</a>")), F.lit("a"))).otherwise(text)


def load_code_tags(spark: SparkSession, path: str, lang: str = "en", missing: str = "keep") -> DataFrame:
    """``load_codes`` of structure files whose lists may be larger than a row.

    The files are read as one row a tag (text cut at ``<``), so a list is split
    over tasks like any text.  Every code and description is then given the
    last list and code that began before it: within a block of a file by a
    window over the block, across blocks by what the blocks before end with (a
    row a block).  The tags of interest are written once under the shared
    checkpoint folder, so both see the same places.

    Columns, order and modes are those of ``load_codes``.  CDATA sections, and
    comments that hold tags, are an error: read such files with ``load_codes``.
    """
    if missing not in ("keep", "empty"):
        raise ValueError("missing must be 'keep' or 'empty'")
    raw = spark.read.option("lineSep", "<").text(path).select("value", _file_place().alias("at"))
    odd = F.col("value").startswith("![CDATA[") | (F.col("value").startswith("!--") & ~F.col("value").contains("-->"))
    tag = F.when(odd, F.raise_error(F.lit("a CDATA section or a comment with tags: read this file with load_codes")).cast("string")).otherwise(F.col("value"))
    parts = raw.select("at", tag.alias("value")).select(
        "at", *[F.regexp_extract("value", _TAG, i).alias(n) for i, n in ((1, "close"), (2, "name"), (3, "attributes"), (4, "text"))])
    attributes = F.col("attributes")
    opened = parts.where("close = ''").select(
        F.col("at.file").alias("file"), F.col("at.block").alias("block"), F.col("at.row").alias("row"),
        F.when(F.col("name") == "CodeList", F.struct(_attribute(attributes, "id").alias("id"))).alias("list"),
        F.when(F.col("name") == "Code", F.struct(F.col("at").alias("at"), _attribute(attributes, "value").alias("value"))).alias("code"),
        F.when((F.col("name") == "Description") & (_attribute(attributes, "lang") == lang), _decoded(F.col("text"))).alias("text"))
    scratch = scratch_path(spark, "code-tags")
    opened.where("list is not null or code is not null or text is not null").write.parquet(scratch)
    tags = spark.read.parquet(scratch)

    in_file = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ends = tags.groupBy("file", "block").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("row"))).alias(c) for c in ("list", "code")])
    before = ends.select(F.col("file").alias("of"), F.col("block").alias("in"),
                         *[F.last(c, ignorenulls=True).over(in_file).alias(f"{c}_before") for c in ("list", "code")])
    in_block = Window.partitionBy("file", "block").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    carried = (tags.select("file", "block", "text", F.col("code").isNotNull().alias("begins"), "row",
                           *[F.last(c, ignorenulls=True).over(in_block).alias(c) for c in ("list", "code")])
               .join(before, (F.col("file") == F.col("of")) & (F.col("block") == F.col("in")))
               .select("block", "row", "text", "begins", F.coalesce("list", "list_before").alias("list"), F.coalesce("code", "code_before").alias("code"))
               .where("begins or (text is not null and code is not null)"))
    texts = F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("block", "row", "text"))))
    codes = carried.groupBy(F.col("code.at").alias("list_pos")).agg(
        F.max("list.id").alias("code_list"), F.max("code.value").alias("code"), texts.alias("texts"))
    described = F.when(F.size("texts") > 0, F.array_join(F.transform("texts", lambda t: t["text"]), ""))
    if missing == "empty":
        described = F.coalesce(described, F.lit(""))
    return codes.select("code_list", "code", F.lit(lang).alias("lang"), described.alias("description"),
                        F.struct("list_pos", F.lit(0).cast("bigint").alias("pos")).alias("code_pos"))


def flatten_codes(codes: DataFrame) -> DataFrame:
    """All lists merged into one code -> description map, last code in file
    order wins (the notebook's ``toMap`` behaviour).  Grouped on executors."""
    return (codes.groupBy("code")
            .agg(F.max_by(F.struct("description", "lang"), "code_pos").alias("d"),
                 F.max("code_pos").alias("code_pos"))
            .select(F.lit(None).cast("string").alias("code_list"), "code",
                    F.col("d.lang").alias("lang"), F.col("d.description").alias("description"),
                    "code_pos"))


def write_code_lists(codes: DataFrame, path: str, prefix: str = "structure") -> str:
    """Write ``(file, code_list, code, code_pos, descriptions)`` as structure
    files in the published form: one file for each value of ``file`` (a folder
    level ``file=..``), holding prefixed ``CodeList`` elements with their codes
    in ``code_pos`` order, the lists by name.  A list of any length is written line by line."""
    def tag(name: str) -> str:
        return f"{prefix}:{name}" if prefix else name

    def escape(c: Column) -> Column:
        for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            c = F.replace(c, F.lit(raw), F.lit(entity))
        return c

    described = F.array_join(F.transform("descriptions", lambda d: F.concat(
        F.lit(f'<{tag("Description")} xml:lang="'), d["lang"], F.lit('">'), escape(d["text"]), F.lit(f"</{tag('Description')}>"))), "")
    code = F.concat(F.lit(f'<{tag("Code")} value="'), escape(F.col("code")), F.lit('">'), described, F.lit(f"</{tag('Code')}>"))
    lists, files = codes.select("file", "code_list").distinct(), codes.select("file").distinct()

    def lines(of: DataFrame, part: int, place: int, line: Column) -> DataFrame:
        whole = "code_list" in of.columns
        return of.select("file", F.lit(part).alias("part"), (F.col("code_list") if whole else F.lit("")).alias("code_list"), F.lit(place).alias("place"),
                         (F.col("code_pos") if "code_pos" in of.columns else F.lit(None)).cast("long").alias("code_pos"), line.alias("value"))

    root = prefix or "x"
    rows = (lines(files, 0, 0, F.lit(f'<{root}s:Structure xmlns:{root}s="urn:message" xmlns:{root}="urn:structure">'))
            .unionByName(lines(lists, 1, 0, F.concat(F.lit(f'<{tag("CodeList")} id="'), F.col("code_list"), F.lit('">'))))
            .unionByName(lines(codes, 1, 1, code))
            .unionByName(lines(lists, 1, 2, F.lit(f"</{tag('CodeList')}>")))
            .unionByName(lines(files, 2, 0, F.lit(f"</{root}s:Structure>"))))
    # One task a file; every list and code is a line of its own, in order.
    (rows.repartition("file").sortWithinPartitions("file", "part", "code_list", "place", "code_pos", "value")
     .select("file", "value").write.mode("overwrite").partitionBy("file").text(path))
    return path


def write_code_rows(codes: DataFrame, path: str) -> str:
    """Write ``(code_list, code, descriptions array<struct<lang, text>>)`` as
    XML: one ``code_list=<id>`` folder per list, each file a ``CodeList``
    holding ``Code value=..`` elements with ``Description lang=..`` children.

    Spark's XML writer rejects prefixed names (``structure:Code``), so the
    files are unprefixed; ``load_codes`` reads both forms.
    """
    rows = codes.select(
        "code_list",
        F.col("code").alias("_value"),
        F.transform("descriptions", lambda d: F.struct(d["lang"].alias("_lang"),
                                                        d["text"].alias("_VALUE"))).alias("Description"))
    (rows.write.mode("overwrite").partitionBy("code_list").format("xml")
     .option("rootTag", "CodeList").option("rowTag", "Code").save(path))
    return path
