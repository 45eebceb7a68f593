"""DuckDB SQL that computes each registered query independently of Spark,
over the same parquet tables (registered as views under their names)."""

from __future__ import annotations

from widestat.operators.slices import SLICE_SOURCE
from widestat.plans import cube, etl
from widestat.plans.catalog import ORDER_SLICES, PART_LABEL_PAIRS, PART_TYPE_LABELS, POLL_YEARS

YEARS = cube.YEARS


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _cells(every: int, flag: str) -> str:
    return ",\n    ".join(
        f"""coalesce(max(CASE WHEN y = {y} THEN CAST(n AS VARCHAR) || """
        f"""CASE WHEN n % {every} = 1 THEN ' {flag}' ELSE '' END END), ':') AS "{y}\""""
        for y in YEARS)


def clean_int(cell: str, missing: str = "zero", kind: str = "INTEGER") -> str:
    if missing == "zero":
        return f"TRY_CAST(regexp_replace(regexp_replace({cell}, ':', '0', 'g'), '[^0-9]', '', 'g') AS {kind})"
    return (f"CASE WHEN contains({cell}, ':') THEN NULL ELSE "
            f"TRY_CAST(regexp_replace({cell}, '[^0-9]', '', 'g') AS {kind}) END")


def clean_double(cell: str) -> str:
    # RE2 has no look-ahead: drop other characters first, then dots that are
    # not followed by a digit (equal on cells without a letter right after a dot).
    inner = f"regexp_replace(regexp_replace({cell}, ':', '0', 'g'), '[^0-9\\s.]+', '', 'g')"
    return f"TRY_CAST(regexp_replace({inner}, '\\.(\\D|$)', '\\1', 'g') AS DOUBLE)"


W_CTE = f"""
cnt AS (
  SELECT o.o_orderstatus || ',' || c.c_mktsegment || ',' || o.o_orderpriority || ',' ||
         CAST(c.c_nationkey AS VARCHAR) AS key,
         CAST(year(o.o_orderdate) AS INTEGER) AS y, count(*) AS n
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  GROUP BY 1, 2),
W AS (
  SELECT key,
    {_cells(2, 'b')}
  FROM cnt GROUP BY key)"""

B_CTE = f"""
bcnt AS (
  SELECT c.c_nationkey AS nk, CAST(year(o.o_orderdate) AS INTEGER) AS y, count(*) AS n
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  GROUP BY 1, 2),
btot AS (SELECT y, sum(n) AS n FROM bcnt GROUP BY y),
B AS (
  SELECT 'NORD,' || CAST(nk AS VARCHAR) AS key,
    {_cells(3, 'p')}
  FROM bcnt GROUP BY nk
  UNION ALL
  SELECT unnest(['NORD', NULL]) AS key, btot_w.* FROM (SELECT
    {_cells(3, 'p')}
  FROM btot) btot_w)"""

YEAR_COLS = ", ".join(f'"{y}"' for y in YEARS)


def _unpivot(src: str, ids: str, value: str) -> str:
    return "\n  UNION ALL\n  ".join(
        f'SELECT {ids}, {y} AS "Year", "{y}" AS {value} FROM {src}' for y in YEARS)


NAT_CTE = f"""{B_CTE},
nat_w AS (
  SELECT coalesce(n.n_name, B.key) AS Country,
    {", ".join(f'{clean_int(chr(34) + str(y) + chr(34), kind="BIGINT")} AS "{y}"' for y in YEARS)}
  FROM B LEFT JOIN nation n ON B.key = 'NORD,' || CAST(n.n_nationkey AS VARCHAR)
  WHERE B.key <> 'NORD'),
nat AS (
  {_unpivot("nat_w", "Country", "Births")})"""

EDU_CTE = f"""{W_CTE},
edu_w AS (
  SELECT split_part(W.key, ',', 1) AS Education_Attainment,
         split_part(W.key, ',', 3) AS Age,
         coalesce(n.n_name, split_part(W.key, ',', 4)) AS Country,
    {", ".join(f'{clean_double(chr(34) + str(y) + chr(34))} AS "{y}"' for y in YEARS)}
  FROM W LEFT JOIN nation n ON CAST(n.n_nationkey AS VARCHAR) = split_part(W.key, ',', 4)
  WHERE split_part(W.key, ',', 2) = '{cube.CITIZEN_TOTAL}'),
edu AS (
  {_unpivot("edu_w", "Education_Attainment, Age, Country", "Proportion")})"""


def _ct(bands) -> str:
    sums = ", ".join(
        f"""sum(CASE WHEN Education_Attainment = '{v}' THEN Proportion END) AS "{v}\""""
        for v in cube.ATTAINMENT_VALUES)
    inlist = ", ".join(_q(b) for b in bands)
    return f"SELECT Country, \"Year\", {sums} FROM edu WHERE Age IN ({inlist}) GROUP BY Country, \"Year\""


def _joined_sql(stratum: str) -> str:
    return f"""WITH {NAT_CTE},
{EDU_CTE},
ct AS ({_ct(cube.STRATA[stratum])})
SELECT nat.Country, nat."Year", nat.Births, ct."F", ct."O", ct."P"
FROM nat JOIN ct ON nat.Country = ct.Country AND nat."Year" = ct."Year\""""


def _slice_sql() -> dict[str, str]:
    p = ORDER_SLICES
    tok = _q(p.token)
    base = f"WITH {NAT_CTE},\n{EDU_CTE},\nct AS ({_ct(cube.STRATA['global'])}),\n" \
           f"jn AS (SELECT nat.Country, nat.\"Year\", nat.Births, ct.\"F\", ct.\"O\", ct.\"P\" " \
           f"FROM nat JOIN ct ON nat.Country = ct.Country AND nat.\"Year\" = ct.\"Year\")\n"
    n1 = f"NOT contains(Country, {tok})"
    n2 = f"contains(Country, {tok}) AND \"Year\" <> {p.births_last_year}"
    n4 = f"contains(Country, {tok}) AND \"Year\" <> {p.education_first_year}"
    n5 = f"contains(Country, {tok}) AND \"Year\" > {p.joined_after}"
    where = {
        "n1": ("nat", n1),
        "n2": ("nat", n2),
        "n3": ("ct", f"NOT contains(Country, {tok})"),
        "n4": ("ct", n4),
        "n5": ("jn", n5),
        "n6": ("nat", f"{n2} AND Country = {_q(p.births_series)}"),
        "n7": ("ct", f"{n4} AND Country = {_q(p.education_wide)}"),
        "n8": ("ct", f"{n4} AND Country = {_q(p.education_core)}"),
        "n9": ("jn", f"{n5} AND Country = {_q(p.h1_series)}"),
        "n10": ("ct", f"{n4} AND Country <> {_q(p.h2_not_equal)} "
                      f"AND NOT contains(Country, {_q(p.h2_not_containing)})"),
        "n11": ("nat", f"{n2} AND (Country = {_q(p.h3_equal)} OR contains(Country, {_q(p.h3_containing)}))"),
        "n12": ("nat", f"{n1} AND \"Year\" > {p.h4_after}"),
        "n13": ("nat", f"{n1} AND Country = {_q(p.h4_country)}"),
    }
    return {f"slice_{k}": f"{base}SELECT * FROM {t} WHERE {w}" for k, (t, w) in where.items()}


def _window_sql(src: str, key: str, ts: str, measure: str, min_year: int) -> str:
    return f"""SELECT {key},
  time_bucket(INTERVAL 35 DAY, {ts}, TIMESTAMP '1970-01-01') AS window_start,
  time_bucket(INTERVAL 35 DAY, {ts}, TIMESTAMP '1970-01-01') + INTERVAL 35 DAY AS window_end,
  max({measure}) AS max_{measure}
FROM {src} WHERE year({ts}) > {min_year}
GROUP BY 1, 2, 3"""


LINE_SQL = f"""WITH lcnt AS (
  SELECT l.l_returnflag || ',' || l.l_linestatus || ',' || CAST(s.s_nationkey AS VARCHAR) AS key,
         CAST(year(l.l_shipdate) AS INTEGER) AS y, CAST(sum(l.l_quantity) AS BIGINT) AS n
  FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey
  GROUP BY 1, 2),
lwide AS (
  SELECT key,
    {_cells(2, 'e')}
  FROM lcnt GROUP BY key),
lnamed AS (
  SELECT split_part(lwide.key, ',', 1) AS Flag, split_part(lwide.key, ',', 2) AS Status,
         coalesce(n.n_name, split_part(lwide.key, ',', 3)) AS Country,
    {", ".join(f'{clean_double(chr(34) + str(y) + chr(34))} AS "{y}"' for y in YEARS)}
  FROM lwide LEFT JOIN nation n ON CAST(n.n_nationkey AS VARCHAR) = split_part(lwide.key, ',', 3)),
ll AS (
  {_unpivot("lnamed", "Flag, Status, Country", "Quantity")})
SELECT Country, "Year",
  {", ".join(f"sum(CASE WHEN Flag = '{v}' THEN Quantity END) AS " + chr(34) + v + chr(34) for v in cube.FLAG_VALUES)}
FROM ll WHERE Status IN ('F') GROUP BY 1, 2"""


def oracle_sql() -> dict[str, str]:
    split_cols = ("split_part(key, ',', 1) AS Education_Attainment, split_part(key, ',', 2) AS Citizen, "
                  "split_part(key, ',', 3) AS Age, split_part(key, ',', 4) AS Country")
    split_sql = f"WITH {W_CTE}\nSELECT {split_cols}, {YEAR_COLS} FROM W"
    shorten = "p_name || ' ' || p_type"
    for a, b in PART_LABEL_PAIRS:
        shorten = f"replace({shorten}, {_q(a)}, {_q(b)})"
    type_case = "CASE p_type " + " ".join(
        f"WHEN {_q(k)} THEN {_q(v)}" for k, v in PART_TYPE_LABELS.items()) + " ELSE p_type END"
    dims = ["Education_Attainment", "Citizen", "Age", "Country"]
    profile = "\nUNION ALL\n".join(
        f"SELECT '{d}' AS dimension, split_part(key, ',', {i + 1}) AS value, count(*) AS n FROM W GROUP BY 2"
        for i, d in enumerate(dims))
    money = "(CAST(cents // 100 AS VARCHAR) || '.' || lpad(CAST(cents % 100 AS VARCHAR), 2, '0'))"
    cells = f"""SELECT o_orderkey,
  CASE WHEN o_orderstatus = 'P' THEN ': p'
       WHEN o_orderpriority = '5-LOW' THEN {money} || '.'
       WHEN o_orderstatus = 'F' THEN {money} || ' e'
       ELSE {money} END AS cell
FROM (SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders)"""
    prefixed_key = ("CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN 'XORD,' || CAST(c_nationkey AS VARCHAR) "
                    "WHEN c_mktsegment = 'MACHINERY' THEN 'NORD' "
                    "ELSE 'NORD,' || CAST(c_nationkey AS VARCHAR) END")
    codelist = lambda lang: f"""
SELECT 'CUSTOMER' AS code_list, CAST(c_custkey AS VARCHAR) AS code, '{lang}' AS lang,
  {"c_name" if lang == "en" else "CAST(NULL AS VARCHAR)"} AS description FROM customer
UNION ALL
SELECT 'GEO', CAST(n_nationkey AS VARCHAR), '{lang}', {"n_name" if lang == "en" else "'de:' || n_name"} FROM nation
UNION ALL
SELECT 'REGION', CAST(r_regionkey AS VARCHAR), '{lang}',
  {"r_name" if lang == "en" else "CAST(NULL AS VARCHAR)"} FROM region"""
    out = {
        "wide_tsv_scan": f"WITH {W_CTE}\nSELECT * FROM W",
        "csv_roundtrip": "SELECT * FROM orders",
        "partitioned_feed_scan": """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate,
  o_orderpriority, CAST(year(o_orderdate) AS INTEGER) AS "Year"
FROM orders WHERE year(o_orderdate) > 1996""",
        "clean_int": f"WITH {W_CTE}\nSELECT key, "
                     + ", ".join(f'{clean_int(chr(34) + str(y) + chr(34))} AS "{y}"' for y in YEARS)
                     + " FROM W",
        "clean_double": f"SELECT o_orderkey, cell, {clean_double('cell')} AS value FROM ({cells})",
        "clean_double_null": f"SELECT o_orderkey, cell, CASE WHEN contains(cell, ':') THEN NULL "
                             f"ELSE {clean_double('cell')} END AS value FROM ({cells})",
        "split_key": split_sql,
        "split_key_pivot_form": split_sql,
        "translate_codes": f"""WITH {W_CTE}
SELECT split_part(key, ',', 1) AS Education_Attainment, split_part(key, ',', 2) AS Citizen,
  split_part(key, ',', 3) AS Age, coalesce(n.n_name, split_part(key, ',', 4)) AS Country, {YEAR_COLS}
FROM W LEFT JOIN nation n ON CAST(n.n_nationkey AS VARCHAR) = split_part(W.key, ',', 4)""",
        "translate_flattened": f"""WITH {W_CTE}
SELECT split_part(key, ',', 1) AS Education_Attainment, split_part(key, ',', 2) AS Citizen,
  split_part(key, ',', 3) AS Age,
  coalesce(r.r_name, n.n_name, split_part(key, ',', 4)) AS Country, {YEAR_COLS}
FROM W LEFT JOIN nation n ON CAST(n.n_nationkey AS VARCHAR) = split_part(W.key, ',', 4)
  LEFT JOIN region r ON CAST(r.r_regionkey AS VARCHAR) = split_part(W.key, ',', 4)""",
        "translate_prefixed": f"""SELECT c_custkey, coalesce(n.n_name, k.key) AS Country
FROM (SELECT c_custkey, {prefixed_key} AS key FROM customer) k
LEFT JOIN nation n ON k.key = 'NORD,' || CAST(n.n_nationkey AS VARCHAR)""",
        "codelist_xml": codelist("en"),
        "codelist_xml_missing_lang": codelist("de"),
        "shorten_labels": f"SELECT p_partkey, {shorten} AS label FROM part",
        "relabel_bands": f"""SELECT p_partkey,
  CAST(p_size AS VARCHAR) || '-' || CAST(p_size + 9 AS VARCHAR) AS band,
  {type_case} AS type_label FROM part""",
        "domain_profile": f"WITH {W_CTE}\n{profile}",
        "restrict_total": f"""WITH {W_CTE}
SELECT split_part(key, ',', 1) AS Education_Attainment, split_part(key, ',', 3) AS Age,
  split_part(key, ',', 4) AS Country, {YEAR_COLS}
FROM W WHERE split_part(key, ',', 2) = '{cube.CITIZEN_TOTAL}'""",
        "wide_to_long": f"WITH {W_CTE}\n" + "\nUNION ALL\n".join(
            f'SELECT key, {y} AS "Year", {clean_int(chr(34) + str(y) + chr(34), "null")} AS value FROM W'
            for y in YEARS),
        "natality_long": f"WITH {NAT_CTE}\nSELECT * FROM nat",
        "education_long": f"WITH {EDU_CTE}\nSELECT * FROM edu",
    }
    for s, bands in cube.STRATA.items():
        out[f"crosstab_{s}"] = f"WITH {EDU_CTE}\n{_ct(bands)}"
    all_segments = EDU_CTE.replace(f"WHERE split_part(W.key, ',', 2) = '{cube.CITIZEN_TOTAL}'", "")
    out["crosstab_all_segments"] = f"WITH {all_segments}\n{_ct(cube.STRATA['global'])}"
    for s in cube.STRATA:
        out[f"join_facts_{s}"] = _joined_sql(s)
    out.update(_slice_sql())
    # The flow from files: the same cells, translated and relabelled.
    words = {v: w for v, (_, w) in zip(cube.ATTAINMENT_VALUES, etl.ORDER_SHAPE.attainment_labels)}
    ct_cols = ", ".join(f'"{v}" AS "{w}"' for v, w in words.items())
    out["published_natality"] = out["natality_long"]
    for s, label in etl.STRATUM_OUTPUT.items():
        name = label.replace("-", "_")
        out[f"published_education_{name}"] = f'SELECT Country, "Year", {ct_cols} FROM ({out[f"crosstab_{s}"]})'
        out[f"published_joined_{name}"] = f'SELECT Country, "Year", Births, {ct_cols} FROM ({out[f"join_facts_{s}"]})'
    out["published_inferred"] = out["published_joined_global"]
    bands = {code: text.replace("From ", "").replace(" to ", "-").replace(" years", "") for code, text in cube.PRIORITY_TEXT.items()}
    attainment = "CASE Education_Attainment " + " ".join(f"WHEN {_q(v)} THEN {_q(w)}" for v, w in words.items()) + " END"
    age = "CASE Age " + " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in bands.items()) + " END"
    out["published_feed"] = (f'WITH {EDU_CTE}\nSELECT {attainment} AS Education_Attainment, {age} AS Age, Country, Proportion, '
                             f'"Year" FROM edu')
    for i in range(1, 14):
        sql, source = out[f"slice_n{i}"], SLICE_SOURCE[f"n{i}"]
        if source != "births":
            births = "Births, " if source == "joined" else ""
            sql = f'SELECT Country, "Year", {births}{ct_cols} FROM ({sql})'
        out[f"published_slice_n{i}"] = sql
    out["codelist_structure_xml"] = """SELECT code, coalesce(r_name, n_name, c_name) AS description FROM (
  SELECT CAST(c_custkey AS VARCHAR) AS code FROM customer UNION SELECT CAST(n_nationkey AS VARCHAR) FROM nation
  UNION SELECT CAST(r_regionkey AS VARCHAR) FROM region)
LEFT JOIN customer ON CAST(c_custkey AS VARCHAR) = code LEFT JOIN nation ON CAST(n_nationkey AS VARCHAR) = code
LEFT JOIN region ON CAST(r_regionkey AS VARCHAR) = code"""
    out["relabel_long_mapping"] = """SELECT o_orderkey, CASE WHEN dayofyear(o_orderdate) % 7 = 0
  THEN CAST(dayofyear(o_orderdate) AS VARCHAR)
  ELSE 'day ' || lpad(CAST(dayofyear(o_orderdate) AS VARCHAR), 3, '0') END AS day FROM orders"""
    out["row_number"] = "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS row_id FROM orders"
    out["translate_one_join"] = """SELECT o_orderkey, coalesce(a.c_name, CAST(o_custkey AS VARCHAR)) AS customer,
  coalesce(b.c_name, CAST(o_orderkey % 1000 AS VARCHAR)) AS contact
FROM orders LEFT JOIN customer a ON a.c_custkey = o_custkey LEFT JOIN customer b ON b.c_custkey = o_orderkey % 1000"""
    newest = [str(y) for y in reversed(YEARS)]
    line = " || chr(9) || ".join(["key", *(f'"{y}"' for y in newest)])
    out["preview_lines"] = f"""WITH {W_CTE}
SELECT {" || chr(9) || ".join(_q(c) for c in ("key", *newest))} AS value
UNION ALL (SELECT {line} FROM W ORDER BY key LIMIT 9)"""
    out["lineitem_crosstab"] = LINE_SQL
    out["translate_customer_names"] = """SELECT o_orderkey, coalesce(c.c_name, CAST(o.o_custkey AS VARCHAR)) AS customer
FROM orders o LEFT JOIN customer c ON CAST(c.c_custkey AS VARCHAR) = CAST(o.o_custkey AS VARCHAR)"""
    out["windowed_max_batch"] = _window_sql("orders", "o_orderstatus", "o_orderdate", "o_totalprice", 1995)
    out["windowed_max_stream"] = out["windowed_max_batch"]
    out["stream_sql"] = f"""WITH {EDU_CTE},
ev AS (SELECT Country, make_timestamp("Year", 1, 1, 0, 0, 0) AS ts, Proportion FROM edu)
SELECT Country, time_bucket(INTERVAL 35 DAY, ts, TIMESTAMP '1970-01-01') AS window_start,
  time_bucket(INTERVAL 35 DAY, ts, TIMESTAMP '1970-01-01') + INTERVAL 35 DAY AS window_end,
  max(Proportion) AS max_Proportion
FROM ev WHERE year(ts) > 1995 GROUP BY 1, 2, 3"""
    out["windowed_max_watermark"] = """WITH b AS (
  SELECT event_type, time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') AS window_start,
    time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') + INTERVAL 1 DAY AS window_end,
    max(value) AS max_value
  FROM events GROUP BY 1, 2, 3)
SELECT * FROM b"""
    out["windowed_max_update"] = out["windowed_max_watermark"]
    first = "(SELECT min(CAST(ts AS DATE)) FROM events)"
    out["late_rows"] = f"""SELECT count(*) AS input_rows, count(*) FILTER (WHERE CAST(ts AS DATE) > {first}) AS kept_rows,
  count(*) FILTER (WHERE CAST(ts AS DATE) = {first}) AS late_rows FROM events"""
    out["late_windows"] = out["windowed_max_watermark"].replace("max(value) AS max_value", "max(value) AS max_value, count(*) AS n_rows").replace(
        "FROM events", f"FROM events WHERE CAST(ts AS DATE) > {first}")
    out["stream_polls"] = " UNION ALL ".join(
        f"SELECT {poll} AS poll, * FROM (" + _window_sql(f"(SELECT * FROM orders WHERE year(o_orderdate) <= {upto})", "o_orderstatus", "o_orderdate",
                                                        "o_totalprice", 1995) + ")" for poll, upto in enumerate(POLL_YEARS, start=1))
    out["feed_republished"] = 'SELECT *, CAST(year(o_orderdate) AS INTEGER) AS "Year" FROM orders'
    nations = ", ".join(f"sum(CASE WHEN n_name = 'NATION_{i}' THEN l_quantity END) AS \"NATION_{i}\"" for i in range(25))
    out["crosstab_discovered"] = f"""SELECT l_returnflag, {nations}
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY l_returnflag"""
    out["split_key_pivot_discovered"] = (f"WITH {W_CTE}\nSELECT " + ", ".join(f"split_part(key, ',', {i + 1}) AS code{i}" for i in range(4))
                                         + f", {YEAR_COLS} FROM W")
    out["lost_cells"] = f"""WITH {W_CTE},
grid AS (SELECT k.key, y.y, cnt.n FROM (SELECT DISTINCT key FROM cnt) k CROSS JOIN (SELECT unnest({list(YEARS)}) AS y) y
  LEFT JOIN cnt ON cnt.key = k.key AND cnt.y = y.y),
why AS (SELECT CAST(y AS VARCHAR) AS "column", CASE WHEN n IS NULL THEN 'missing' WHEN n % 6 IN (0, 2) THEN 'not one number'
  WHEN n % 6 = 3 THEN 'no digits' WHEN n % 6 = 4 THEN 'empty' END AS reason FROM grid)
SELECT "column", reason, count(*) AS n FROM why WHERE reason IS NOT NULL GROUP BY 1, 2"""
    out["codelist_tags"] = """SELECT 'A_CUSTOMER' AS code_list, CAST(c_custkey AS VARCHAR) AS code, 'en' AS lang, c_name AS description FROM customer
UNION ALL SELECT 'GEO', CAST(n_nationkey AS VARCHAR), 'en', n_name FROM nation
UNION ALL SELECT 'REGION', CAST(r_regionkey AS VARCHAR), 'en', r_name FROM region"""
    out["row_number_ties"] = """SELECT o_orderstatus, min(r) AS first_id, max(r) AS last_id, count(DISTINCT r) AS n_ids
FROM (SELECT o_orderstatus, row_number() OVER (ORDER BY o_orderstatus) AS r FROM orders) GROUP BY o_orderstatus"""
    out["trend"] = f"""WITH {NAT_CTE}
SELECT Country, count(*) AS n, round(regr_slope(CAST(Births AS DOUBLE), CAST("Year" AS DOUBLE)), 6) AS slope,
  min("Year") AS first_t, max("Year") AS last_t,
  arg_min(Births, "Year") AS first_value, arg_max(Births, "Year") AS last_value,
  arg_max(Births, "Year") - arg_min(Births, "Year") AS change
FROM nat WHERE Births IS NOT NULL GROUP BY Country"""
    out["co_movement"] = f"""WITH {NAT_CTE},
{EDU_CTE},
ct AS ({_ct(cube.STRATA['global'])}),
jn AS (SELECT nat.Country, nat."Year", nat.Births, ct."F" FROM nat JOIN ct
       ON nat.Country = ct.Country AND nat."Year" = ct."Year")
SELECT Country, count(*) AS n,
  round(CASE WHEN stddev_pop(CAST(Births AS DOUBLE)) > 0 AND stddev_pop("F") > 0
        THEN corr(CAST(Births AS DOUBLE), "F") END, 6) AS corr
FROM jn WHERE Births IS NOT NULL AND "F" IS NOT NULL GROUP BY Country"""
    out["series_gap"] = f"""WITH {NAT_CTE}
SELECT "Year", max(CASE WHEN Country = 'NATION_12' THEN Births END) AS a_value,
  max(CASE WHEN Country = 'NATION_15' THEN Births END) AS b_value,
  max(CASE WHEN Country = 'NATION_12' THEN Births END) - max(CASE WHEN Country = 'NATION_15' THEN Births END) AS gap
FROM nat WHERE Country IN ('NATION_12', 'NATION_15') GROUP BY "Year\""""
    out["risers"] = f"""WITH {NAT_CTE},
per AS (SELECT Country, max(CASE WHEN "Year" = 1998 THEN Births END) AS base_value,
  max(CASE WHEN "Year" = 2000 THEN Births END) AS value
  FROM nat WHERE "Year" IN (1998, 2000) GROUP BY Country)
SELECT Country, base_value, value, value - base_value AS change FROM per WHERE value - base_value > 0"""
    return out
