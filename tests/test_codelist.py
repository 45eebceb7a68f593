import os

import pytest

from conftest import rows
from widestat.sources.codelist import flatten_codes, load_code_tags, load_codes, write_code_lists, write_code_rows

# A structure file shaped like a published one: prefixed names, several lists,
# a code ("T") present in two lists, a code with no English description.
DSD = """<?xml version="1.0" encoding="UTF-8"?>
<mes:Structure xmlns:mes="urn:m" xmlns:structure="urn:s" xmlns:xml="http://www.w3.org/XML/1998/namespace">
 <mes:CodeLists>
  <structure:CodeList id="CL_SEX" agencyID="X">
   <structure:Name xml:lang="en">Sex</structure:Name>
   <structure:Code value="T"><structure:Description xml:lang="en">Total</structure:Description><structure:Description xml:lang="de">Insgesamt</structure:Description></structure:Code>
   <structure:Code value="F"><structure:Description xml:lang="en">Females</structure:Description></structure:Code>
  </structure:CodeList>
  <structure:CodeList id="CL_GEO" agencyID="X">
   <structure:Code value="AT"><structure:Description xml:lang="en">Austria</structure:Description><structure:Description xml:lang="fr">Autriche</structure:Description></structure:Code>
   <structure:Code value="T"><structure:Description xml:lang="en">Tee &amp; more</structure:Description></structure:Code>
   <structure:Code value="XX"><structure:Description xml:lang="de">Nur Deutsch</structure:Description></structure:Code>
  </structure:CodeList>
 </mes:CodeLists>
</mes:Structure>
"""


def write_dsd(workdir):
    path = os.path.join(workdir, "dsd")
    os.makedirs(path)
    with open(os.path.join(path, "codes.xml"), "w") as f:
        f.write(DSD)
    return path


def test_load_published_structure(spark, workdir):
    codes = load_codes(spark, write_dsd(workdir), "en")
    assert rows(codes, "code_list", "code", "lang", "description") == sorted([
        ("CL_SEX", "T", "en", "Total"), ("CL_SEX", "F", "en", "Females"),
        ("CL_GEO", "AT", "en", "Austria"), ("CL_GEO", "T", "en", "Tee & more"),
        ("CL_GEO", "XX", "en", None)], key=repr)


def test_language_and_missing_modes(spark, workdir):
    path = write_dsd(workdir)
    de = {(r.code_list, r.code): r.description for r in load_codes(spark, path, "de").collect()}
    assert de[("CL_SEX", "T")] == "Insgesamt" and de[("CL_GEO", "AT")] is None
    empty = {(r.code_list, r.code): r.description for r in load_codes(spark, path, "de", missing="empty").collect()}
    assert empty[("CL_GEO", "AT")] == ""


def test_flatten_last_wins(spark, workdir):
    # F7 parity: one map for all lists, the later list's "T" wins.
    flat = {r.code: r.description for r in flatten_codes(load_codes(spark, write_dsd(workdir), "en")).collect()}
    assert flat["T"] == "Tee & more" and flat["F"] == "Females"


def test_code_rows_round_trip(spark, workdir):
    data = [("GEO", "1", [("en", "One <1>"), ("fr", "Un")]), ("REG", "1", [("en", "Region & co")])]
    df = spark.createDataFrame(data, "code_list string, code string, descriptions array<struct<lang:string,text:string>>")
    path = write_code_rows(df, os.path.join(workdir, "xml"))
    got = rows(load_codes(spark, path, "en", row_tag="Code"), "code_list", "code", "description")
    assert got == [("GEO", "1", "One <1>"), ("REG", "1", "Region & co")]
    fr = rows(load_codes(spark, path, "fr", row_tag="Code"), "code_list", "description")
    assert fr == sorted([("GEO", "Un"), ("REG", None)], key=repr)


def test_file_order_does_not_follow_file_sizes(spark, workdir):
    # Spark packs larger files first; the later file by name wins all the same.
    for big in ("a", "b"):
        path = os.path.join(workdir, f"big-{big}")
        os.makedirs(path)
        for name, text in (("a", "first"), ("b", "last")):
            filler = "".join(f'<structure:Code value="{name}{i}"><structure:Description xml:lang="en">x</structure:Description>'
                             f"</structure:Code>" for i in range(3000 if name == big else 1))
            with open(os.path.join(path, f"{name}.xml"), "w") as f:
                f.write(f'<m:S xmlns:m="m" xmlns:structure="s"><structure:CodeList id="L{name}"><structure:Code value="A">'
                        f'<structure:Description xml:lang="en">{text}</structure:Description></structure:Code>{filler}'
                        f"</structure:CodeList></m:S>")
        flat = {r.code: r.description for r in flatten_codes(load_codes(spark, path, "en")).collect()}
        assert flat["A"] == "last" and len(flat) == 3002


def test_several_descriptions_in_one_language_are_joined(spark, workdir):
    path = os.path.join(workdir, "twice")
    os.makedirs(path)
    with open(os.path.join(path, "x.xml"), "w") as f:
        f.write('<S><CodeList id="L"><Code value="A"><Description lang="en">one</Description><Description lang="fr">un</Description>'
                '<Description lang="en">-two</Description></Code></CodeList></S>')
    assert [r.description for r in load_codes(spark, path, "en").collect()] == ["one-two"]


def test_structure_files_round_trip(spark, workdir):
    data = [("f1", "B", "1", 0, [("en", "One <1> & \"more\""), ("fr", "Un")]), ("f1", "A", "2", 1, [("en", "Two")]),
            ("f1", "A", "1", 0, [("en", "Uno")]), ("f2", "C", "1", 0, [("en", "Last")])]
    df = spark.createDataFrame(data, "file string, code_list string, code string, code_pos long, "
                                     "descriptions array<struct<lang:string,text:string>>")
    codes = load_codes(spark, write_code_lists(df, os.path.join(workdir, "s")), "en")
    assert rows(codes, "code_list", "code", "description") == sorted(
        [("B", "1", 'One <1> & "more"'), ("A", "2", "Two"), ("A", "1", "Uno"), ("C", "1", "Last")])
    assert {r.code: r.description for r in flatten_codes(codes).collect()} == {"1": "Last", "2": "Two"}


CODES = ("code_list", "code", "lang", "description")


def test_tags_equal_rows(spark, workdir):
    path = write_dsd(workdir)
    for lang in ("en", "de", "fr"):
        for missing in ("keep", "empty"):
            assert rows(load_code_tags(spark, path, lang, missing), *CODES) == rows(load_codes(spark, path, lang, missing=missing), *CODES)
    flat = {r.code: r.description for r in flatten_codes(load_code_tags(spark, path, "en")).collect()}
    assert flat["T"] == "Tee & more" and flat["F"] == "Females"


def test_one_list_over_many_splits(spark, workdir):
    """A list far larger than a split, a small one after it, several files:
    equal to the reading of a list as one row, order included."""
    data = [("f1", "BIG", str(i), i, [("en", f"text {i} <&> \"x\""), ("fr", f"t{i}")] if i % 7 else [("fr", "only")]) for i in range(3000)]
    data += [("f1", "SMALL", "5", 0, [("en", "five")]), ("f1", "SMALL", "9", 1, [("en", "nine")]), ("f2", "BIG", "5", 0, [("en", "later")])]
    df = spark.createDataFrame(data, "file string, code_list string, code string, code_pos long, "
                                     "descriptions array<struct<lang:string,text:string>>")
    path = write_code_lists(df, os.path.join(workdir, "s"))
    want = load_codes(spark, path, "en")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        assert spark.read.option("lineSep", "<").text(path).rdd.getNumPartitions() > 50
        got = load_code_tags(spark, path, "en")
        assert rows(got, *CODES) == rows(want, *CODES) and got.count() == 3003
        place = [(r.code_list, r.code) for r in got.orderBy("code_pos").collect()]
        assert place == [(r.code_list, r.code) for r in want.orderBy("code_pos").collect()]
        assert rows(flatten_codes(got), "code", "description") == rows(flatten_codes(want), "code", "description")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_tags_with_odd_markup(spark, workdir):
    def load(body, name):
        path = os.path.join(workdir, name)
        os.makedirs(path)
        with open(os.path.join(path, "x.xml"), "w") as f:
            f.write(f'<?xml version="1.0"?><m:S xmlns:m="m" xmlns:s="s"><!-- a comment -->{body}</m:S>')
        return load_code_tags(spark, path, "en")

    odd = load("""<s:CodeList agencyID='A' id='L>1'><s:Code urn="a>b" value='x&amp;y'/><s:Code value="2"><s:Description
        xml:lang="en">a &#8211; b</s:Description></s:Code></s:CodeList><s:Code value="loose"><s:Description xml:lang='en'></s:Description></s:Code>""", "a")
    assert rows(odd, "code_list", "code", "description") == sorted([("L>1", "x&y", None), ("L>1", "2", "a \u2013 b"), ("L>1", "loose", "")], key=repr)
    for body in ('<s:CodeList id="L"><![CDATA[x]]></s:CodeList>', '<!-- <s:Code value="no"/> -->'):
        with pytest.raises(Exception, match="read this file with load_codes"):
            load(body, f"b{len(body)}").collect()
    assert load("", "c").count() == 0
