"""The wide reader binds years by the header's names."""

import pytest

from conftest import rows
from widestat.session import checkpoint_root, drop_scratch, scratch_path
from widestat.sources.wide import read_wide


def write(tmp_path, *files):
    for name, text in files:
        (tmp_path / name).write_text(text)
    return str(tmp_path)


def test_any_order_of_years(spark, tmp_path):
    path = write(tmp_path, ("w.tsv", "unit,geo\\time\t2011 \t2009 \t2010 \nA\tx11\tx9\tx10\n"))
    out = read_wide(spark, path, [2009, 2010, 2011])
    assert out.columns == ["key", "2009", "2010", "2011"] and rows(out) == [("A", "x9", "x10", "x11")]


@pytest.mark.parametrize("years", [[2009, 2010], [2009, 2010, 2011, 2012], [2009, 2010, 2013]])
def test_other_years_fail(spark, tmp_path, years):
    path = write(tmp_path, ("w.tsv", "k\t2011\t2010\t2009\nA\t1\t2\t3\n"))
    with pytest.raises(ValueError, match="2011"):
        read_wide(spark, path, years)


def test_files_with_unequal_headers_fail(spark, tmp_path):
    path = write(tmp_path, ("a.tsv", "k\t2009\t2010\nA\t1\t2\n"), ("b.tsv", "k\t2010\t2009\nB\t1\t2\n"))
    with pytest.raises(Exception):
        read_wide(spark, path, [2009, 2010]).collect()


def test_scratch_is_dropped_only_inside_its_folder(spark):
    path = scratch_path(spark, "drop-me")
    spark.range(3).write.parquet(path)
    drop_scratch(spark, path)
    with pytest.raises(Exception):
        spark.read.parquet(path)
    with pytest.raises(ValueError):
        drop_scratch(spark, f"{checkpoint_root(spark)}/elsewhere")
