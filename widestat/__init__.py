"""widestat — wide official-statistics tables on Spark.

Read flagged wide tables and XML code lists, clean and split keys, translate
codes, reshape, cross-tabulate, join facts, publish, slice, and run the same
windowed aggregate on batch and streaming frames.
"""

from widestat.operators.clean import clean_measures, domain_profile
from widestat.operators.facts import join_facts
from widestat.operators.keys import restrict, split_key, split_key_pivot_form
from widestat.operators.reshape import crosstab, stratum_crosstab, wide_to_long
from widestat.operators.rowid import with_row_id
from widestat.operators.slices import SliceParams, slices
from widestat.operators.translate import (relabel, relabel_age, shorten,
                                          translate)
from widestat.operators.trends import co_movement, risers, series_gap, trend
from widestat.session import checkpoint_root, get_spark, persisted, scratch_path
from widestat.sources.codelist import flatten_codes, load_codes, write_code_rows
from widestat.sources.published import publish, read_feed, read_published
from widestat.sources.wide import preview, read_wide, wide_schema, write_wide
from widestat.streaming.feed import feed_schema, write_stream_feed
from widestat.streaming.runner import read_file_stream, run_stream
from widestat.streaming.windowed import windowed_max

__all__ = [
    "checkpoint_root", "clean_measures", "co_movement", "crosstab",
    "domain_profile", "feed_schema", "flatten_codes", "get_spark", "join_facts", "load_codes",
    "persisted", "preview", "publish", "read_feed", "read_file_stream", "read_published", "read_wide",
    "relabel", "relabel_age", "restrict", "risers", "run_stream", "scratch_path", "series_gap",
    "shorten", "SliceParams", "slices", "split_key", "split_key_pivot_form", "stratum_crosstab",
    "translate", "trend", "wide_schema", "wide_to_long", "windowed_max", "with_row_id",
    "write_code_rows", "write_stream_feed", "write_wide",
]
