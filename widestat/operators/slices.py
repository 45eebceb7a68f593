"""The named slices the analysis notebook charts, as lazy filters over
the published births, education and joined datasets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class SliceParams:
    """Labels and years the slices test.  Defaults are the fixed values of the
    analysis notebook; other datasets pass their own."""

    token: str = "EU"                 # substring marking an aggregate series
    births_last_year: int = 2020      # incomplete year left out of births
    education_first_year: int = 2004  # incomplete year left out of education
    joined_after: int = 2008          # joined slice keeps years after this
    births_series: str = "EU28"       # N6
    education_wide: str = "EU28"      # N7
    education_core: str = "EU15"      # N8
    h1_series: str = "EU19"           # N9
    h2_not_equal: str = "EU27"        # N10
    h2_not_containing: str = "EU19"   # N10
    h3_equal: str = "EU18"            # N11
    h3_containing: str = "EU28"       # N11
    h4_after: int = 2017              # N12
    h4_country: str = "Iceland"       # N13
    # Exact aggregate labels.  None = substring test on ``token`` (parity: it
    # also takes "Old_EU27"); a set makes "aggregate" an exact membership.
    aggregates: tuple[str, ...] | None = None


def _is_aggregate(p: SliceParams):
    if p.aggregates is not None:
        return F.col("Country").isin(list(p.aggregates))
    return F.col("Country").contains(p.token)


def births_national(births: DataFrame, p: SliceParams = SliceParams()) -> DataFrame:      # N1
    return births.filter(~_is_aggregate(p))


def births_aggregate(births: DataFrame, p: SliceParams = SliceParams()) -> DataFrame:     # N2
    return births.filter(_is_aggregate(p) & (F.col("Year") != p.births_last_year))


def education_national(edu: DataFrame, p: SliceParams = SliceParams()) -> DataFrame:      # N3
    return edu.filter(~_is_aggregate(p))


def education_aggregate(edu: DataFrame, p: SliceParams = SliceParams()) -> DataFrame:     # N4
    return edu.filter(_is_aggregate(p) & (F.col("Year") != p.education_first_year))


def joined_aggregate(joined: DataFrame, p: SliceParams = SliceParams()) -> DataFrame:     # N5
    return joined.filter(_is_aggregate(p) & (F.col("Year") > p.joined_after))


# Which published dataset each slice reads.
SLICE_SOURCE = {
    "n1": "births", "n2": "births", "n6": "births", "n11": "births", "n12": "births", "n13": "births",
    "n3": "education", "n4": "education", "n7": "education", "n8": "education", "n10": "education",
    "n5": "joined", "n9": "joined",
}


def one_slice(sid: str, frame: DataFrame, p: SliceParams = SliceParams()) -> DataFrame:
    """Slice ``sid`` of the dataset it reads (see ``SLICE_SOURCE``)."""
    country = F.col("Country")
    if sid == "n1":
        return births_national(frame, p)
    if sid == "n2":
        return births_aggregate(frame, p)
    if sid == "n3":
        return education_national(frame, p)
    if sid == "n4":
        return education_aggregate(frame, p)
    if sid == "n5":
        return joined_aggregate(frame, p)
    if sid == "n6":
        return births_aggregate(frame, p).filter(country == p.births_series)
    if sid == "n7":
        return education_aggregate(frame, p).filter(country == p.education_wide)
    if sid == "n8":
        return education_aggregate(frame, p).filter(country == p.education_core)
    if sid == "n9":
        return joined_aggregate(frame, p).filter(country == p.h1_series)
    if sid == "n10":
        return education_aggregate(frame, p).filter(
            (country != p.h2_not_equal) & ~country.contains(p.h2_not_containing))
    if sid == "n11":
        return births_aggregate(frame, p).filter(
            (country == p.h3_equal) | country.contains(p.h3_containing))
    if sid == "n12":
        return births_national(frame, p).filter(F.col("Year") > p.h4_after)
    if sid == "n13":
        return births_national(frame, p).filter(country == p.h4_country)
    raise KeyError(sid)


def slices(births: DataFrame, education: DataFrame, joined: DataFrame,
           p: SliceParams = SliceParams()) -> dict[str, DataFrame]:
    """All thirteen slices by id.  Nothing is cached: each is a filter that
    Catalyst pushes to the scan of the published dataset."""
    frames = {"births": births, "education": education, "joined": joined}
    return {sid: one_slice(sid, frames[src], p) for sid, src in SLICE_SOURCE.items()}
