"""Label expressions: ordered literal substitution and age-band shortening,
plus the fixed label lists of the source notebooks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the source notebooks (kept in their order).
# Region descriptions -> short labels.  The fourth description has two blanks
# before "(from 2015)".
REGION_LABEL_PAIRS: tuple[tuple[str, str], ...] = (
    ("Germany (until 1990 former territory of the FRG)", "Germany"),
    ("European Union - 15 countries (1995-2004)", "EU15"),
    ("Euro area - 18 countries (2014)", "EU18"),
    ("Euro area - 19 countries  (from 2015)", "EU19"),
    ("European Union - 27 countries (2007-2013)", "Old_EU27"),
    ("European Union - 27 countries (from 2020)", "EU27"),
    ("European Union - 28 countries (2013-2020)", "EU28"),
)

# Attainment descriptions -> labels (the intended pairing of the notebook's
# commented-out list with its label array).
ATTAINMENT_LABELS: dict[str, str] = {
    "Less than primary, primary and lower secondary education (levels 0-2)": "Secondary",
    "Upper secondary, post-secondary non-tertiary and tertiary education (levels 3-8)": "Tertiary",
    "Upper secondary and post-secondary non-tertiary education (levels 3 and 4)": "Vocational",
}
# ---------------------------------------------------------------------------

AGE_BAND_PATTERN = r"^From (\d+) to (\d+) years$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def replace_chain(c: Column | str, pairs: Iterable[tuple[str, str]]) -> Column:
    """Literal (not regex) substring replacement, applied in list order.

    Later pairs see the output of earlier ones, exactly like the notebook's
    ``\\Q...\\E`` loop; ``$`` and ``\\`` are plain characters.
    """
    out = _col(c)
    for original, label in pairs:
        out = F.replace(out, F.lit(original), F.lit(label))
    return out


def age_band(c: Column | str) -> Column:
    """``From 25 to 34 years`` -> ``25-34``; other text unchanged."""
    return F.regexp_replace(_col(c), AGE_BAND_PATTERN, "$1-$2")
