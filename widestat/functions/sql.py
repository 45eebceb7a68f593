"""Quoting for SQL expression strings.

Bulk per-column expressions (one per year, one per pivot value) are written
as SQL text and parsed once on the JVM side: one call per expression instead
of one per function node, which keeps plan construction fast for wide tables.
"""

from __future__ import annotations


def ident(name: str) -> str:
    """A column name as a backquoted identifier."""
    return "`" + name.replace("`", "``") + "`"


def literal(text: str) -> str:
    """A Python string as a SQL string literal (backslashes and quotes escaped)."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"
