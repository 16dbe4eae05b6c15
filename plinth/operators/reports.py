"""Small results as text for readers: aligned tables, Markdown, JSON. A report is limited; it never holds a corpus."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame

#: Rows that a report shows.
MOST = 1000


def _cell(value: Any) -> str:
    if value is None:
        return ""
    return f"{value:.4f}" if isinstance(value, float) else ", ".join(map(str, value)) if isinstance(value, list) else str(value)


def _cells(rows: DataFrame, most: int) -> list[list[str]]:
    return [[_cell(v) for v in r] for r in rows.limit(most).collect()]


def table(rows: DataFrame, most: int = MOST) -> str:
    """Columns aligned by spaces under their names."""
    body = [rows.columns, *_cells(rows, most)]
    width = [max(len(r[i]) for r in body) for i in range(len(rows.columns))]
    return "\n".join("  ".join(c.ljust(w) for c, w in zip(r, width, strict=True)).rstrip() for r in body)


def markdown(rows: DataFrame, most: int = MOST) -> str:
    """A Markdown table; bars inside cells are escaped."""
    line = lambda cells: "| " + " | ".join(c.replace("|", "\\|").replace("\n", " ") for c in cells) + " |"
    return "\n".join([line(rows.columns), line(["---"] * len(rows.columns)), *map(line, _cells(rows, most))])


def as_json(rows: DataFrame, most: int = MOST) -> str:
    return json.dumps([r.asDict(recursive=True) for r in rows.limit(most).collect()], default=str, indent=2)


FORMS = {"table": table, "markdown": markdown, "json": as_json}
