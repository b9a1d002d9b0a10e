"""Markdown tables of results."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame


def shown(v: object) -> str:
    """A cell; what is not known is a dash."""
    if v is None or isinstance(v, float) and math.isnan(v):
        return "—"
    if isinstance(v, float):
        return f"{v:,.4g}"
    return f"{v:,}" if isinstance(v, int) and not isinstance(v, bool) else str(v).replace("|", "\\|")


def percent(v: float | None) -> str:
    return "—" if v is None or math.isnan(v) else f"{100 * v:.1f}%"


def markdown(rows: DataFrame, most: int = 200) -> str:
    """The first rows as a table; numbers stand to the right."""
    number = {c for c, kind in rows.dtypes if kind in ("int", "bigint", "double", "float")}
    head = ["| " + " | ".join(rows.columns) + " |", "| " + " | ".join("---:" if c in number else "---" for c in rows.columns) + " |"]
    return "\n".join(head + ["| " + " | ".join(shown(r[c]) for c in rows.columns) + " |" for r in rows.limit(most).collect()])


def report(sections: dict[str, DataFrame], fixture: bool = False) -> str:
    """Sections of tables; a banner where the corpus is a fixture."""
    banner = ["> These figures come from a fixture corpus and say nothing about languages.", ""] if fixture else []
    return "\n".join(["# Results", "", *banner, *(line for title, rows in sections.items() for line in (f"## {title}", "", markdown(rows), ""))])
