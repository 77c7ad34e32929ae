"""Column names that clash with none of a table's."""

from __future__ import annotations

from pyspark.sql import DataFrame


def fresh(docs: DataFrame, *wanted: str) -> list[str]:
    """The ``wanted`` names, lengthened until no column of ``docs`` has them in any case of letters."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
