"""Names of columns. What an operator adds replaces an input column of that name, in whatever case; columns that it only needs on
the way get names that the input doesn't have. So no extra column of the input clashes."""

from __future__ import annotations

from pyspark.sql import DataFrame


def kept(df: DataFrame, added: list[str]) -> list[int]:
    """Places of the columns that stay where columns named ``added`` come."""
    new = {x.lower() for x in added}
    return [k for k, c in enumerate(df.columns) if c.lower() not in new]


def unused(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores as it takes to be new."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
