"""Work on equal rows done once: sources repeat lines, so what depends on a line's text alone is worked out for each different one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from cipherlake.sources.staging import staged


def once(rows: DataFrame, keys: list[str], work: Callable[[DataFrame], DataFrame], label: str) -> DataFrame:
    """rows, each with every row that work makes of its keys; work keeps the keys and sees each different combination once.

    What it makes is written, so Spark knows its size before rows are joined: a small table is broadcast and rows stay where
    they are, a large one meets them in a shuffle. Rows with a null key get nothing.
    """
    made = staged(work(rows.select(*keys).distinct()), label)
    return rows.join(made, keys).select(*(rows[c] for c in rows.columns), *(made[c] for c in made.columns if c not in keys))
