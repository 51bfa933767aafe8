"""Work dealt over tasks where a table's files would leave it to a few."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Rows of a task, and tasks at most; beyond that tasks get larger.
ROWS, TASKS = 2048, 8192


def spread(keys: DataFrame, rows: int = ROWS) -> DataFrame:
    """The rows dealt evenly over tasks of about ``rows``.

    Files are cut by their bytes, so a table of keys is read by one task or two, and the texts made from its rows would
    all be parsed by these. Deal the keys, not the texts: they are counted, and moved once.
    """
    n = min(TASKS, -(-keys.count() // rows))
    return keys.repartition(n) if n > 1 else keys


def corpus(df: DataFrame) -> DataFrame:
    """The side of a join that is as long as the corpus: it is shuffled, never broadcast.

    The size of rows made from keys is guessed from the keys' file, so a side of millions of paths and ids would seem small
    enough to go through the driver.
    """
    return df.hint("merge")
