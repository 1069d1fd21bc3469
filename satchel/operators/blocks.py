"""Pairs of blocks of a table, each pair in one task.

A block is a range of places, as large as a task can hold, since each row is sent once for each block.  A task goes through
the parts of its two blocks and gives away what each pair of parts yields before it turns to the next, so it holds two
blocks and the yield of two parts, however many pairs there are.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ranks

BYTES, ROWS = 32 << 20, 1 << 16  # of a block, at most
BLOCKS = 8  # so many blocks (36 tasks) at least, where they have ``least`` rows each
PART = 1024  # rows of a part


def size(n: int, values: int, least: int) -> int:
    """Rows of a block, of n rows that hold so many doubles in all."""
    held = BYTES * n // (8 * max(1, values))
    return max(1, min(max(least, -(-n // BLOCKS)), held, ROWS))


def met(rows: DataFrame, order: list, values: Column, least: int, prepare: Callable[[pd.DataFrame, Any], Any], compare: Callable[[Any, Any, bool], Iterator[pd.DataFrame]], schema: str, fold: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]] | None = None) -> DataFrame:
    """What ``compare`` yields of all pairs of parts, each pair once, the part that comes first in ``order`` being the first, and
    a part with itself (same).  Parts are made by ``prepare`` of their rows in that order and of the first part of the task.
    ``fold`` takes all that a task yields and gives what leaves it."""
    placed = ranks.numbered(rows, order, "_place")
    n, total = placed.agg(F.count(F.lit(1)), F.sum(values)).first()
    count = -(-n // size(n, total or 1, least)) if n else 1
    placed = placed.withColumn("_block", F.floor(F.col("_place") / size(n, total or 1, least)).cast("int"))
    sent = placed.withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    sent = sent.select("*", F.least("_block", "_other").alias("_p"), F.greatest("_block", "_other").alias("_q")).drop("_other")

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        some = [b for b in batches if len(b)]
        if not some:
            return
        whole = pd.concat(some, ignore_index=True) if len(some) > 1 else some[0]
        del some
        whole = whole.sort_values("_place", ignore_index=True)
        p, q = int(whole["_p"].iloc[0]), int(whole["_q"].iloc[0])
        parts: dict[int, list] = {p: [], q: []}
        first = None
        for block, held in parts.items():
            mine = whole[whole["_block"] == block]
            for at in range(0, len(mine), PART):
                held.append(prepare(mine.iloc[at : at + PART], first))
                first = held[-1] if first is None else first
        del whole
        found = (f for x, a in enumerate(parts[p]) for y, b in enumerate(parts[q]) if p != q or x <= y for f in compare(a, b, p == q and x == y))
        yield from fold(found) if fold else found

    tasks = count * (count + 1) // 2
    if tasks > 1:
        sent = sent.repartition(2 * tasks, "_p", "_q")
    return sent.groupBy("_p", "_q").applyInPandas(task, schema)
