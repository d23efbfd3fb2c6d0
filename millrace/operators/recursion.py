"""Recursive queries: a fixpoint over the rows found so far, without repeats."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import RecursiveCteLimit

ROUNDS = 1000
STORE_EVERY = 8
#: Rows of a round that the driver keeps as a local relation; more are stored.
LOCAL_ROWS = 10_000


def fixpoint(anchor: DataFrame, term: Callable[[DataFrame], DataFrame], store: Callable[[DataFrame], DataFrame], rounds: int = ROUNDS) -> DataFrame:
    """The anchor's rows and, once each, all rows that ``term`` makes of rows found before, until it makes no new ones.

    Each round gives the term only the rows that the last one brought (the terms of the dialect are linear), and takes out
    rows known already by a null-safe anti join. A round of up to LOCAL_ROWS rows becomes a local relation in one job;
    once one has more, rounds are stored, so plans stay short and a lost executor costs one round. Over ``rounds`` rounds
    raise RecursiveCteLimit.
    """
    small = True

    def settled(df: DataFrame) -> tuple[DataFrame, bool]:
        """df without a plan behind it, and whether it has rows."""
        nonlocal small
        if small:
            rows = df.limit(LOCAL_ROWS + 1).toArrow()
            if rows.num_rows <= LOCAL_ROWS:
                return df.sparkSession.createDataFrame(rows, df.schema), rows.num_rows > 0
            small = False
        out = store(df)
        return out, not out.isEmpty()

    names = anchor.columns
    found, _ = settled(anchor)
    front = found
    for n in range(1, rounds + 2):
        made = term(front).toDF(*names).distinct()
        marked = found.select(*(F.col(f"`{c}`").alias(f"_f{i}") for i, c in enumerate(names)))
        on = None
        for i, c in enumerate(names):
            one = made[c].eqNullSafe(marked[f"_f{i}"])
            on = one if on is None else on & one
        new, some = settled(made.join(marked, on, "left_anti"))
        if not some:
            return found
        found, front = found.unionAll(new), new
        if n % STORE_EVERY == 0:
            found = settled(found)[0]
    raise RecursiveCteLimit(f"no fixpoint after {rounds} rounds")
