"""Conversation state: the record a chat is about, carried from turn to turn, and an offer that lives for one turn.

The batch form is a window with the last value that isn't null; the streaming form keeps the same state for each conversation.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Turns that a conversation's history keeps.
HISTORY = 20
_OUT = "conv_id long, turn long, about string, fresh boolean, turns_kept int"


def replay(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, about, fresh, turns_kept) of turns (conv_id, turn, named: what the turn names or null)."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    about = F.last("named", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    kept = F.least(F.lit(HISTORY), F.count("*").over(w.rowsBetween(Window.unboundedPreceding, 0))).cast("int")
    return turns.select("conv_id", "turn", about.alias("about"), F.col("named").isNotNull().alias("fresh"), kept.alias("turns_kept"))


def stream(turns: DataFrame) -> DataFrame:
    """The same of a streaming DataFrame: state is (about, turns_kept) for each conversation; turns of one arrive in order, or in one batch."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        about, kept = state.get if state.exists else (None, 0)
        rows = pd.concat(list(batches)).sort_values("turn")
        out = []
        for turn, named in zip(rows["turn"], rows["named"]):
            fresh = named is not None and named == named
            about = named if fresh else about
            kept = min(HISTORY, kept + 1)
            out.append((key[0], turn, about, fresh, kept))
        state.update((about, kept))
        yield pd.DataFrame(out, columns=["conv_id", "turn", "about", "fresh", "turns_kept"])

    return turns.groupBy("conv_id").applyInPandasWithState(step, _OUT, "about string, turns_kept int", "append", "NoTimeout")
