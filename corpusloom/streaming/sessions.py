"""Stateful folds over streams: chat sessions and retries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Words that a session's history may hold before its oldest turns go.
HISTORY_WORDS = 3000
OUTPUT = "conv_id long, turn long, history_turns int, history_words int"


def session_history(events: DataFrame, most: int = HISTORY_WORDS) -> DataFrame:
    """For each message of a stream the history kept at it: whole turns, ``most`` words at most.

    ``events``: conv_id, turn, role, text. A message of role ``clear`` empties the history.
    State is the word counts of the kept turns, so it is bounded by ``most``.
    """

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        for f in frames:
            out = []
            for turn, role, text in f.sort_values("turn")[["turn", "role", "text"]].itertuples(index=False):
                held = [] if role == "clear" else [*held, len((text or "").split())]
                while held and sum(held) > most:
                    held.pop(0)
                out.append((key[0], turn, len(held), sum(held)))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT.split(", ")])
        state.update((held,))

    return events.groupBy("conv_id").applyInPandasWithState(fold, OUTPUT, "held array<int>", "append", GroupStateTimeout.NoTimeout)


def retry_outcome(attempts: DataFrame, most: int = 5) -> DataFrame:
    """The outcome of retried requests: attempts go on until a success, a status seen twice, or ``most``.

    ``attempts``: request, attempt, status. One fold over each request's few attempts.
    """
    rows = F.slice(F.sort_array(F.collect_list(F.struct("attempt", "status"))), 1, most)
    per = attempts.filter(F.col("attempt") < most).groupBy("request").agg(rows.alias("a"))
    start = F.struct(F.array().cast("array<int>").alias("seen"), F.lit(False).alias("over"), F.lit(None).cast("int").alias("status"), F.lit(0).alias("tried"))

    def step(s, x):
        status = x["status"].cast("int")
        ends = ((status >= 200) & (status < 300)) | F.array_contains(s["seen"], status)
        next_ = F.struct(F.concat(s["seen"], F.array(status)).alias("seen"), ends.alias("over"), status.alias("status"), (s["tried"] + 1).alias("tried"))
        return F.when(s["over"], s).otherwise(next_)

    folded = per.withColumn("s", F.aggregate("a", start, step))
    return folded.select("request", F.col("s.status").alias("status"), F.col("s.tried").alias("tried"))


def tumbling(events: DataFrame, time: str, width: str, late: str, value: str) -> DataFrame:
    """Counts and sums by event-time window, with a watermark for late rows; an addition, for convenience."""
    return events.withWatermark(time, late).groupBy(F.window(time, width)).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
