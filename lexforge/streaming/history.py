"""An extension: the last turns of each session kept as a stream's state.

The rules are those of ``operators.sessions``; the state holds ``k`` turns a session and
expires with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "session_id string, turns long, history string"
STATE = "ids array<long>, times array<timestamp>, lines array<string>, n long"


def recent_history(turns: DataFrame, k: int = 5, delay: str = "1 hour") -> DataFrame:
    """(session_id, turns, history) whenever a session has new turns (session_id, id, timestamp, question, answer).

    Late turns count by their time, as long as they are newer than what is kept; repeated ids
    within the delay count once.
    """
    rows = turns.withWatermark("timestamp", delay).dropDuplicatesWithinWatermark(["session_id", "id"])

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        have, n = [], 0
        if state.exists:
            ids, times, lines, n = state.get
            have = list(zip(times, ids, lines))
        for batch in batches:
            n += len(batch)
            have += [(r.timestamp, int(r.id), f"{r.question}\n{r.answer}") for r in batch.itertuples()]
        have = sorted(have)[-k:]
        state.update(([x[1] for x in have], [x[0] for x in have], [x[2] for x in have], n))
        state.setTimeoutTimestamp(int(pd.Timestamp(have[-1][0]).timestamp() * 1000) + 3_600_000)
        yield pd.DataFrame({"session_id": [key[0]], "turns": [n], "history": ["\n\n".join(x[2] for x in have)]})

    return rows.groupBy("session_id").applyInPandasWithState(step, OUT, STATE, "update", GroupStateTimeout.EventTimeTimeout)
