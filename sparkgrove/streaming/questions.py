"""Streams beside ingest: questions to a static index, a rate limit by key, an evaluation that goes on where it stopped."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sparkgrove.engine import Engine
from sparkgrove.evaluator import Evaluator


def answer_stream(engine: Engine, questions: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Answers to a stream of questions (query_id, question), a table by batch: a batch that runs again writes its own folder again."""

    def step(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            engine.ask(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return questions.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def limit_stream(requests: DataFrame, most: int, seconds: float = 60.0, late: str = "1 minute") -> DataFrame:
    """(key, ts, items, granted) of a stream of requests (key, ts, items): granted while the items granted in the ``seconds`` before stay within ``most``.

    A request of more than ``most`` passes when nothing else is there. Requests of a key are
    taken in the order of their times within a batch; a key's state is what was granted
    in the last ``seconds``, and goes when the watermark has passed it.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        at, taken = (list(x) for x in state.get) if state.exists else ([], [])
        rows = pd.concat(list(frames)).sort_values("ts", kind="stable")
        out = []
        for ts, items in zip(rows["ts"], rows["items"], strict=True):
            now = ts.timestamp()
            while at and now - at[0] >= seconds:
                at.pop(0)
                taken.pop(0)
            granted = not at or sum(taken) + items <= most
            if granted:
                at.append(now)
                taken.append(int(items))
            out.append((key[0], ts, int(items), granted))
        state.update((at, taken))
        state.setTimeoutTimestamp(max(int(((at[-1] if at else now) + seconds) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["key", "ts", "items", "granted"])

    return requests.withWatermark("ts", late).groupBy("key").applyInPandasWithState(step, "key string, ts timestamp, items long, granted boolean", "at array<double>, taken array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def evaluate_stream(evaluator: Evaluator, questions: DataFrame, checkpoint: str) -> StreamingQuery:
    """Ask the questions of a stream of labelled rows (query_id, question, ...); answers are kept as they come, and done files are not asked again."""

    def step(batch: DataFrame, number: int) -> None:
        evaluator.answer(batch).select(F.count("*")).collect()

    return questions.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
