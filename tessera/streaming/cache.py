"""Cached answers on a stream: kept for a time, then let go."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "cache_key string, event string, response string"
#: Groups that keys are dealt to by their hash; a checkpoint holds for one number of them.
BUCKETS = 256


def kept(entries: DataFrame, ttl: int = 3600, late: str = "10 minutes", buckets: int = BUCKETS) -> DataFrame:
    """cache_key, event (``put`` or ``expired``), response for a stream of answers (cache_key, response, ts).

    The last answer of each key is its state, of those of one time the greatest; a newer one replaces it and starts
    its time anew. State goes ``ttl`` seconds of event time after its answer, when the watermark has passed that, so
    that it is bounded by the keys of that time. One row for each batch in which a key has answers.

    A group of Spark's state is a bucket of keys, since a call of Python for each key takes most of the time. It times
    out with the first of its keys.
    """

    def last(micros: int, response: str | None) -> tuple[int, bool, str]:
        return micros, response is None, response or ""

    def run(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {key: (micros, response) for key, response, micros in zip(*state.get)} if state.exists else {}
        put = set()
        for rows in batches:
            for key, response, micros in zip(rows["cache_key"].tolist(), rows["response"].tolist(), rows["micros"].tolist()):
                put.add(key)
                if key not in held or last(micros, response) > last(*held[key]):
                    held[key] = (micros, response)
        passed = (state.getCurrentWatermarkMs() - ttl * 1000) * 1000
        out = [(key, "put" if key in put else "expired", response) for key, (micros, response) in held.items() if key in put or micros < passed]
        held = {key: h for key, h in held.items() if key in put or h[0] >= passed}
        if held:
            state.update(([*held], [response for _, response in held.values()], [micros for micros, _ in held.values()]))
            state.setTimeoutTimestamp(max(min(micros for micros, _ in held.values()) // 1000 + ttl * 1000, state.getCurrentWatermarkMs() + 1))
        else:
            state.remove()
        yield pd.DataFrame(out, columns=["cache_key", "event", "response"])

    micros = F.coalesce(F.unix_micros("ts"), F.raise_error(F.lit("an answer has no time")).cast("long"))
    rows = entries.withWatermark("ts", late).select("cache_key", "response", micros.alias("micros"), "ts", F.pmod(F.xxhash64("cache_key"), F.lit(buckets)).alias("bucket"))
    held = "cache_keys array<string>, responses array<string>, micros array<long>"
    return rows.groupBy("bucket").applyInPandasWithState(run, EVENTS, held, "append", GroupStateTimeout.EventTimeTimeout)
