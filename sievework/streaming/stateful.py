"""Online behaviours as Structured Streaming: admission limits, feedback, popularity, expiry, windowed events."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def admission(requests: DataFrame, most: int = 30, window_s: float = 60.0) -> DataFrame:
    """user_id, id, at, allowed over a stream requests(user_id long, id long, at timestamp): a sliding limit of admitted requests.

    The state of a user is the times of admitted requests in the window (at most `most`), dropped when it is idle.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["at", "id"])
        allowed = []
        for at in rows["at"]:
            t = at.timestamp()
            times = [x for x in times if t - x <= window_s]
            allowed.append(len(times) < most)
            if allowed[-1]:
                times.append(t)
        state.update((times,))
        state.setTimeoutDuration(int(window_s * 1000) + 1)
        yield pd.DataFrame({"user_id": key[0], "id": rows["id"], "at": rows["at"], "allowed": allowed})

    return requests.groupBy("user_id").applyInPandasWithState(run, "user_id long, id long, at timestamp, allowed boolean", "times array<double>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def feedback_stream(votes: DataFrame) -> DataFrame:
    """doc_id, feedback_score, n over a stream votes(doc_id long, at timestamp, delta double): smoothed, clamped to one."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        f, n = state.get if state.exists else (0.0, 0)
        for d in pd.concat(list(batches)).sort_values("at")["delta"]:
            f, n = max(-1.0, min(1.0, 0.8 * f + 0.2 * d)), n + 1
        state.update((f, n))
        yield pd.DataFrame({"doc_id": [key[0]], "feedback_score": [f], "n": [n]})

    return votes.groupBy("doc_id").applyInPandasWithState(run, "doc_id long, feedback_score double, n long", "f double, n long", "update", GroupStateTimeout.NoTimeout)


def popularity_sink(store, alias: str = "popularity") -> Callable[[DataFrame, int], None]:
    """foreachBatch sink for hits(doc_id, at): the collection keeps doc_id, hits, last_total (all hits up to its last one), epoch.

    Shares are hits / last_total at a document's last hit and hits / (sum of all hits) now. Hits count in the order they come, by
    time within a batch, so a late one counts when it comes. A version holds the epoch that made it, and its commit is one
    rename: a batch that is replayed after a failure finds its epoch there and adds nothing.
    """
    from ..operators.feedback import numbered

    def run(batch: DataFrame, epoch: int) -> None:
        old = store.read(alias) if store.target(alias) else None
        done = old.agg(F.sum("hits").alias("n"), F.max("epoch").alias("epoch")).first() if old is not None else None
        if done is not None and done["epoch"] is not None and done["epoch"] >= epoch:
            return
        total = (done["n"] or 0) if done is not None else 0
        new = numbered(batch.select("doc_id", "at"), "at", "doc_id").groupBy("doc_id").agg(F.count("*").alias("new_hits"), (F.max("seq") + total).alias("new_total"))
        if old is not None:
            met = old.drop("epoch").join(new, "doc_id", "full")
            hits, last = F.coalesce("hits", F.lit(0)) + F.coalesce("new_hits", F.lit(0)), F.coalesce("new_total", "last_total")
        else:
            met, hits, last = new, F.col("new_hits"), F.col("new_total")
        rows = met.select("doc_id", hits.cast("long").alias("hits"), last.cast("long").alias("last_total"), F.lit(epoch).cast("long").alias("epoch"))
        store.reindex(alias, lambda: rows)

    return run


def popularity(held: DataFrame) -> DataFrame:
    """doc_id, hits, popularity_at_last_hit, popularity of what popularity_sink keeps."""
    total = held.agg(F.sum("hits")).first()[0] or 1
    return held.select("doc_id", "hits", F.round(F.col("hits") / F.col("last_total"), 6).alias("popularity_at_last_hit"), F.round(F.col("hits") / F.lit(total), 6).alias("popularity"))


def merge_batches(apply: Callable[[DataFrame, int], None]):
    """foreachBatch sink that skips empty batches; apply(batch, epoch) merges into a keyed table and may see an epoch again."""

    def run(batch: DataFrame, epoch: int) -> None:
        if not batch.isEmpty():
            apply(batch, epoch)

    return run


def tumbling(events: DataFrame, width: str = "1 hour", late: str | None = None, *by: str) -> DataFrame:
    """start, end, by..., n, total of events(ts timestamp, value); with `late` a watermark for streams."""
    rows = events.withWatermark("ts", late) if late else events
    return rows.groupBy(F.window("ts", width), *by).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None, key: str = "user_id") -> DataFrame:
    """Sessions of a key separated by a gap without events."""
    rows = events.withWatermark("ts", late) if late else events
    return rows.groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
