"""Structured Streaming forms: incremental indexing, replay removal, heartbeats and upload sessions."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.index import postings
from ..operators.sessions import REPLAY_TTL_S, Session, fold_session


def index_stream(docs: DataFrame, root: str, checkpoint: str, text: str = "text", key: str = "doc_id", poll: str | None = None) -> StreamingQuery:
    """Each micro-batch becomes one batch of postings and documents under root.

    The batch id is the stream's epoch and its partition is overwritten, so a
    replayed epoch leaves one copy. Without ``poll`` all that is there is read,
    in bounded batches, and the query ends.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        # dealt by hash: a range would take a sample, and so split the texts once more
        postings(batch, text, key).repartition("term").sortWithinPartitions("term", key).write.mode("overwrite").option("parquet.bloom.filter.enabled#term", "true").parquet(f"{root}/postings/batch_id={epoch}")
        # a pass over the keys alone: cheaper than holding the texts
        batch.select(key).write.mode("overwrite").parquet(f"{root}/documents/batch_id={epoch}")

    writer = docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=poll) if poll else writer.trigger(availableNow=True)).start()


def without_replays(requests: DataFrame, ttl_s: int = REPLAY_TTL_S) -> DataFrame:
    """First request of each device and id within the lifetime; state is dropped by the watermark."""
    return requests.withWatermark("ts", f"{ttl_s} seconds").dropDuplicatesWithinWatermark(["device_id", "request_id"])


def accepted_requests(requests: DataFrame, ttl_s: int = REPLAY_TTL_S, late_s: int = 60) -> DataFrame:
    """(device_id, request_id, event_id, replayed) of requests with ts, by the rule of ``replay.first_requests``: a key's window begins with its accepted request and is not prolonged.

    State is the time of the last accepted request of a key, and goes once the
    watermark has passed its window. Within a batch requests are taken in order
    of time; one that comes after a batch of later ones is judged by these.
    """

    def run(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        since = state.get[0] if state.exists else None
        for pdf in [pd.concat(list(pdfs))]:
            pdf = pdf.sort_values(["ts", "event_id"])
            out = []
            for t in pdf["ts"].astype("datetime64[us]").astype("int64"):
                fresh = since is None or t - since >= ttl_s * 1_000_000
                since = t if fresh else since
                out.append(not fresh)
            yield pd.DataFrame({"device_id": key[0], "request_id": key[1], "event_id": pdf["event_id"], "replayed": out})
        state.update((int(since),))
        state.setTimeoutTimestamp(max(since // 1000 + ttl_s * 1000, state.getCurrentWatermarkMs() + 1))

    types = {f.name: f.dataType.simpleString() for f in requests.schema}
    out = f"device_id {types['device_id']}, request_id {types['request_id']}, event_id {types['event_id']}, replayed boolean"
    return requests.withWatermark("ts", f"{late_s} seconds").groupBy("device_id", "request_id").applyInPandasWithState(run, out, "since long", "append", GroupStateTimeout.EventTimeTimeout)


def online_devices(beats: DataFrame, ttl_s: int = 90) -> DataFrame:
    """Heartbeats by device in sessions that a silence of ttl ends."""
    return beats.withWatermark("ts", f"{ttl_s} seconds").groupBy("device_id", F.session_window("ts", f"{ttl_s} seconds")).agg(F.count("*").alias("beats"), F.max("ts").alias("last_seen"))


def sessions(events: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Outcome codes of upload events (session, seq, kind, number, digest), with keyed state that expires after ttl_ms.

    Expiry by the clock keeps a query busy with empty batches, so it suits
    polling triggers; without ttl_ms an availableNow query ends.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        s = None
        if state.exists:
            kept = json.loads(state.get[0])
            s = Session(kept["n"], kept["state"], {int(k): v for k, v in kept["digests"].items()}, set(kept["done"]), kept["failure"])
        rows = pd.concat(list(batches)).sort_values("seq")
        s, codes = fold_session(rows.to_dict("records"), s)
        if s:
            state.update((json.dumps({"n": s.chunk_count, "state": s.state, "digests": s.digests, "done": sorted(s.done), "failure": s.failure}),))
            if ttl_ms is not None:
                state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame({"session": key[0], "seq": rows["seq"], "code": codes, "state": s.state if s else None})

    return events.groupBy("session").applyInPandasWithState(step, "session string, seq long, code int, state string", "json string", "append", GroupStateTimeout.NoTimeout if ttl_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def run_once(source: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    q = source.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
