"""Upload sessions, heartbeats, replays, sealing and collector tasks.

The rules are plain Python over one key's ordered events, so that batch folds
and streaming state share them; set-wise forms are columns.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Default limits: sessions in all, by device and by collector, reserved bytes.
GLOBAL, BY_DEVICE, BY_COLLECTOR, RESERVED = 24, 2, 6, 8 << 30
HEARTBEAT_TTL_S, REPLAY_TTL_S, CLOCK_SKEW_S = 90, 600, 300
#: Outcome codes of admission and of chunk registration.
CREATED, EXISTS, FULL, DEVICE_FULL, COLLECTOR_FULL, BYTES_FULL = 1, 2, 3, 4, 5, 6
REGISTERED, DONE_ALREADY, OTHER_CONTENT, NOT_UPLOADING, NO_SESSION = 0, 1, 2, 3, 4
TERMINAL = ("ARCHIVED", "FAILED")


@dataclass
class Session:
    chunk_count: int
    state: str = "UPLOADING"
    digests: dict[int, str] = field(default_factory=dict)
    done: set[int] = field(default_factory=set)
    failure: str = ""


@dataclass
class Ledger:
    """Active sessions (id → device, collector, size, expiry) and their quotas; events must come in total order."""

    limits: tuple[int, int, int, int] = (GLOBAL, BY_DEVICE, BY_COLLECTOR, RESERVED)
    active: dict[str, tuple[str, str, int, int]] = field(default_factory=dict)

    def admit(self, session: str, device: str, collector: str, size: int, now: int, ttl: int) -> int:
        self.active = {k: v for k, v in self.active.items() if v[3] > now}
        if session in self.active:
            return EXISTS
        most, by_device, by_collector, reserved = self.limits
        if len(self.active) >= most:
            return FULL
        if sum(v[0] == device for v in self.active.values()) >= by_device:
            return DEVICE_FULL
        if sum(v[1] == collector for v in self.active.values()) >= by_collector:
            return COLLECTOR_FULL
        if sum(v[2] for v in self.active.values()) + size > reserved:
            return BYTES_FULL
        self.active[session] = (device, collector, size, now + ttl)
        return CREATED

    def release(self, session: str) -> None:
        self.active.pop(session, None)


def begin_chunk(s: Session | None, number: int, digest: str) -> int:
    if s is None:
        return NO_SESSION
    if s.state != "UPLOADING":
        return NOT_UPLOADING
    known = s.digests.get(number)
    if known is not None and known != digest:
        return OTHER_CONTENT
    if known is not None and number in s.done:
        return DONE_ALREADY
    s.digests[number] = digest
    return REGISTERED


def finish_chunk(s: Session | None, number: int, digest: str) -> bool:
    if s is None or s.state != "UPLOADING" or s.digests.get(number) != digest:
        return False
    s.done.add(number)
    return True


def begin_complete(s: Session | None) -> int:
    """0 verifying now, 1 verifying already, 2 archived, 3 failed, 4 chunks missing, 5 unknown."""
    if s is None:
        return 5
    if s.state != "UPLOADING":
        return {"ARCHIVED": 2, "VERIFYING": 1}.get(s.state, 3)
    if len(s.done) != s.chunk_count:
        return 4
    s.state = "VERIFYING"
    return 0


def end_complete(s: Session | None, sound: bool) -> bool:
    if s is None:
        return False
    s.state, s.failure = ("ARCHIVED", "") if sound else ("FAILED", "FILE_INTEGRITY_MISMATCH")
    return True


def fold_session(events: Iterable[dict], s: Session | None = None) -> tuple[Session | None, list[int]]:
    """State and outcome codes of one session's events: create, chunk (begin and finish), complete, verified."""
    codes = []
    for e in events:
        kind = e["kind"]
        if kind == "create":
            codes.append(EXISTS if s else CREATED)
            s = s or Session(int(e["number"]))
        elif kind == "chunk":
            code = begin_chunk(s, int(e["number"]), e["digest"])
            if code == REGISTERED:
                finish_chunk(s, int(e["number"]), e["digest"])
            codes.append(code)
        elif kind == "complete":
            codes.append(begin_complete(s))
        else:
            codes.append(int(end_complete(s, e["digest"] == "ok")))
    return s, codes


def fold_sessions(events: DataFrame) -> DataFrame:
    """(session, seq, kind, number, digest) → (session, seq, code, state): each session's events in order of seq.

    Sessions stream through their tasks one after another. Only the events of
    the current one are held, and a session has a few chunks by its size limit.
    """

    def done(held: list[dict]) -> list[tuple]:
        s, codes = fold_session(held)
        return [(e["session"], e["seq"], c, s.state if s else None) for e, c in zip(held, codes, strict=True)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[dict] = []
        frame = lambda rows: pd.DataFrame(rows, columns=["session", "seq", "code", "state"])
        for pdf in batches:
            out = []
            for e in pdf.to_dict("records"):
                if held and held[0]["session"] != e["session"]:
                    out += done(held)
                    held = []
                held.append(e)
            if out:
                yield frame(out)
        if held:
            yield frame(done(held))

    dealt = events.select("session", "seq", "kind", "number", "digest").repartition("session").sortWithinPartitions("session", "seq")
    return dealt.mapInPandas(run, "session string, seq long, code int, state string")


def missing_chunks(done: Column, count: Column) -> Column:
    return F.when(count > 0, F.array_except(F.sequence(F.lit(0).cast("long"), count - 1), done)).otherwise(F.array().cast("array<bigint>"))


def quotas(active: DataFrame) -> DataFrame:
    """Sessions and reserved bytes in all, by device and by collector."""
    return active.groupingSets([[], [F.col("device_id")], [F.col("collector_id")]], "device_id", "collector_id").agg(F.count("*").alias("sessions"), F.sum("file_size").alias("bytes"))


def heartbeats(events: DataFrame, now: Column, ttl: int = HEARTBEAT_TTL_S) -> DataFrame:
    """Last heartbeat of each device, and whether it is online."""
    last = events.groupBy("device_id").agg(F.max_by(F.struct("ts", "status", "work_order"), "ts").alias("h"))
    return last.select("device_id", "h.*", (F.col("h.ts") >= now - F.make_interval(secs=F.lit(ttl))).alias("online"))


def device_transitions(beats: DataFrame, ttl: int = HEARTBEAT_TTL_S) -> DataFrame:
    """(device_id, state, at) of all heartbeats (device_id, ts): ONLINE at the first after a silence of more than ttl seconds, OFFLINE ttl after the last before one or before the end."""
    order = W.partitionBy("device_id").orderBy("ts")
    life = F.make_interval(secs=F.lit(ttl))
    rows = beats.select("device_id", "ts", (F.lag("ts").over(order) + life).alias("before"), F.lead("ts").over(order).alias("after"))
    on = F.when(F.col("before").isNull() | (F.col("ts") > F.col("before")), F.struct(F.lit("ONLINE").alias("state"), F.col("ts").alias("at")))
    off = F.when(F.col("after").isNull() | (F.col("after") > F.col("ts") + life), F.struct(F.lit("OFFLINE").alias("state"), (F.col("ts") + life).alias("at")))
    return rows.select("device_id", F.explode(F.array_compact(F.array(on, off))).alias("e")).select("device_id", "e.state", "e.at")


def seal_events(scans: DataFrame, stable: int = 2) -> DataFrame:
    """(path, scan_no, event) of folder scans: SEALED at the scan that makes a file stable, CHANGED at the one that finds a sealed file to be another."""
    run = sealed(scans.withColumns({"has_marker": F.lit(False), "has_sidecar": F.lit(True)}), "STABLE_WINDOW", stable)
    before = F.lag("stable_count").over(W.partitionBy("path").orderBy("scan_no"))
    run = run.withColumn("before", before)
    changed = F.when((F.col("stable_count") == 1) & (F.col("before") >= stable), "CHANGED")
    done = F.when(F.col("stable_count") == stable, "SEALED")
    return run.select("path", "scan_no", F.explode(F.array_compact(F.array(changed, done))).alias("event"))


def heartbeat_ok(status: Column, work_order: Column) -> Column:
    """A known status, and a missing work order only while idle."""
    return F.coalesce(status.isin("RUNNING", "IDLE", "ALARM"), F.lit(False)) & (work_order.isNotNull() | (status == "IDLE"))


def sealed(scans: DataFrame, mode: str, stable: int = 2) -> DataFrame:
    """Scans (path, scan_no, size, mtime, has_marker, has_sidecar) with sealed: by rename at once, by equal size and time for so many scans, or by a marker; a sidecar always."""
    order = W.partitionBy("path").orderBy("scan_no")
    changed = ~(F.col("size").eqNullSafe(F.lag("size").over(order)) & F.col("mtime").eqNullSafe(F.lag("mtime").over(order)))
    run = scans.withColumn("__g", F.sum(changed.cast("int")).over(order))
    run = run.withColumn("stable_count", F.row_number().over(W.partitionBy("path", "__g").orderBy("scan_no"))).drop("__g")
    done = {"ATOMIC_RENAME": F.lit(True), "STABLE_WINDOW": F.col("stable_count") >= stable, "DONE_MARKER": F.col("has_marker")}[mode]
    return run.withColumn("sealed", done & F.col("has_sidecar"))


def changed_source(known: DataFrame, seen: DataFrame) -> DataFrame:
    """seen files with action: skip an equal one, fail a changed one that is still active, else take."""
    j = seen.join(known.select("path", F.col("size").alias("__s"), F.col("mtime").alias("__m"), F.col("state").alias("__t")), "path", "left")
    same = (F.col("size") == F.col("__s")) & (F.col("mtime") == F.col("__m"))
    active = F.col("__t").isNotNull() & ~F.col("__t").isin("DONE", "FAILED")
    return j.withColumn("action", F.when(same, "SKIP").when(active, "SOURCE_CHANGED_AFTER_SEAL").otherwise("TAKE")).drop("__s", "__m", "__t")


def response_class(status: Column, code: Column) -> Column:
    """What a collector does with a response."""
    return (
        F.when((status >= 500) | code.isin("UPLOAD_LIMIT_EXCEEDED", "CHUNKS_INCOMPLETE"), "RETRY")
        .when((status == 404) & (code == "UPLOAD_NOT_FOUND"), "SESSION_MISSING")
        .when(status.between(200, 299), "OK")
        .otherwise("FAIL")
    )


def next_task_state(state: str, outcome: str) -> str:
    """READY → UPLOADING → COMPLETING → DONE; a lost session starts over, a retry waits in its state, other failures end."""
    if outcome == "OK":
        return {"READY": "UPLOADING", "UPLOADING": "COMPLETING", "COMPLETING": "DONE"}.get(state, state)
    return {"SESSION_MISSING": "READY", "RETRY": state}.get(outcome, "FAILED")


def cleanup(files: DataFrame, sessions: DataFrame, cutoff_s: int) -> DataFrame:
    """Unfinished files older than the cutoff whose session is gone or at its end."""
    old = files.where(F.col("name").rlike(r"^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}\.part\z") & (F.col("mtime_s") < cutoff_s))
    s = sessions.select(F.concat("session", F.lit(".part")).alias("name"), F.col("state").alias("__state"))
    return old.join(s, "name", "left").where(F.col("__state").isNull() | F.col("__state").isin(*TERMINAL)).drop("__state")


#: Fields of a stored session: all must be there, these five as numbers.
SESSION_TEXT = ("upload_id", "state", "device_id", "station_id", "line_id", "collector_id", "work_order", "product_sn", "file_type", "result", "original_filename", "extension", "temp_path", "relative_path", "produced_at", "file_sha256", "failure_code")
SESSION_NUMBERS = ("file_size", "chunk_size", "chunk_count", "expires_at")
SESSION_LATER = ("archive_id", "archived_at")


def read_sessions(rows: DataFrame, fields: str = "fields") -> DataFrame:
    """Sessions from a map of strings: typed fields and ``valid``; a missing field or a number that is none makes it false. archive_id and archived_at may be missing."""
    at = lambda k: F.try_element_at(F.col(fields), F.lit(k))
    whole = lambda k: F.when(at(k).rlike(r"^[0-9]{1,18}\z"), at(k).cast("long"))
    later = F.lit(True)
    for k in SESSION_LATER:
        later = later & (at(k).isNull() | (at(k) == "") | whole(k).isNotNull())
    ok = later
    for k in SESSION_TEXT:
        ok = ok & at(k).isNotNull()
    for k in SESSION_NUMBERS:
        ok = ok & whole(k).isNotNull()
    return rows.withColumns({k: at(k) for k in SESSION_TEXT} | {k: whole(k) for k in SESSION_NUMBERS + SESSION_LATER} | {"valid": F.coalesce(ok, F.lit(False))})


def completeness(chunks: DataFrame, expected: Column) -> DataFrame:
    """(upload, complete): whether an upload's distinct chunk numbers are as many as expected."""
    return chunks.groupBy("upload").agg((F.count_distinct("number") == F.max(expected)).alias("complete"))


def next_task(state: Column, outcome: Column) -> Column:
    """``next_task_state`` as a column."""
    ok = F.when(state == "READY", "UPLOADING").when(state == "UPLOADING", "COMPLETING").when(state == "COMPLETING", "DONE").otherwise(state)
    return F.when(outcome == "OK", ok).when(outcome == "SESSION_MISSING", "READY").when(outcome == "RETRY", state).otherwise("FAILED")
