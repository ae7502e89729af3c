"""Events that time makes: a device turns offline, a file is sealed or changes after that. Each transition comes once.

State is one small row for each key. A device's timer is its last heartbeat
plus the lifetime: once the watermark passes it, the device is offline and its
state goes. Within a batch rows are taken in order, so the same rows give the
same transitions whatever the batches, as ``sessions.device_transitions`` and
``sessions.seal_events`` give them of a whole table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.sessions import HEARTBEAT_TTL_S


def device_transitions(beats: DataFrame, ttl_s: int = HEARTBEAT_TTL_S, late_s: int = 30) -> DataFrame:
    """(device_id, state, at) of heartbeats (device_id, ts): ONLINE at the first after a silence, OFFLINE ttl_s after the last before one."""
    ttl = pd.Timedelta(seconds=ttl_s)

    def run(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = []
        last = pd.Timestamp(state.get[0], unit="us") if state.exists else None
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"device_id": [key[0]], "state": ["OFFLINE"], "at": [last + ttl]})
            return
        for t in pd.concat([p["ts"] for p in pdfs]).sort_values():
            if last is not None and t - last > ttl:
                rows.append(("OFFLINE", last + ttl))
                last = None
            if last is None:
                rows.append(("ONLINE", t))
            last = t
        state.update((last.value // 1000,))
        # the end itself is still online
        state.setTimeoutTimestamp(max(last.value // 1_000_000 + ttl_s * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"device_id": key[0], "state": [s for s, _ in rows], "at": pd.Series([a for _, a in rows], dtype="datetime64[ns]")})

    kind = beats.schema["device_id"].dataType.simpleString()
    return beats.withWatermark("ts", f"{late_s} seconds").groupBy("device_id").applyInPandasWithState(run, f"device_id {kind}, state string, at timestamp", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def seal_events(scans: DataFrame, stable: int = 2) -> DataFrame:
    """(path, scan_no, event) of folder scans (path, scan_no, size, mtime): SEALED once size and time were equal in so many scans, CHANGED where a sealed file is another."""

    def run(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        size, mtime, count = state.get if state.exists else (None, None, 0)
        rows = []
        for r in pd.concat(list(pdfs)).sort_values("scan_no").itertuples():
            same = count > 0 and (r.size_, r.mtime) == (size, mtime)
            if not same and count >= stable:
                rows.append((r.scan_no, "CHANGED"))
            count = min(count + 1, stable + 1) if same else 1
            size, mtime = int(r.size_), int(r.mtime)
            if count == stable:
                rows.append((r.scan_no, "SEALED"))
        state.update((size, mtime, count))
        yield pd.DataFrame({"path": key[0], "scan_no": pd.Series([n for n, _ in rows], dtype="int64"), "event": pd.Series([e for _, e in rows], dtype="object")})

    named = scans.select("path", "scan_no", scans["size"].alias("size_"), "mtime")
    return named.groupBy("path").applyInPandasWithState(run, "path string, scan_no long, event string", "size long, mtime long, count int", "append", GroupStateTimeout.NoTimeout)
