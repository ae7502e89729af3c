"""The index as a whole: scan, build, publish, compact, recover and rebuild over one root folder.

A log of commits says what counts. An entry names the rows of the control
tables (batches, archives) that it changes, and holds the head: how far the
archive table is discovered, archives that wait, batches under way, and the
segments that readers see, each with the digest of a manifest of its files. So
an operation reads the newest entry and what it works on, whatever the index
has grown to; the control tables as a whole are read for reports alone.

A writer puts each version after the last one that it has seen, which fails if
another has: the lock file keeps writers from meeting, the log keeps what they
do apart. Readers are many: an engine keeps the segments that it was opened
with, and segments that a merge replaces stay for a while. States are committed
before the work that they name, so that ``recover`` finds what a crash left.
"""

from __future__ import annotations

import hashlib
import json
import math
import time
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from datetime import UTC, datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import schemas
from ..operators import index, parsers, search, state
from ..sources.archives import decode_guard, discover, undiscovered
from ..sources.commit_log import CommitLog, Conflict
from ..sources.files import Archive, lines
from ..sources.storage import digest, write_text

MAX_FILES, MAX_DOCUMENTS = 100, 100_000
#: Versions of changes before one holds all rows; seconds after which a lock is held to be left behind.
COMPACT_AFTER, LEASE_S = 32, 3600
#: Segments of about one size that are merged into one; seconds for which replaced segments stay.
FANOUT, GRACE_S = 8, 3600
EMPTY_HEAD = {"high": 0, "gaps": [], "pending": [], "last_batch": 0, "open": {}, "segments": [], "retired": []}


class WriterBusy(RuntimeError):
    """Another writer holds the lock, or has committed meanwhile."""


class DamagedSegment(RuntimeError):
    """INDEX_CORRUPTED: files of a segment that are missing, of another size or of other content."""


def _plain(row: dict) -> dict:
    """A row for the log: times as microseconds."""
    return {k: int(v.replace(tzinfo=v.tzinfo or UTC).timestamp() * 1_000_000) if isinstance(v, datetime) else v for k, v in row.items()}


class LogIndex:
    def __init__(self, spark: SparkSession, root: str, lease_s: int = LEASE_S):
        self.spark, self.root, self.lease_s = spark, root.rstrip("/"), lease_s
        self.log = CommitLog(spark, f"{self.root}/log")
        self._held, self._seen, self._head = None, 0, EMPTY_HEAD

    # control tables
    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    @contextmanager
    def _writer(self):
        """The lock file, made if there is none; one older than the lease is taken over. What is put to the log afterwards decides."""
        if self._held:
            yield
            return
        p, fs = self._fs(f"{self.root}/.writer.lock")
        fs.mkdirs(p.getParent())
        if fs.exists(p) and fs.getFileStatus(p).getModificationTime() < (time.time() - self.lease_s) * 1000:
            fs.delete(p, False)
        if not fs.createNewFile(p):
            raise WriterBusy(self.root)
        self._held = uuid.uuid4().hex
        write_text(self.spark, f"{self.root}/.writer.lock", self._held)
        self._seen, entry = self.log.newest()
        self._head = {**EMPTY_HEAD, **entry.get("head", {})}
        try:
            yield
        finally:
            if self._owner() == self._held:
                fs.delete(p, False)
            self._held = None

    def _owner(self) -> str | None:
        """What the lock file says."""
        p, fs = self._fs(f"{self.root}/.writer.lock")
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def head(self) -> dict:
        return {**EMPTY_HEAD, **self.log.newest()[1].get("head", {})}

    def _versions(self) -> dict[int, bool]:
        """Versions of the log, and whether each holds all rows."""
        return {v: e["full"] for v in self.log.versions() for e in [self.log.read(v)]}

    def tables(self) -> tuple[DataFrame, DataFrame]:
        """(batches, archives): the newest row of each key."""
        entries = [(v, self.log.read(v)) for v in self.log.versions()]
        first = max((v for v, e in entries if e["full"]), default=0)
        used = {e["data"]: v for v, e in entries if v >= first and e["data"]}
        return self._newest(used, "batches", schemas.BATCH, "batch_id"), self._newest(used, "archives", schemas.INDEXED, "archive_id")

    def _newest(self, versions: dict[str, int], name: str, schema: str, key: str) -> DataFrame:
        if not versions:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(*[f"{self.root}/state/{d}/{name}" for d in versions])
        if len(versions) == 1:
            return rows
        order = F.create_map(*[F.lit(x) for pair in versions.items() for x in pair])
        version = F.try_element_at(order, F.regexp_extract(F.col("_metadata.file_path"), rf"/state/([0-9a-f]+)/{name}/", 1))
        columns = [c.split()[0] for c in schema.split(", ")]
        return rows.select("*", version.alias("__v")).groupBy(key).agg(F.max_by(F.struct(*columns), "__v").alias("r")).select("r.*")

    def _commit(self, batches: DataFrame, archives: DataFrame, **changes) -> None:
        """Writes changed rows beside the log and puts them and the changed head as the next version."""
        self._head = {**self._head, **changes}
        self._put(batches, archives, False)
        versions = self._versions()
        last = max((v for v, full in versions.items() if full), default=0)
        if sum(v > last for v in versions) > COMPACT_AFTER:
            self._put(*self.tables(), True)
            # what the last full version began stays for those who still read it
            for v in versions:
                if v < last:
                    p, fs = self._fs(f"{self.root}/state/{self.log.read(v)['data']}")
                    fs.delete(p, True)
                    self.log.remove(v)

    def _put(self, batches: DataFrame, archives: DataFrame, full: bool) -> None:
        data = uuid.uuid4().hex
        at = f"{self.root}/state/{data}"
        batches.select([c.split()[0] for c in schemas.BATCH.split(", ")]).coalesce(1).write.parquet(f"{at}/batches")
        archives.select([c.split()[0] for c in schemas.INDEXED.split(", ")]).write.parquet(f"{at}/archives")
        try:
            self.log.put(self._seen + 1, {"data": data, "full": full, "writer": self._held, "at": int(time.time() * 1000), "head": self._head})
        except Conflict as e:
            raise WriterBusy(f"{self.root}: {e}") from e
        self._seen += 1
        p, fs = self._fs(f"{self.root}/.writer.lock")
        if self._owner() == self._held:
            fs.setTimes(p, int(time.time() * 1000), -1)

    # rows of batches under way
    def _row(self, batch: int) -> DataFrame:
        """The row of a batch under way, as the log's head has it."""
        row = self._head["open"][str(batch)]
        times = {c.split()[0] for c in schemas.BATCH.split(", ") if c.endswith(" timestamp")}
        values = [datetime.fromtimestamp(row[c] / 1e6, UTC).replace(tzinfo=None) if c in times and row.get(c) is not None else row.get(c) for c in (x.split()[0] for x in schemas.BATCH.split(", "))]
        return self.spark.createDataFrame([tuple(values)], schemas.BATCH)

    def _move(self, batch: int, rows: DataFrame, archives: DataFrame | None = None, done: bool = False, **changes) -> None:
        """Commits a batch's changed row; one that is done is under way no more."""
        open_ = {k: v for k, v in self._head["open"].items() if k != str(batch)}
        if not done:
            open_[str(batch)] = _plain(rows.first().asDict())
        self._commit(rows, self._none() if archives is None else archives, open=open_, **changes)

    def _archives(self, batch: int) -> DataFrame:
        """The archives' rows of a batch, by its outcomes alone."""
        outcomes = self.spark.read.parquet(f"{self.root}/outcomes/batch_id={batch}")
        return state.apply_outcomes(state.attach(self._none(), outcomes, batch), outcomes)

    def _none(self) -> DataFrame:
        return self.spark.createDataFrame([], schemas.INDEXED)

    def _digests(self, files: Archive | DataFrame, rows: DataFrame, batch: int) -> DataFrame:
        """Lengths and digests of the files of some archives as they are now: at most a batch's paths come to the driver, and only those files are read."""
        if not isinstance(files, Archive):
            return files
        return files.scan([r["relative_path"] for r in rows.select("relative_path").collect()], f"{self.root}/scan/batch_id={batch}", keep_raw=False).digests()

    def _drop(self, batch_id: int, tables: tuple[str, ...] = (*index.TABLES, "parsed", "outcomes", "scan")) -> None:
        for t in tables:
            p, fs = self._fs(f"{self.root}/{t}/batch_id={batch_id}")
            fs.delete(p, True)

    # operations
    def scan_once(self, source: DataFrame, files: Archive | DataFrame, profiles: DataFrame, max_files: int = MAX_FILES, max_documents: int = MAX_DOCUMENTS) -> dict:
        """Parses the next archives into one batch: those pending first, else new ones by the log's offsets. Returns its summary."""
        with self._writer():
            h = self._head
            ids, high, gaps, pending = h["pending"][:max_files], h["high"], h["gaps"], h["pending"][max_files:]
            if not ids:
                ids, high, gaps = discover(source, high, gaps, max_files)
            # at most max_files rows, so that nothing upstream runs again
            found = decode_guard(source.where(F.col("archive_id").isin(ids))).collect() if ids else []
            rows = self.spark.createDataFrame(found, source.schema)
            if not found:
                if (high, gaps, pending) != (h["high"], h["gaps"], h["pending"]):
                    self._commit(self.spark.createDataFrame([], schemas.BATCH), self._none(), high=high, gaps=gaps, pending=pending)
                return {"source_files": 0, "parsed_files": 0, "failed_files": 0, "documents": 0, "batch_id": None}
            batch = h["last_batch"] + 1
            at = {t: f"{self.root}/{t}/batch_id={batch}" for t in ("outcomes", "parsed", "scan")}
            row = self.spark.range(1).select(F.lit(batch).cast("long").alias("batch_id"), F.lit(min(ids)).alias("first_archive_id"), F.lit(max(ids)).alias("last_archive_id"), F.lit("PARSING").alias("state"), F.lit(len(found)).alias("source_file_count"), F.current_timestamp().alias("created_at"))
            row = self.spark.createDataFrame([], schemas.BATCH).unionByName(row, allowMissingColumns=True)
            # offsets move once the batch is parsed, so that a crash before that loses nothing
            self._move(batch, row, last_batch=batch)

            s = self._parse(rows, files, profiles, at, max_documents)
            self._drop(batch, ("scan",))
            outcomes = self.spark.read.parquet(at["outcomes"])
            taken = [r["archive_id"] for r in outcomes.select("archive_id").collect()]
            code = None if s["parsed_files"] else "NO_ARCHIVE_PARSED"
            row = self._row(batch).withColumns({
                "state": F.lit("FAILED" if code else "PARSED"), "failure_code": F.lit(code).cast("string"), "first_archive_id": F.lit(min(taken, default=None)).cast("long"), "last_archive_id": F.lit(max(taken, default=None)).cast("long"), "source_file_count": F.lit(s["source_files"]).cast("long"),
                "document_count": F.lit(s["documents"]).cast("long"), "parsed_path": F.lit(at["parsed"]), "parsed_sha256": F.lit(str(digest(self.spark.read.parquet(at["parsed"])))),
            })
            # what the batch had no room for comes next
            left = sorted({r["archive_id"] for r in found} - set(taken))
            self._move(batch, row, self._archives(batch), done=bool(code), high=high, gaps=gaps, pending=left + pending)
            return s | {"batch_id": batch}

    def rescan(self, source: DataFrame) -> int:
        """Looks through the whole archive table for rows that the offsets have given up, by an anti-join, and puts them before all others. Returns how many."""
        with self._writer():
            seen = self.tables()[1].where(F.col("archive_id") <= self._head["high"])
            lost = undiscovered(source.where(F.col("archive_id") <= self._head["high"]), seen, 100_000).select("archive_id").collect()
            fresh = sorted({r["archive_id"] for r in lost} - set(self._head["pending"]))
            if fresh:
                self._commit(self.spark.createDataFrame([], schemas.BATCH), self._none(), pending=fresh + self._head["pending"])
            return len(fresh)

    def _parse(self, rows: DataFrame, files: Archive | DataFrame, profiles: DataFrame, at: dict[str, str], max_documents: int) -> dict:
        """Reads the files of a batch once, parses each line once, and stores checked lines and outcomes; the counts come from the write of the outcomes."""
        if isinstance(files, Archive):
            scan = files.scan([r["relative_path"] for r in rows.select("relative_path").collect()], at["scan"])
            physical, digests = scan.lines(), scan.digests()
        else:
            physical, digests = lines(files.select("relative_path", "content")), files
        admitted = self.spark.createDataFrame((a := parsers.admit(rows, digests, profiles)).collect(), a.schema)
        parsers.parse_lines(admitted, physical).write.mode("overwrite").parquet(at["parsed"])
        checked = self.spark.read.parquet(at["parsed"])
        # counted for each file before the batch is cut, which looks at the counts again and again
        counted = self.spark.createDataFrame((o := parsers.outcomes_of(admitted, checked)).collect(), o.schema)
        bad = F.col("failure_code").isNotNull()
        seen = Observation()
        cut = parsers.cut_batch(counted, max_documents)
        cut.observe(seen, F.count("*").alias("source_files"), F.count_if(~bad).alias("parsed_files"), F.count_if(bad).alias("failed_files"), F.coalesce(F.sum("document_count"), F.lit(0)).alias("documents")).write.mode("overwrite").parquet(at["outcomes"])
        return seen.get

    def build_next(self, on_disk: Archive | DataFrame) -> int | None:
        """Builds the oldest PARSED batch into the index and publishes it; what was parsed and the originals are verified again first. None if there is none or it fails."""
        with self._writer():
            waiting = sorted(int(b) for b, r in self._head["open"].items() if r["state"] == "PARSED")
            if not waiting:
                return None
            b = waiting[0]
            first = self._head["open"][str(b)]
            self._move(b, state.move_batch(self._row(b), b, "PARSED", "BUILDING")[0])
            checked, outcomes = (self.spark.read.parquet(f"{self.root}/{t}/batch_id={b}") for t in ("parsed", "outcomes"))
            good = outcomes.where("failure_code IS NULL")
            sound = str(digest(checked)) == first["parsed_sha256"] and index.verify_originals(good, self._digests(on_disk, good, b)).isEmpty()
            self._drop(b, ("scan",))
            if sound:
                self._drop(b, index.TABLES)
                index.build_segment(parsers.documents_of(checked, outcomes), outcomes, b, self.root)
                sound = self._sound(b)
            if not sound:
                self._move(b, state.move_batch(self._row(b), b, "BUILDING", "FAILED", "SEGMENT_BUILD_FAILED")[0], done=True)
                return None
            self._publish(b)
            return b

    def _publish(self, b: int) -> None:
        ready, indexed = state.publish_ready(self._row(b), self._archives(b), b)
        now = F.current_timestamp()
        segment = self._described(f"batch_id={b}", [[b, b]])
        ready = ready.withColumns({"published_at": now, "segment_name": F.lit(segment["name"]), "segment_sha256": F.lit(segment["manifest"])})
        self._move(b, ready, indexed.withColumn("indexed_at", F.when(F.col("state") == "INDEXED", now).otherwise(F.col("indexed_at"))), done=True, segments=[*self._head["segments"], segment])

    # segments
    def _listed(self, name: str) -> dict[str, int]:
        """Files of a segment by their path under the root, and their sizes."""
        out = {}
        for t in index.TABLES:
            p, fs = self._fs(f"{self.root}/{t}/{name}")
            for f in fs.listStatus(p) if fs.exists(p) else []:
                if f.isFile() and not f.getPath().getName().startswith(("_", ".")):
                    out[f"{t}/{name}/{f.getPath().getName()}"] = f.getLen()
        return out

    def _file_digests(self, paths: list[str]) -> dict[str, str]:
        """SHA-256 of some files under the root; each is read by one task."""
        return {r["relative_path"]: r["sha256"] for r in Archive(self.spark, self.root).files(paths).select("relative_path", "sha256").collect()} if paths else {}

    def _described(self, name: str, batches: list[list[int]]) -> dict:
        """Writes the manifest of a segment (sizes and digests of its files) and returns its line for the head."""
        sizes = self._listed(name)
        digests = self._file_digests(list(sizes))
        text = json.dumps({f: [n, digests[f]] for f, n in sorted(sizes.items())})
        write_text(self.spark, f"{self.root}/segments/{name}.json", text)
        n = index.load(self.spark, self.root, "stats", [name]).agg(F.sum("documents")).first()[0]
        return {"name": name, "batches": batches, "documents": n or 0, "manifest": hashlib.sha256(text.encode()).hexdigest()}

    def _manifest(self, segment: dict) -> dict[str, list]:
        p, fs = self._fs(f"{self.root}/segments/{segment['name']}.json")
        if not fs.exists(p):
            raise DamagedSegment(f"{segment['name']}: no manifest")
        stream = fs.open(p)
        try:
            text = bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()
        if hashlib.sha256(text).hexdigest() != segment["manifest"]:
            raise DamagedSegment(f"{segment['name']}: the manifest is not the one that was published")
        return json.loads(text)

    def damaged(self, segment: dict, digests: bool = True) -> list[str]:
        """Files of a segment that are missing, more than it has, of another size or, with digests, of other content."""
        want, there = self._manifest(segment), self._listed(segment["name"])
        bad = {f for f in {*want, *there} if want.get(f, [None])[0] != there.get(f)}
        if digests:
            whole = [f for f in want if f not in bad]
            found = self._file_digests(whole)
            bad |= {f for f in whole if found.get(f) != want[f][1]}
        return sorted(bad)

    def _segment_of(self, batch: int) -> dict | None:
        return next((s for s in self._head["segments"] if any(a <= batch <= b for a, b in s["batches"])), None)

    def verify(self, b: int) -> bool:
        """Whether the segment of a READY batch still holds what was published."""
        self._head = self.head()
        segment = self._segment_of(b)
        return segment is not None and not self.damaged(segment)

    def audit(self) -> DataFrame:
        """(segment, file, problem) of what the segments in use no longer hold: missing, size or sha256. Each file is read once, by one task."""
        rows = []
        for s in self.head()["segments"]:
            want, there = self._manifest(s), self._listed(s["name"])
            found = self._file_digests([f for f in want if f in there])
            for f in sorted({*want, *there}):
                size, sha = want.get(f, [None, None])
                problem = "missing" if f not in there else "unknown" if f not in want else "size" if there[f] != size else "sha256" if found.get(f) != sha else None
                rows += [(s["name"], f, problem)] if problem else []
        return self.spark.createDataFrame(rows, "segment string, file string, problem string")

    def _sound(self, b: int) -> bool:
        t = {n: index.load(self.spark, self.root, n, [b]) for n in index.TABLES}
        return index.violations(t["documents"], t["files"], t["postings"], t["terms"], t["stats"]).isEmpty()

    def compact(self, fanout: int = FANOUT, grace_s: int = GRACE_S) -> int:
        """Merges segments of about one size wherever there are fanout of them; each merge is one commit. Returns the number of merges.

        So segments number at most fanout for each power of it in documents, and
        a document is rewritten once for each. Readers keep the old segments,
        which go after grace_s seconds.
        """
        with self._writer():
            done = 0
            while tier := self._crowded(fanout):
                self._replace([s["name"] for s in tier], sorted(x for s in tier for x in s["batches"]))
                done += 1
            self._vacuum(grace_s)
            return done

    def _crowded(self, fanout: int) -> list[dict]:
        tiers: dict[int, list[dict]] = {}
        for s in self._head["segments"]:
            tiers.setdefault(int(math.log(max(1, s["documents"]), fanout) + 1e-9), []).append(s)
        return next((tiers[t][:fanout] for t in sorted(tiers) if len(tiers[t]) >= fanout), [])

    def _replace(self, names: list[str], batches: list[list[int]], without: int | None = None, **commit) -> None:
        """Puts one merged segment in place of several, or none where nothing is left."""
        kept = [s for s in self._head["segments"] if s["name"] not in names]
        if without is not None:
            batches = [x for a, b in batches for x in ([[a, b]] if not a <= without <= b else [[a, without - 1], [without + 1, b]]) if x[0] <= x[1]]
        if batches:
            name = f"merged={uuid.uuid4().hex}"
            index.merge_segments(self.spark, self.root, names, name, without)
            joined: list[list[int]] = []
            for a, b in batches:
                joined = [*joined[:-1], [joined[-1][0], b]] if joined and joined[-1][1] + 1 == a else [*joined, [a, b]]
            kept.append(self._described(name, joined))
        retired = self._head["retired"] + [[n, int(time.time())] for n in names]
        self._commit(commit.get("rows", self.spark.createDataFrame([], schemas.BATCH)), commit.get("archives", self._none()), segments=kept, retired=retired, **commit.get("changes", {}))

    def _vacuum(self, grace_s: int) -> None:
        old = [n for n, at in self._head["retired"] if at <= time.time() - grace_s]
        for n in old:
            for path in (*[f"{self.root}/{t}/{n}" for t in index.TABLES], f"{self.root}/segments/{n}.json"):
                p, fs = self._fs(path)
                fs.delete(p, True)
        if old:
            self._commit(self.spark.createDataFrame([], schemas.BATCH), self._none(), retired=[x for x in self._head["retired"] if x[0] not in old])

    def recover(self) -> None:
        """Reconciles batches that a crash left half done: what was parsed in part goes, what was built whole is published, the rest is built again."""
        with self._writer():
            open_ = {int(b): r["state"] for b, r in self._head["open"].items() if r["state"] in ("PARSING", "BUILDING")}
            built = [b for b, s in open_.items() if s == "BUILDING" and all(self._fs("x")[1].exists(self._fs(f"{self.root}/{t}/batch_id={b}/_SUCCESS")[0]) for t in index.TABLES)]
            sound = [b for b in built if self._sound(b)]
            for b in sound:
                self._publish(b)
            for b in open_:
                if b not in sound:
                    row = state.recover(self._row(b), built, sound)
                    self._move(b, row, done=row.first()["state"] == "FAILED")
                    self._drop(b, index.TABLES if open_[b] == "BUILDING" else ("parsed", "outcomes", "scan"))

    def rebuild(self, archive_id: int) -> bool:
        """Invalidates the batch of an archive: its documents leave the segment that holds them, its archives wait again; False for an unknown archive."""
        with self._writer():
            batches, archives = self.tables()
            hit = archives.where(F.col("archive_id") == archive_id).first()
            if hit is None:
                return False
            b = hit["batch_id"]
            rows, held = state.request_rebuild(batches.where(F.col("batch_id") == b), archives.where(F.col("batch_id") == b), archive_id)
            held = self.spark.createDataFrame(held.collect(), held.schema)
            segment = self._segment_of(b)
            changes = {"pending": sorted({*self._head["pending"], *[r["archive_id"] for r in held.collect()]}), "open": {k: v for k, v in self._head["open"].items() if k != str(b)}}
            if segment:
                self._replace([segment["name"]], segment["batches"], without=b, rows=rows, archives=held, changes=changes)
            else:
                self._commit(rows, held, **changes)
            self._drop(b, ("parsed", "outcomes", "scan"))
            return True

    def run(self, source: Callable[[], DataFrame], files: Archive | DataFrame, profiles: Callable[[], DataFrame], cycles: int | None = None, poll_s: float = 1.0, max_files: int = MAX_FILES, max_documents: int = MAX_DOCUMENTS) -> int:
        """The polling loop: each cycle scans once, builds what is parsed and merges what has become crowded, then waits if there was nothing. Returns the batches built."""
        self.recover()
        done = 0
        while cycles is None or cycles > 0:
            scanned = self.scan_once(source(), files, profiles(), max_files, max_documents)["batch_id"]
            built = 0
            while self.build_next(files) is not None:
                built += 1
            if built:
                self.compact()
            done += built
            cycles = None if cycles is None else cycles - 1
            if not built and scanned is None and (cycles is None or cycles > 0):
                time.sleep(poll_s)
        return done

    def engine(self, digests: bool = False) -> search.SearchEngine:
        """The segments as they are now; without one, an engine that finds nothing. A segment whose files are not those that were published, by their sizes or also their digests, raises DamagedSegment."""
        segments = self.head()["segments"]
        for s in segments:
            if bad := self.damaged(s, digests):
                raise DamagedSegment(f"{s['name']}: {', '.join(bad)}")
        names = [s["name"] for s in segments]
        t = {n: index.load(self.spark, self.root, n, names) for n in ("documents", "postings", "stats", "terms", "blocks")}
        return search.SearchEngine(t["documents"], t["postings"], t["stats"], t["terms"], [b for s in segments for _, b in s["batches"]], t["blocks"])

    def files(self) -> DataFrame:
        """Files of the segments, for details."""
        return index.load(self.spark, self.root, "files", [s["name"] for s in self.head()["segments"]])

    def orphans(self) -> list[str]:
        """Segments on disk that the log knows nothing of."""
        h = self.head()
        known = {s["name"] for s in h["segments"]} | {n for n, _ in h["retired"]} | {f"batch_id={b}" for b in h["open"]}
        p, fs = self._fs(f"{self.root}/documents")
        on_disk = {s.getPath().getName() for s in fs.listStatus(p)} if fs.exists(p) else set()
        return sorted(on_disk - known)
