"""The index as Parquet segments behind numbered snapshots.

A run writes one new segment: rows of the files it indexed, and tombstones for the files whose
earlier rows end with it.  It costs what changed, whatever the size of the index.  A snapshot is a small
file that names the live segments in order; a row counts unless a later segment has a tombstone
of its file (merge on read).  ``compact`` merges neighbours of one size class, so there are few segments, each
row is rewritten a logarithmic number of times, and the dead rows go.

Snapshots are numbered, and number ``n + 1`` can be created once (create if absent): of two writers the
second sees the first one's snapshot, puts its own segment behind that, and tries again.  Every file
that a segment holds has a tombstone in it, so of a file that both wrote only the later rows count.
A rebuild, or a commit over one, cannot be put together like that and raises ``Conflict``: run again.

Readers hold a snapshot's folders: nothing of them changes.  ``expire`` removes snapshots that were
superseded some time ago, and folders that no snapshot names and that are as old.

Tables of a segment: chunks, postings (sorted by term), manifest, sizes (the posted chunks and
terms of each file) and tombstones.  The corpus's totals and the key-value pairs are in the snapshot.
"""

from __future__ import annotations

import json
import math
import os
import time
import uuid
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill import schema

SNAPSHOTS, SEGMENTS = "_snapshots", "segments"
#: Neighbours of one size class that are merged, the ratio of classes, and the smallest class.
FAN_IN, RATIO, SMALLEST = 4, 4, 1 << 20
#: Tombstones up to this number are broadcast; more are joined by a shuffle.
MAX_BROADCAST = 500_000
RETAIN_SECONDS = 24 * 3600
ATTEMPTS = 20


class Conflict(Exception):
    """Another writer's commit cannot be put together with this one: run again."""


@dataclass
class Snapshot:
    number: int = 0
    identity: dict = field(default_factory=dict)
    #: Oldest first: name, tables, rows (of files), tombstones, bytes.
    segments: list[dict] = field(default_factory=list)
    n: int = 0  # chunks with terms
    terms: int = 0
    meta: dict = field(default_factory=dict)
    superseded: dict = field(default_factory=dict)  # when each older snapshot was, by number


class IndexStore:
    def __init__(self, spark: SparkSession, path: str, dim: int) -> None:
        self._spark, self._path, self._dim = spark, path.rstrip("/"), dim
        jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._at(self._path).getFileSystem(self._conf)

    # -- snapshots

    def current(self) -> Snapshot:
        """The latest snapshot; number 0, with nothing in it, where there is no index."""
        numbers = [int(n.split(".")[0]) for n, _ in self._listed(SNAPSHOTS) if n.endswith(".json")]
        return self.snapshot(max(numbers)) if numbers else Snapshot()

    def snapshot(self, number: int) -> Snapshot:
        stream = self._fs.open(self._at(f"{self._path}/{SNAPSHOTS}/{number:012d}.json"))
        try:
            return Snapshot(**json.loads(bytes(stream.readAllBytes()).decode()))
        finally:
            stream.close()

    def _listed(self, folder: str) -> list[tuple[str, float]]:
        """(name, seconds of the last change) of what is in a folder."""
        path = self._at(f"{self._path}/{folder}")
        if not self._fs.exists(path):
            return []
        return [(s.getPath().getName(), s.getModificationTime() / 1000) for s in self._fs.listStatus(path)]

    def _create(self, state: Snapshot) -> bool:
        """Create the snapshot's file if its number is not taken, in one step."""
        final = f"{self._path}/{SNAPSHOTS}/{state.number:012d}.json"
        new = f"{self._path}/{SNAPSHOTS}/_{uuid.uuid4().hex}"
        stream = self._fs.create(self._at(new))
        stream.write(json.dumps(asdict(state), sort_keys=True).encode())
        stream.close()
        local = self._fs.getScheme() == "file"
        plain = lambda p: self._at(p).toUri().getPath()
        try:
            if local:
                os.link(plain(new), plain(final))  # fails where the name is taken
            else:  # a rename without OVERWRITE does so, too
                jvm, gateway = self._spark.sparkContext._jvm, self._spark.sparkContext._gateway
                context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
                context.rename(context.makeQualified(self._at(new)), context.makeQualified(self._at(final)), gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
        except FileExistsError:
            return False
        except Exception:
            if self._fs.exists(self._at(final)):
                return False
            raise
        finally:
            self._fs.delete(self._at(new), False)
        return True

    def _succeed(self, old: Snapshot, new: Snapshot) -> bool:
        new.number = old.number + 1
        new.superseded = old.superseded | ({str(old.number): time.time()} if old.number else {})
        return self._create(new)

    # -- writing

    def working_folder(self) -> str:
        """A new folder for what a run writes on its way; ``discard`` it at the end."""
        return f"{self._path}/_work-{uuid.uuid4().hex}"

    def discard(self, folder: str) -> None:
        self._fs.delete(self._at(folder), True)

    def new_segment(self) -> str:
        return uuid.uuid4().hex

    def write(self, segment: str, name: str, rows: DataFrame) -> DataFrame:
        """Write a table of a segment that is not committed yet, and read it back."""
        shape = schema.TABLES[name]
        rows.select(*shape.fieldNames()).write.parquet(f"{self._path}/{SEGMENTS}/{segment}/{name}")
        return self._spark.read.schema(shape).parquet(f"{self._path}/{SEGMENTS}/{segment}/{name}")

    def _described(self, segment: str, rows: int, tombstones: int) -> dict:
        folder = self._at(f"{self._path}/{SEGMENTS}/{segment}")
        return {"name": segment, "tables": sorted(n for n, _ in self._listed(f"{SEGMENTS}/{segment}")), "rows": rows, "tombstones": tombstones, "bytes": self._fs.getContentSummary(folder).getLength()}

    def commit(self, base: Snapshot, segment: str, identity: dict, meta: dict | None = None, rebuild: bool = False) -> Snapshot:
        """Make a written segment part of the index.  ``base`` is the snapshot that the run read; with ``rebuild``
        nothing older stays."""
        count = lambda name: self._read(name, [segment]).count() if self._has(segment, name) else 0
        own = self._described(segment, count("manifest"), count("tombstones"))
        added = self._totals(self._read("sizes", [segment])) if "sizes" in own["tables"] else (0, 0)
        for _ in range(ATTEMPTS):
            old = self.current()
            if old.number != base.number and (rebuild or old.identity != base.identity):
                raise Conflict(f"snapshot {old.number} was written since {base.number}")
            if rebuild:
                new = Snapshot(0, identity, [own], *added, meta or {})
            else:
                ended = self._ended(old, segment) if own["tombstones"] and old.segments else (0, 0)
                new = Snapshot(0, identity, [*old.segments, own], old.n + added[0] - ended[0], old.terms + added[1] - ended[1], old.meta | (meta or {}))
            if self._succeed(old, new):
                return new
        raise Conflict(f"{ATTEMPTS} other writers were faster")

    def _has(self, segment: str, name: str) -> bool:
        return self._fs.exists(self._at(f"{self._path}/{SEGMENTS}/{segment}/{name}"))

    @staticmethod
    def _totals(sizes: DataFrame) -> tuple[int, int]:
        row = sizes.agg(F.sum("n"), F.sum("terms")).first()
        return row[0] or 0, row[1] or 0

    def _ended(self, state: Snapshot, segment: str) -> tuple[int, int]:
        """Totals of the live rows that a segment's tombstones end."""
        marked = self._read("tombstones", [segment]).filter(F.col("what") == "content").select("file_id").distinct()
        return self._totals(self.read("sizes", state).join(marked, "file_id", "left_semi"))

    def compact(self) -> Snapshot:
        """Merge neighbouring segments of one size class until no ``FAN_IN`` of them are left."""
        while True:
            old = self.current()
            run = _to_merge(old.segments)
            if not run:
                return old
            first, last = run
            merged, segment, oldest = old.segments[first:last], self.new_segment(), first == 0
            names = {n for s in merged for n in s["tables"]} - {"tombstones"}
            for name in sorted(names):
                rows = self.read(name, old, range(first, last))
                self.write(segment, name, _laid_out(rows, name, sum(s["bytes"] for s in merged)))
            tombstones = 0
            if not oldest:  # they still end rows of older segments
                rows = self._read("tombstones", [s["name"] for s in merged if "tombstones" in s["tables"]]).distinct()
                tombstones = self.write(segment, "tombstones", rows).count()
            own = self._described(segment, self._read("manifest", [segment]).count() if "manifest" in names else 0, tombstones)
            for _ in range(ATTEMPTS):
                now = self.current()
                places = [i for i, s in enumerate(now.segments) if s["name"] in {m["name"] for m in merged}]
                if [now.segments[i]["name"] for i in places] != [m["name"] for m in merged]:
                    break  # another writer has merged or rebuilt: begin anew
                segments = [*now.segments[: places[0]], own, *now.segments[places[-1] + 1 :]]
                if self._succeed(now, Snapshot(0, now.identity, segments, now.n, now.terms, now.meta)):
                    break

    def expire(self, seconds: float = RETAIN_SECONDS) -> int:
        """Remove snapshots that were superseded so long ago, and folders as old that none of the others name.
        Returns the number of folders that went."""
        latest, limit = self.current(), time.time() - seconds
        if not latest.number:
            return 0
        numbers = [int(n.split(".")[0]) for n, _ in self._listed(SNAPSHOTS) if n.endswith(".json")]
        gone = [n for n in numbers if latest.superseded.get(str(n), math.inf) < limit]
        held = {s["name"] for n in numbers if n not in gone for s in self.snapshot(n).segments}
        for n in gone:
            self._fs.delete(self._at(f"{self._path}/{SNAPSHOTS}/{n:012d}.json"), False)
        # What a run is still writing is younger; where a run failed, its folders go like any other.
        old = [f"{SEGMENTS}/{n}" for n, changed in self._listed(SEGMENTS) if n not in held and changed < limit] + [n for n, changed in self._listed("") if n.startswith("_work-") and changed < limit]
        for name in old:
            self._fs.delete(self._at(f"{self._path}/{name}"), True)
        return len(old)

    def truncate(self) -> Snapshot:
        """An index of the same identity without rows; readers of older snapshots keep theirs."""
        for _ in range(ATTEMPTS):
            old = self.current()
            if self._succeed(old, Snapshot(0, old.identity, [], 0, 0, old.meta)):
                return self.current()
        raise Conflict(f"{ATTEMPTS} other writers were faster")

    def drop(self) -> None:
        self._fs.delete(self._at(self._path), True)

    # -- reading

    def _read(self, name: str, segments: list[str]) -> DataFrame:
        shape = schema.TABLES[name]
        if not segments:
            return self._spark.createDataFrame([], shape)
        return self._spark.read.schema(shape).parquet(*(f"{self._path}/{SEGMENTS}/{s}/{name}" for s in segments)).select(*shape.fieldNames())

    def read(self, name: str, state: Snapshot | None = None, places: range | None = None) -> DataFrame:
        """The live rows of a table (or of those of some segments), empty with its schema where there are none.

        A tombstone of a segment ends rows of the segments before it.  Only segments with a later tombstone are
        joined with them."""
        state = state or self.current()
        if name == "meta":
            return self._spark.createDataFrame(sorted(state.meta.items()), schema.META)
        chosen = [i for i in (places or range(len(state.segments))) if name in state.segments[i]["tables"]]
        last = max((i for i, s in enumerate(state.segments) if s["tombstones"]), default=-1)
        clean = self._read(name, [state.segments[i]["name"] for i in chosen if i >= last])
        marked = [i for i in chosen if i < last]
        if not marked:
            return clean
        numbered = lambda table, own: reduce(DataFrame.unionByName, (self._read(table, [state.segments[i]["name"]]).withColumn("_at", F.lit(i)) for i in own))
        enders = [i for i, s in enumerate(state.segments) if s["tombstones"] and i > marked[0]]
        what = "record" if name == "manifest" else "content"
        ended = numbered("tombstones", enders).filter(F.col("what") == what).groupBy("file_id").agg(F.max("_at").alias("_ended"))
        if sum(state.segments[i]["tombstones"] for i in enders) <= MAX_BROADCAST:
            ended = F.broadcast(ended)
        live = numbered(name, marked).join(ended, "file_id", "left").filter(F.col("_ended").isNull() | (F.col("_ended") <= F.col("_at")))
        return clean.unionByName(live.select(*schema.TABLES[name].fieldNames()))

    def corpus_stats(self, state: Snapshot | None = None) -> DataFrame:
        """One row: the number of chunks with terms, and their mean length."""
        state = state or self.current()
        return self._spark.createDataFrame([(state.n, state.terms / state.n if state.n else None)], "n long, avgdl double")

    def identity(self) -> dict:
        return self.current().identity

    def has_text_index(self) -> bool:
        return self.current().n > 0

    def check_dim(self) -> None:
        held = self.identity().get("dim", self._dim)
        if held != self._dim:
            raise ValueError(f"the index holds vectors of {held} dimensions, not {self._dim}")

    def get_meta(self, key: str) -> str | None:
        return self.current().meta.get(key)


def _laid_out(rows: DataFrame, name: str, size: int) -> DataFrame:
    """Files of some 128 MB; postings sorted by term, so that a query reads the row groups of its own terms."""
    files = max(1, size // (128 << 20))
    if name == "postings":
        return rows.repartitionByRange(files, "term").sortWithinPartitions("term")
    return rows.coalesce(files) if files < 200 else rows


def _class(size: int) -> int:
    return int(math.log(max(size, SMALLEST) / SMALLEST, RATIO))


def _to_merge(segments: list[dict]) -> tuple[int, int] | None:
    """(first, behind the last) of the segments to merge: the latest run of at least ``FAN_IN`` neighbours, none of
    a larger size class than the last one.  So each class keeps less than ``FAN_IN`` segments."""
    first = len(segments)
    while first and (first == len(segments) or _class(segments[first - 1]["bytes"]) <= _class(segments[-1]["bytes"])):
        first -= 1
    return (first, len(segments)) if len(segments) - first >= FAN_IN else None
