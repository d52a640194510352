"""The engine as a whole: roots, incremental indexing, hybrid search and status."""

from __future__ import annotations

import argparse
import contextlib
import json
import os
import sys
import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill import __version__, schema
from lexmill.functions import text as tx
from lexmill.operators import chunking, incremental, search, vectors
from lexmill.operators.numbering import written
from lexmill.sources import folder
from lexmill.sources.store import Conflict, IndexStore, Snapshot


#: Runs that are tried anew when another writer rebuilt the index meanwhile.
RETRIES = 3
#: Before the root's id: the key of what a stream has committed last.
STREAM = "stream:"


#: Files that are read between two commits, and seconds between two questions whether a run is cancelled.
ROUND_FILES, POLL_SECONDS = 100_000, 0.2


class Cancelled(Exception):
    """A run was cancelled while its jobs were running."""


def _now() -> str:
    return datetime.now(UTC).isoformat(timespec="seconds")


class LexmillError(Exception):
    """What a user did wrong; the command line exits with 2."""


#: The embedders that can be chosen; a real model is added under the same protocol.
EMBEDDERS = {vectors.HashEmbedder.model_id: vectors.HashEmbedder}


@dataclass
class Settings:
    roots: list[dict] = field(default_factory=list)
    embedding_model: str = vectors.HashEmbedder.model_id
    max_file_bytes: int = folder.MAX_FILE_BYTES
    extra_excludes: list[str] = field(default_factory=list)

    def find_root(self, key: str) -> dict:
        for root in self.roots:
            if key in (root["id"], root["path"]) or os.path.normpath(key) == root["path"]:
                return root
        raise LexmillError(f"unknown root: {key}")


class Lexmill:
    """One data directory: settings.json and the index."""

    VERSION = 1

    def __init__(self, spark: SparkSession, data_dir: str, config: chunking.ChunkConfig = chunking.ChunkConfig()) -> None:
        self.spark, self.data_dir, self.config = spark, Path(data_dir), config
        self.settings = self._load()

    # -- settings

    def _load(self) -> Settings:
        path = self.data_dir / "settings.json"
        if not path.exists():
            return Settings()
        held = json.loads(path.read_text())
        if held.pop("version", None) != self.VERSION:
            raise LexmillError("settings of an unsupported version")
        return Settings(**held)

    def _save(self) -> None:
        self.data_dir.mkdir(parents=True, exist_ok=True)
        new = self.data_dir / "settings.json.new"
        new.write_text(json.dumps({"version": self.VERSION, **vars(self.settings)}, sort_keys=True, indent=1))
        os.replace(new, self.data_dir / "settings.json")

    def add_root(self, path: str) -> dict:
        real = os.path.realpath(folder.checked_path(os.path.abspath(path)))
        if not os.path.isdir(real):
            raise LexmillError(f"not a directory: {path}")
        under = lambda a, b: a == b or a.startswith(b.rstrip("/") + "/")
        if under(real, str(self.data_dir.resolve())):
            raise LexmillError("the data directory cannot be indexed")
        for root in self.settings.roots:
            if under(real, root["path"]) or under(root["path"], real):
                raise LexmillError(f"{real} overlaps {root['path']}")
        import hashlib

        root = {"id": hashlib.sha256(real.encode()).hexdigest()[:12], "path": real, "added_at": datetime.now(UTC).isoformat(timespec="seconds")}
        self.settings.roots.append(root)
        self._save()
        return root

    def remove_root(self, key: str) -> None:
        self.settings.roots.remove(self.settings.find_root(key))
        self._save()

    def use_model(self, key: str) -> None:
        if key not in EMBEDDERS:
            raise LexmillError(f"unknown model: {key}")
        self.settings.embedding_model = key
        self._save()

    # -- parts

    @property
    def embedder(self) -> vectors.Embedder:
        return EMBEDDERS[self.settings.embedding_model]()

    @property
    def store(self) -> IndexStore:
        return IndexStore(self.spark, str(self.data_dir / "index"), self.embedder.dim)

    def _identity(self) -> dict:
        e = self.embedder
        return {"chunker": schema.CHUNKER_VERSION, "chunks": [self.config.max_chars, self.config.min_chars], "dim": e.dim, "model": e.model_id, "schema": schema.SCHEMA_VERSION}

    # -- indexing

    def index(self, root_keys: list[str] | None = None, full: bool = False, progress: Callable[[str, int], None] | None = None, cancelled: Callable[[], bool] | None = None) -> dict:
        """Bring the index up to date; returns the counters of the run.

        ``progress`` is told each step and how many files it has.  ``cancelled`` is asked all the while, from another
        thread: once it says so, jobs that read files are stopped within their tasks; what was read in full
        rounds (``ROUND_FILES``) is committed, nothing more is read and nothing is deleted."""
        chosen = [self.settings.find_root(k) for k in root_keys] if root_keys else self.settings.roots
        store, tell, stop = self.store, progress or (lambda step, n: None), cancelled or (lambda: False)
        for attempt in range(RETRIES):
            base = store.current()
            rebuild = full or base.identity != self._identity()
            if not chosen or stop():
                return {"indexed": 0, "unchanged": 0, "removed": 0, "unreadable": 0, "chunks": 0, "full_rebuild": rebuild}
            work = store.working_folder()
            try:
                return self._index(store, base, chosen, rebuild, work, tell, stop)
            except Conflict:  # another writer rebuilt the index meanwhile
                if attempt == RETRIES - 1:
                    raise
            finally:
                store.discard(work)

    def _index(self, store: IndexStore, base: Snapshot, chosen: list[dict], rebuild: bool, work: str, tell: Callable[[str, int], None], stop: Callable[[], bool]) -> dict:
        manifest = store.read("manifest", base).limit(0) if rebuild else store.read("manifest", base)
        configured = self._root_ids(base)
        scans = [folder.scan(self.spark, r["path"], r["id"], self.settings.max_file_bytes, self.settings.extra_excludes, [str(self.data_dir.resolve())], work) for r in chosen]
        listing = reduce(DataFrame.unionByName, scans)
        wanted = written(listing.filter(F.col("skip_reason").isNull()).select("root_id", "rel_path", "abs_path", "size", "mtime_ns", "language"), work)
        tell("listed", wanted.count())
        recorded = manifest.filter(F.col("root_id").isin([r["id"] for r in chosen]))
        state = written(incremental.classify(wanted, recorded), work)
        # Contents are read only of what the join says may have changed.
        file_id = tx.stable_id(F.col("root_id"), F.col("rel_path")).alias("file_id")
        to_read = state.filter(F.col("status").isin("new", "candidate")).join(wanted.select(*incremental.FILE_KEY, "abs_path", "language"), incremental.FILE_KEY).withColumn("file_id", file_id)
        to_read = written(to_read, work)
        rounds = max(1, -(-to_read.count() // ROUND_FILES))
        gone = state.filter(F.col("status") == "removed").select(file_id)
        ended = gone.union(manifest.filter(~F.col("root_id").isin(configured)).select("file_id")).distinct()
        settled = state.filter(F.col("status").isin("unchanged", "removed")).select("status", F.lit(None).cast("long").alias("n_chunks"))
        total, n_read, snapshot = incremental.report(settled).first().asDict(), 0, base
        for i in range(rounds):
            mine = to_read.filter(F.pmod(F.xxhash64("file_id"), F.lit(rounds)) == i)
            segment = store.new_segment()
            try:
                with self._stopping(stop):
                    read = written(incremental.settle(folder.read_files(mine, self.settings.max_file_bytes)), work)
                    n_read += read.count()
                    tell("read", n_read)
                    chunks = store.write(segment, "chunks", self._chunks(read.filter(F.col("outcome") == "indexed")))
                    tell("chunked", chunks.count())
            except Cancelled:
                return total | {"removed": 0, "full_rebuild": rebuild}
            complete = i == rounds - 1 and not stop()
            done = read.filter(F.col("outcome") != "error").join(chunks.groupBy("file_id").agg(F.count("*").alias("n_chunks")), "file_id", "left")
            own = incremental.report(done.select(F.col("outcome").alias("status"), "n_chunks")).first().asDict()
            total = {k: v + own[k] for k, v in total.items()}
            records = store.write(segment, "manifest", self._records(done))
            replaced = read.filter(F.col("outcome").isin("indexed", "unreadable")).select("file_id")
            dropped = ended if complete else ended.limit(0)
            # A file's record and content end with whatever this run has of it, also where it is new: another writer may have it, too.
            tombstones = records.select("file_id").union(dropped).withColumn("what", F.lit("record")).union(replaced.union(dropped).withColumn("what", F.lit("content")))
            tombstones = store.write(segment, "tombstones", tombstones)
            if (rebuild and i == 0) or not tombstones.isEmpty():
                snapshot = self._finish(store, snapshot, segment, chunks, {"indexed_at": _now()}, rebuild and i == 0)
                tell("committed", snapshot.number)
            if not complete and stop():
                return total | {"removed": 0, "full_rebuild": rebuild}
        return total | {"full_rebuild": rebuild}

    @staticmethod
    def _records(done: DataFrame) -> DataFrame:
        """Manifest rows of files that were read; a touched one keeps its status and its chunks."""
        touched = F.col("outcome") == "touched"
        return done.select(
            "root_id", "rel_path", "file_id", "content_hash", "language", F.when(touched, F.col("old_status")).otherwise(F.col("outcome")).alias("status"), F.lit(_now()).alias("indexed_at"),
            "size", "mtime_ns", F.when(touched, F.col("old_chunk_count")).otherwise(F.coalesce("n_chunks", F.lit(0))).cast("long").alias("chunk_count"),
        )

    @contextlib.contextmanager
    def _stopping(self, stop: Callable[[], bool]):
        """Jobs that are run inside bear a tag, and are cancelled as soon as ``stop`` says so; then ``Cancelled`` is raised."""
        context, tag, over, asked = self.spark.sparkContext, f"lexmill-{uuid.uuid4().hex}", threading.Event(), threading.Event()

        def watch() -> None:
            while not over.wait(POLL_SECONDS):
                if stop():
                    asked.set()
                    context.cancelJobsWithTag(tag)  # again and again: another job may have begun meanwhile

        watcher = threading.Thread(target=watch, daemon=True)
        context.addJobTag(tag)
        watcher.start()
        try:
            yield
        except Exception as error:
            if asked.is_set():
                raise Cancelled from error
            raise
        finally:
            over.set()
            watcher.join()
            context.removeJobTag(tag)

    def _finish(self, store: IndexStore, base: Snapshot, segment: str, chunks: DataFrame, meta: dict, rebuild: bool) -> Snapshot:
        """Write the text index of a segment's chunks, commit the segment, and tidy up."""
        posted = search.postings(chunks, "id", "search_text", ("file_id", "root_id", "origin"))
        posted = store.write(segment, "postings", posted.repartitionByRange("term").sortWithinPartitions("term"))
        lengths = posted.groupBy("file_id", "id").agg(F.max("dl").alias("dl"))
        store.write(segment, "sizes", lengths.groupBy("file_id").agg(F.count("*").alias("n"), F.sum("dl").alias("terms")))
        snapshot = store.commit(base, segment, self._identity(), meta, rebuild)
        store.compact()
        store.expire()
        return snapshot

    def ingest(self, documents: DataFrame, root_id: str, meta: dict | None = None) -> Snapshot:
        """Put documents (rel_path, language, text, deleted, version) in the place of what the index has of them.

        Of a document that occurs several times the one of the highest version counts (of equals the
        larger text); one that is deleted, or has no text, ends what was there.  ``meta`` is committed in the same step."""
        store = self.store
        base = store.current()
        rebuild = base.identity != self._identity()
        now = _now()
        latest = documents.groupBy("rel_path").agg(F.max_by(F.struct("language", "text", "deleted"), F.struct("version", F.coalesce("text", F.lit("")))).alias("latest"))
        work = store.working_folder()
        try:
            rows = latest.select(F.lit(root_id).alias("root_id"), "rel_path", "latest.*").withColumn("file_id", tx.stable_id(F.col("root_id"), F.col("rel_path")))
            rows = written(rows.withColumn("live", F.col("text").isNotNull() & ~F.coalesce("deleted", F.lit(False))), work)
            segment, live = store.new_segment(), rows.filter("live")
            chunks = store.write(segment, "chunks", self._chunks(live))
            counts = chunks.groupBy("file_id").agg(F.count("*").alias("n_chunks"))
            store.write(segment, "manifest", live.join(counts, "file_id", "left").select(
                "root_id", "rel_path", "file_id", F.sha2("text", 256).alias("content_hash"), "language", F.lit("indexed").alias("status"), F.lit(now).alias("indexed_at"),
                F.octet_length("text").cast("long").alias("size"), F.lit(None).cast("long").alias("mtime_ns"), F.coalesce("n_chunks", F.lit(0).cast("long")).alias("chunk_count"),
            ))
            store.write(segment, "tombstones", rows.select("file_id", F.explode(F.array(F.lit("record"), F.lit("content"))).alias("what")))
            return self._finish(store, base, segment, chunks, {"indexed_at": now, f"{STREAM}{root_id}": "-1"} | (meta or {}), rebuild)
        finally:
            store.discard(work)

    def _root_ids(self, snapshot: Snapshot) -> list[str]:
        """Configured roots, and those that streams keep."""
        return [r["id"] for r in self.settings.roots] + [k.removeprefix(STREAM) for k in snapshot.meta if k.startswith(STREAM)]

    def _chunks(self, files: DataFrame) -> DataFrame:
        cut = chunking.chunk_documents(files, "file_id", self.config, ("root_id", "rel_path", "language"))
        rows = cut.withColumn("origin", F.lit("code")).withColumn("id", tx.chunk_id(F.col("file_id"), F.col("ordinal")))
        rows = rows.withColumn("search_text", tx.search_text(F.col("rel_path"), F.col("symbol"), F.col("text")))
        embedded = vectors.embedding_column(tx.embedding_text(F.col("rel_path"), F.col("symbol"), F.col("text")), self.embedder)
        return rows.withColumn("vector", embedded).select(*schema.CHUNKS.fieldNames())

    # -- searching

    def search(self, query: str, limit: int = search.LIMIT, origin: str | None = None, root_ids: list[str] | None = None) -> DataFrame:
        """Search hits, best first; empty (with the hits' schema) for a blank query or an empty scope."""
        store, where = self.store, search.origin_is(origin)
        snapshot = store.current()  # what is read below stays as it is, whatever is committed meanwhile
        allowed = self._root_ids(snapshot)
        scope = [r for r in (root_ids or allowed) if r in allowed]
        names = schema.SEARCH_HIT.fieldNames()
        if not query.strip() or not scope:
            return self.spark.createDataFrame([], schema.SEARCH_HIT)
        store.check_dim()
        condition = F.col("root_id").isin(scope) if where is None else F.col("root_id").isin(scope) & where
        chunks = store.read("chunks", snapshot)
        vector = [float(x) for x in self.embedder.embed_query(query)]
        index = (store.read("postings", snapshot), store.corpus_stats(snapshot))
        found = search.hybrid(chunks, vector, query, limit=limit, where=condition, index=index)
        return search.hits(chunks, found).select(*names)

    def status(self) -> dict:
        totals = incremental.totals(self.store.read("manifest")).first().asDict()
        return totals | {"roots": self.settings.roots, "model": self.settings.embedding_model}


# ---------------------------------------------------------------- command line


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="lexmill")
    parser.add_argument("--version", action="version", version=__version__)
    parser.add_argument("--data-dir", default=str(Path.home() / ".lexmill"))
    commands = parser.add_subparsers(dest="command", required=True)
    roots = commands.add_parser("roots").add_subparsers(dest="action", required=True)
    roots.add_parser("list")
    roots.add_parser("add").add_argument("path")
    roots.add_parser("remove").add_argument("key")
    index = commands.add_parser("index")
    index.add_argument("--root", action="append")
    index.add_argument("--full", action="store_true")
    find = commands.add_parser("search")
    find.add_argument("query")
    find.add_argument("-k", "--limit", type=int, default=search.LIMIT)
    find.add_argument("--origin", choices=search.ORIGINS)
    find.add_argument("--json", action="store_true")
    models = commands.add_parser("models").add_subparsers(dest="action", required=True)
    models.add_parser("list")
    models.add_parser("use").add_argument("key")
    commands.add_parser("status")
    return parser


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = _parser().parse_args(argv)
    try:
        app = Lexmill(spark or SparkSession.builder.appName("lexmill").getOrCreate(), args.data_dir)
        if args.command == "roots":
            if args.action == "add":
                print(app.add_root(args.path)["id"])
            elif args.action == "remove":
                app.remove_root(args.key)
            else:
                for root in app.settings.roots:
                    print(root["id"], root["path"])
        elif args.command == "index":
            print(json.dumps(app.index(args.root, args.full)))
        elif args.command == "models":
            if args.action == "use":
                app.use_model(args.key)
            for key in EMBEDDERS:
                print("*" if key == app.settings.embedding_model else " ", key)
        elif args.command == "status":
            print(json.dumps(app.status()))
        else:
            paths = {r["id"]: r["path"] for r in app.settings.roots}
            for hit in app.search(args.query, args.limit, args.origin).collect():
                row = hit.asDict() | {"path": f"{paths[hit.root_id]}/{hit.rel_path}"}
                if args.json:
                    print(json.dumps(row, ensure_ascii=False))
                else:
                    print(f"{row['path']}:{hit.start_line}-{hit.end_line} {hit.symbol} {hit.score:.4f}")
                    print("\n".join(line[:110] for line in hit.text.split("\n")[:4]))
        return 0
    except (LexmillError, ValueError) as error:
        print(f"error: {error}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
