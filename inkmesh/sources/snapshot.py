"""A note store as Parquet with a log of commits.

A commit is one small JSON file ``commits/<n>.json`` that says where the tables
of version n lie; it is created only if it is not there yet, which is what makes
a version belong to one writer.  Data folders have new names and are never
written again, so what is read stays as it is.

A table is a *base*, in hash buckets of its key, and *changes* laid over it:
rows put and keys deleted, each change one folder.  A mutation writes only its
change, so what it costs to write grows with what it changes; a rename leaves
the notes' text where it is.  A read merges
the buckets that have changes, in which the last change of a key counts (of a
text, the last that holds it), and takes the others as they are.  ``compact`` writes the changed buckets anew.

Writers are optimistic: a mutation is built on the version it sees, and if
another writer takes the next one first, it is built again on that, with all
its checks.  All tables of a commit appear together or not at all.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkmesh.operators import ordinals, store
from inkmesh.schemas import LINKS, NOTES, SETTINGS

TABLES = {"notes": NOTES, "note_links": LINKS, "settings": SETTINGS}
KEYS = {"notes": ["id"], "note_links": ["source_note_id", "target_note_id"], "settings": ["key"]}
#: Long columns that a change may leave as they are.
LONG = {"notes": ["content"]}
BUCKETS = 32
#: Changed keys that are sent to all tasks of a merge; more are joined by a shuffle.
BROADCAST_KEYS = 200_000
#: Times that a mutation is built again after another writer was first.
RETRIES = 20


class Conflict(RuntimeError):
    """Other writers were first too often."""


@dataclass
class Change:
    """What a mutation does to one table: rows to put (by key) and keys to delete.

    Rows put need not have the ``LONG`` columns in ``keeps``; the rows with these keys, which exist, keep theirs.
    """

    puts: DataFrame | None = None
    deletes: DataFrame | None = None
    keeps: tuple[str, ...] = ()


def _bucket(name: str):
    return F.pmod(F.xxhash64(*KEYS[name]), F.lit(BUCKETS)).cast("int")


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


class Snapshot:
    """The tables of one version."""

    def __init__(self, spark: SparkSession, root: str, version: int, state: dict):
        self.spark, self.root, self.version, self.state = spark, root, version, state

    def read(self, name: str) -> DataFrame:
        schema, keys = TABLES[name], KEYS[name]
        columns = schema.fieldNames()
        table = self.state.get(name, {"base": [], "changes": []})
        changed = sorted({b for c in table["changes"] for b in c["buckets"]})
        load = lambda path, more=(): self.spark.read.schema(T.StructType([*schema, *more, T.StructField("bucket", T.IntegerType())])).parquet(f"{self.root}/data/{path}")
        base = [load(x["path"]).where(F.col("bucket").isin(x["buckets"])) for x in table["base"]]
        still = [b.where(~F.col("bucket").isin(changed)).select(*columns) for b in base]
        if not changed:
            return _union(still) if still else self.spark.createDataFrame([], schema)
        long = LONG.get(name, [])
        # a base row is a change before all others; each long column has the commit that last held it
        told = lambda rows, commit, keeps: rows.withColumns({"__commit": F.lit(commit), **{f"__held_{c}": F.lit(None if c in keeps else commit).cast("int") for c in long}})
        log = _union([told(load(c["path"], [T.StructField("gone", T.BooleanType())]), c["commit"], c.get("keeps", [])) for c in table["changes"]])
        merged = [b.where(F.col("bucket").isin(changed)) for b in base]
        if sum(c["rows"] for c in table["changes"]) <= BROADCAST_KEYS:
            taken = F.broadcast(log.select(*keys).distinct())
            still += [b.join(taken, keys, "left_anti").select(*columns) for b in merged]
            merged = [b.join(taken, keys, "left_semi") for b in merged]
        met = _union([log, *[told(b.withColumn("gone", F.lit(False)), 0, []) for b in merged]])
        short = [c for c in columns if c not in keys and c not in long]
        last = met.groupBy(*keys).agg(F.max_by(F.struct("gone", *short), "__commit").alias("r"), *[F.max_by(c, f"__held_{c}").alias(c) for c in long])
        put = last.where("not r.gone").select(*[F.col(f"r.{c}").alias(c) if c in short else F.col(c) for c in columns])
        return _union([*still, put])


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # --- commits ------------------------------------------------------------

    def _jvm(self):
        return self.spark.sparkContext._jvm

    def _fs(self, path: str):
        p = self._jvm().org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _create(self, path: str, text: str) -> bool:
        """Writes a whole new file, unless there is one of that name: then False.

        The text is first written under another name.  On a local disk a hard
        link gives it its own, elsewhere a rename that does not overwrite (atomic
        on HDFS; an object store needs a file system with such renames).
        """
        fs, target = self._fs(path)
        _, temporary = self._fs(f"{self.root}/commits/_{uuid.uuid4().hex}")
        out = fs.create(temporary, False)
        out.write(bytearray(text.encode()))
        out.close()
        try:
            if fs.getUri().getScheme() == "file":
                paths = self._jvm().java.nio.file.Paths
                local = lambda p: paths.get(p.toUri().getPath(), self.spark.sparkContext._gateway.new_array(self._jvm().java.lang.String, 0))
                self._jvm().java.nio.file.Files.createLink(local(target), local(temporary))
            else:
                context = self._jvm().org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
                context.rename(temporary, target, self.spark.sparkContext._gateway.new_array(self._jvm().org.apache.hadoop.fs.Options.Rename, 0))
        except Exception:
            if fs.exists(target):
                return False
            raise
        finally:
            fs.delete(temporary, False)
        return True

    def version(self) -> int:
        """The version last committed, 0 for none."""
        fs, path = self._fs(f"{self.root}/commits")
        if not fs.exists(path):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def snapshot(self, version: int | None = None) -> Snapshot:
        v = self.version() if version is None else version
        state: dict = {}
        if v:
            fs, path = self._fs(f"{self.root}/commits/{v}.json")
            stream = self._jvm().org.apache.commons.io.IOUtils.toString(fs.open(path), "UTF-8")
            state = json.loads(stream)
        return Snapshot(self.spark, self.root, v, state)

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A table of the last (or a given) version; empty if nothing is committed yet."""
        return self.snapshot(version).read(name)

    def _written(self, rows: DataFrame, name: str) -> tuple[str, list[int], int]:
        """Writes rows in buckets to a new folder: its name, the buckets, and how many rows."""
        path = f"{name}-{uuid.uuid4().hex}"
        at = rows.withColumn("bucket", _bucket(name))
        # a bucket of small changes is one file, a large one is split
        at.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.root}/data/{path}")
        # read from the footers, not from the plan
        counts = self.spark.read.schema(at.schema).parquet(f"{self.root}/data/{path}").groupBy("bucket").count().collect()  # a row for a bucket
        return path, sorted(r["bucket"] for r in counts), sum(r["count"] for r in counts)

    def _drop(self, path: str) -> None:
        fs, p = self._fs(f"{self.root}/data/{path}")
        fs.delete(p, True)

    def commit(self, build: Callable[[Snapshot], dict[str, Change]], retries: int = RETRIES) -> int:
        """Commits what ``build`` makes of the last version; it is built again if another writer is first.

        ``build`` raises to give up; then nothing is committed.  A build without changes makes no version.
        """
        for _ in range(retries + 1):
            seen = self.snapshot()
            state, paths, new = json.loads(json.dumps(seen.state)), [], seen.version + 1
            for name, change in build(seen).items():
                columns = TABLES[name].fieldNames()
                rows = []
                if change.puts is not None:
                    kept = {c: F.lit(None).cast(TABLES[name][c].dataType) for c in change.keeps}
                    rows.append(change.puts.withColumns(kept).select(*columns, F.lit(False).alias("gone")))
                if change.deletes is not None:
                    gone = change.deletes.select(*KEYS[name]).distinct()
                    rows.append(gone.select(*[F.col(c) if c in KEYS[name] else F.lit(None).cast(TABLES[name][c].dataType).alias(c) for c in columns], F.lit(True).alias("gone")))
                path, buckets, n = self._written(_union(rows), name)
                paths.append(path)
                if n:
                    state.setdefault(name, {"base": [], "changes": []})["changes"].append({"path": path, "buckets": buckets, "rows": n, "commit": new, "keeps": list(change.keeps)})
            if state == seen.state:
                for path in paths:
                    self._drop(path)
                return seen.version
            if self._create(f"{self.root}/commits/{new}.json", json.dumps(state)):
                return new
            for path in paths:
                self._drop(path)
        raise Conflict(f"version {new} went to another writer")

    def publish(self, **tables: DataFrame) -> int:
        """Commits the given tables in whole (others are carried over)."""
        written = {name: self._written(df.select(*TABLES[name].fieldNames()), name) for name, df in tables.items()}
        for _ in range(RETRIES + 1):
            seen = self.snapshot()
            state = seen.state | {name: {"base": [{"path": path, "buckets": buckets}] if n else [], "changes": []} for name, (path, buckets, n) in written.items()}
            if self._create(f"{self.root}/commits/{seen.version + 1}.json", json.dumps(state)):
                return seen.version + 1
        raise Conflict("the next version went to another writer")

    def compact(self, name: str) -> int:
        """Writes the changed buckets of a table anew, merged, and commits that.

        If another writer is first nothing is committed, for the merge would undo
        its change; the version seen is returned, and a later call may try again.
        """
        seen = self.snapshot()
        table = seen.state.get(name, {"changes": []})
        changed = sorted({b for c in table["changes"] for b in c["buckets"]})
        if not changed:
            return seen.version
        path, buckets, _ = self._written(seen.read(name).where(_bucket(name).isin(changed)), name)
        kept = [{"path": x["path"], "buckets": [b for b in x["buckets"] if b not in changed]} for x in table["base"]]
        base = [x for x in kept if x["buckets"]] + ([{"path": path, "buckets": buckets}] if buckets else [])
        state = seen.state | {name: {"base": base, "changes": []}}
        if self._create(f"{self.root}/commits/{seen.version + 1}.json", json.dumps(state)):
            return seen.version + 1
        self._drop(path)
        return seen.version

    # --- mutations ----------------------------------------------------------

    def insert_notes(self, new: DataFrame) -> int:
        """Appends rows (id, title, content, category, ts, pos), numbered without gaps; an id that exists or repeats raises."""

        def build(now: Snapshot) -> dict[str, Change]:
            notes = now.read("notes")
            if store.clashing_ids(notes, new).limit(1).count():
                raise ValueError("a note with this id exists")
            last = notes.agg(F.coalesce(F.max("seq"), F.lit(-1))).first()[0]
            rows = ordinals.numbered(new, ["pos", "id"], "seq", start=last + 1)
            return {"notes": Change(rows.withColumns({"created_at": F.col("ts"), "updated_at": F.col("ts"), "seq": F.col("seq").cast("long")}))}

        return self.commit(build)

    def _touched(self, now: Snapshot, ids: DataFrame) -> DataFrame:
        return now.read("notes").join(ids.select("id").distinct(), "id", "left_semi").select(*NOTES.fieldNames())

    def update_notes(self, patch: DataFrame) -> int:
        return self.commit(lambda now: {"notes": Change(store.update_notes(self._touched(now, patch), patch))})

    def rename_notes(self, renames: DataFrame) -> int:
        return self.commit(lambda now: {"notes": Change(store.rename_notes(self._touched(now, renames).drop("content"), renames), keeps=("content",))})

    def _without(self, now: Snapshot, gone: DataFrame) -> dict[str, Change]:
        """Deletes notes, and the links that touch them."""
        links, ids = now.read("note_links"), gone.select("id")
        at = [links.join(ids.withColumnRenamed("id", end), end, "left_semi").select(*store.END) for end in store.END]
        return {"notes": Change(deletes=ids), "note_links": Change(deletes=_union(at))}

    def delete_notes(self, ids: DataFrame) -> int:
        return self.commit(lambda now: self._without(now, self._touched(now, ids)))

    def delete_category(self, name: str) -> int:
        return self.commit(lambda now: self._without(now, now.read("notes").where(F.col("category") == name)))

    def insert_links(self, new: DataFrame) -> int:
        """Adds links, ignoring those that exist; any missing end raises and nothing is added."""

        def build(now: Snapshot) -> dict[str, Change]:
            if store.dangling(now.read("notes"), new).limit(1).count():
                raise ValueError("a link names a note that does not exist")
            return {"note_links": Change(new.select(*store.END).distinct().join(now.read("note_links"), store.END, "left_anti"))}

        return self.commit(build)

    def unlink(self, links: DataFrame) -> int:
        """Removes links, in that direction only."""
        return self.commit(lambda now: {"note_links": Change(deletes=now.read("note_links").join(links.select(*store.END), store.END, "left_semi"))})

    def put_settings(self, log: DataFrame) -> int:
        """Applies puts (key, value, seq): the last of each key stays."""
        return self.commit(lambda now: {"settings": Change(store.settings_after(log))})
