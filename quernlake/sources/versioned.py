"""Versioned tables on any file system that Spark reads.

A database is a folder of Parquet data and a chain of numbered manifests. A commit writes its rows once and adds a
manifest; whoever creates the next number first wins, so a commit is atomic over all its tables. Inserts add files of
new rows; updates and deletes add small files of row versions and tombstones. A read is the scan of the inserted files
without the rows that a newer version replaces, plus those versions: without changes it is a plain scan with all its
pushdown, with changes the changed ids are joined (broadcast while they are few, else dealt out by counted rows). ``AS OF`` picks the files of earlier
commits from the manifest, so it reads no later data. ``compact`` folds versions into the files; what it folded stays
as history (entries and columns of that time), so ``AS OF`` and the check for conflicts reach behind it until ``vacuum``
drops it, and raise an error beyond.
"""

from __future__ import annotations

import copy
import json
import time
import uuid
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernlake.functions import scalar
from quernlake.functions.types import SPARK, kind_of

#: Changed rows up to which their ids are broadcast when a table is read; more are never broadcast.
BROADCAST_CHANGES = 500_000
#: Rows that a task sorts by their ids, as the counts in the manifest say: ids take a tenth of their memory in files.
SORTED_ROWS = 500_000
#: Milliseconds for which ``vacuum`` spares data that no manifest ever named.
GRACE = 24 * 3600 * 1000
#: What Spark's message says if a value doesn't fit its column.
MISFIT = "value does not fit column"


class DatabaseError(Exception):
    """A statement that can't be carried out."""


class ConstraintError(DatabaseError):
    """NOT NULL, PRIMARY KEY or UNIQUE would be violated."""


class ConflictError(DatabaseError):
    """Another transaction changed the same rows first."""


class Files:
    """Small texts on the Hadoop file system of a folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.root = root.rstrip("/")
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def listing(self, folder: str) -> list[tuple[str, int]]:
        """Names and times of change (milliseconds)."""
        p = self._path(folder)
        return [(s.getPath().getName(), s.getModificationTime()) for s in self._fs.listStatus(p)] if self._fs.exists(p) else []

    def names(self, folder: str) -> list[str]:
        return [n for n, _ in self.listing(folder)]

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Whether this call created the file; False if it is there already. Readers never see a part of it.

        A local file gets its name by a hard link and one on HDFS by a rename, which both fail if the name is taken;
        other stores create the file without overwriting, which they publish when it is closed.
        """
        target, scheme = self._path(name), self._fs.getUri().getScheme()
        if scheme not in ("file", "hdfs", "viewfs"):
            try:
                self._write(target, text, False)
            except Py4JJavaError as e:
                if not self._fs.exists(target):
                    raise DatabaseError(str(e.java_exception)) from e
                return False
            return True
        temporary = self._path(f"{name}.{uuid.uuid4().hex}")
        self._write(temporary, text, True)
        try:
            if scheme != "file":
                return self._fs.rename(temporary, target)
            local = lambda p: self._jvm.java.io.File(p.toUri().getPath()).toPath()
            self._jvm.java.nio.file.Files.createLink(local(target), local(temporary))
            return True
        except Py4JJavaError as e:
            if not self._fs.exists(target):
                raise DatabaseError(str(e.java_exception)) from e
            return False
        finally:
            self._fs.delete(temporary, False)

    def _write(self, path, text: str, overwrite: bool) -> None:
        stream = self._fs.create(path, overwrite)
        stream.write(bytearray(text.encode()))
        stream.close()

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)


@dataclass
class ColumnSpec:
    name: str
    kind: str
    nullable: bool = True
    pk: bool = False
    physical: str = ""

    def __post_init__(self):
        self.name, self.kind = self.name.lower(), kind_of(self.kind)
        self.physical = self.physical or f"{self.name}_{uuid.uuid4().hex[:6]}"


@dataclass
class TableSpec:
    columns: list[ColumnSpec]
    indexes: dict[str, dict] = field(default_factory=dict)
    entries: list[dict] = field(default_factory=list)
    next_id: int = 1
    #: Tells tables apart that have one name after another.
    uid: str = field(default_factory=lambda: uuid.uuid4().hex)
    #: What compactions and changes of types folded: version and time of the fold, entries and columns before it.
    history: list[dict] = field(default_factory=list)
    #: The version and the time up to which history is gone.
    floor: tuple[int, int] = (0, 0)

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    @property
    def auto(self) -> str | None:
        """The integer primary key that missing values are counted up for."""
        keys = [c for c in self.columns if c.pk]
        return keys[0].name if len(keys) == 1 and keys[0].kind == "INTEGER" else None

    def unique_keys(self) -> list[tuple[str, list[str]]]:
        keys = [("PRIMARY KEY", [c.name for c in self.columns if c.pk])]
        keys += [(n, i["columns"]) for n, i in self.indexes.items() if i["unique"]]
        return [k for k in keys if k[1]]

    def column(self, name: str) -> ColumnSpec:
        for c in self.columns:
            if c.name == name.lower():
                return c
        raise DatabaseError(f"column not found: {name}")

    def schema(self) -> T.StructType:
        data = [T.StructField(c.physical, SPARK[c.kind]) for c in self.columns]
        return T.StructType([T.StructField("_row_id", T.StringType()), T.StructField("_seq", T.LongType()), T.StructField("_deleted", T.BooleanType()), *data])

    def dump(self) -> dict:
        return {k: getattr(self, k) for k in ("indexes", "entries", "next_id", "uid", "history", "floor")} | {"columns": [vars(c) for c in self.columns]}

    @staticmethod
    def load(d: dict) -> TableSpec:
        return TableSpec(**(d | {"columns": [ColumnSpec(**c) for c in d["columns"]]}))

    def fold(self, version: int, stamp: int, entries: list[dict]) -> None:
        """New entries for the whole table; those before stay as history."""
        if self.entries:
            self.history.append({"version": version, "time": stamp, "entries": self.entries, "columns": [dict(vars(c)) for c in self.columns]})
        self.entries = entries

    def forget(self, keep: int) -> None:
        """Drop all but the last ``keep`` folds."""
        gone = self.history[: len(self.history) - keep] if keep else self.history
        if gone:
            self.floor = (gone[-1]["version"], gone[-1]["time"])
            self.history = self.history[len(gone) :]

    def as_of(self, key: str, value: int) -> TableSpec:
        """The columns and entries at a transaction (``txn``) or a time."""
        k = 0 if key == "txn" else 1
        if value < self.floor[k]:
            raise DatabaseError(f"history before {'transaction' if not k else 'time'} {self.floor[k]} is gone")
        then = next((h for h in self.history if value < h["time" if k else "version"]), None)
        columns = [ColumnSpec(**c) for c in then["columns"]] if then else self.columns
        entries = [e for e in (then["entries"] if then else self.entries) if e[key] is not None and e[key] <= value]
        return TableSpec(columns, self.indexes, entries, self.next_id, self.uid)

    def since(self, base: TableSpec | None) -> list[dict]:
        """The entries that other commits made after ``base``, folded ones too."""
        known = {e["path"] for e in base.entries} if base else set()
        found = {e["path"]: e for part in [*[h["entries"] for h in self.history], self.entries] for e in part if not e.get("folds")}
        return [e for path, e in found.items() if path not in known]


@dataclass
class Manifest:
    version: int = 0
    tables: dict[str, TableSpec] = field(default_factory=dict)
    views: dict[str, str] = field(default_factory=dict)

    def table(self, name: str) -> TableSpec:
        try:
            return self.tables[name.lower()]
        except KeyError:
            raise DatabaseError(f"table not found: {name}") from None

    def dump(self) -> str:
        return json.dumps({"version": self.version, "tables": {k: t.dump() for k, t in self.tables.items()}, "views": self.views})

    @staticmethod
    def load(text: str) -> Manifest:
        d = json.loads(text)
        return Manifest(d["version"], {k: TableSpec.load(t) for k, t in d["tables"].items()}, d["views"])


def micros() -> int:
    return time.time_ns() // 1000


class Store:
    """The manifests and data files of one database."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.files = spark, Files(spark, root)
        self._cache: dict[int, Manifest] = {}

    def latest(self) -> Manifest:
        versions = [int(n.removesuffix(".json")) for n in self.files.names("manifests") if n.endswith(".json")]
        v = max(versions, default=0)
        if v not in self._cache:
            self._cache = {v: Manifest.load(self.files.read(f"manifests/{v:012d}.json")) if v else Manifest()}
        return copy.deepcopy(self._cache[v])

    def publish(self, m: Manifest) -> bool:
        return self.files.create(f"manifests/{m.version:012d}.json", m.dump())

    def save(self, rows: DataFrame, path: str) -> None:
        """Write rows; a value that doesn't fit its column is an error of the statement."""
        try:
            rows.write.parquet(f"{self.files.root}/{path}")
        except (PySparkException, Py4JJavaError) as e:
            if MISFIT in str(e):
                self.files.delete(path)
                raise DatabaseError(MISFIT + str(e).split(MISFIT)[1].split("\n")[0].split("'")[0]) from None
            raise

    def write(self, table: TableSpec, rows: DataFrame, seq: int, kind: str) -> dict | None:
        """Write rows (``_row_id``, ``_deleted`` and the table's columns by name); None if there are none."""
        path = f"data/{uuid.uuid4().hex}"
        data = [F.col(f"`{c.name}`").cast(SPARK[c.kind]).alias(c.physical) for c in table.columns]
        self.save(rows.select("_row_id", F.lit(seq).cast("long").alias("_seq"), F.col("_deleted").alias("_deleted"), *data), path)
        n = self.spark.read.schema(table.schema()).parquet(f"{self.files.root}/{path}").count()  # from the files' footers
        return {"txn": None, "time": None, "kind": kind, "path": path, "rows": n} if n else None

    def newest(self, table: TableSpec, entries: list[dict]) -> DataFrame:
        """The last version of each row that the entries hold, without deleted ones; physical names."""
        return last_versions(self._scan(table, entries), size(entries)).where(~F.col("_deleted"))

    def _scan(self, table: TableSpec, entries: list[dict]) -> DataFrame:
        schema = table.schema()
        if not entries:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.files.root}/{e['path']}" for e in entries])

    def rows(self, table: TableSpec, entries: list[dict] | None = None) -> DataFrame:
        """``_row_id`` and the table's columns, as the entries leave them."""
        entries = table.entries if entries is None else entries
        inserted, changed = [e for e in entries if e["kind"] == "insert"], [e for e in entries if e["kind"] == "change"]
        named = [F.col(c.physical).alias(c.name) for c in table.columns]
        base = self._scan(table, inserted)
        if not changed:
            return base.select("_row_id", *named)
        kept = with_ids(base, size(inserted), self._scan(table, changed), size(changed), "left_anti")
        return kept.select("_row_id", *named).unionByName(self.newest(table, changed).select("_row_id", *named))


class Transaction:
    """Staged changes over a pinned version; ``commit`` publishes all of them or none."""

    def __init__(self, store: Store, isolation: str = "READ COMMITTED"):
        self.store, self.isolation = store, isolation
        self.base = store.latest()
        self.staged: dict[str, list[dict]] = {}  # by the tables' uid: names may change
        self.ddl: list = []
        self.saved: dict[str, tuple[dict[str, int], int]] = {}
        self.steps = 0

    # --- reading

    def manifest(self) -> Manifest:
        """What the transaction sees: its version (the latest under READ COMMITTED) and its own changes."""
        m = self.store.latest() if self.isolation == "READ COMMITTED" else copy.deepcopy(self.base)
        for change in self.ddl:
            change(m)
        for table in m.tables.values():
            table.entries += self.staged.get(table.uid, [])
        return m

    def rows(self, name: str, transaction: int | None = None, timestamp: int | None = None) -> DataFrame:
        table = self.manifest().table(name)
        if transaction is not None:
            table = table.as_of("txn", transaction)
        if timestamp is not None:
            table = table.as_of("time", timestamp)
        return self.store.rows(table)

    # --- changing

    def alter(self, change) -> None:
        """A change of the manifest that can be applied again at commit."""
        change(self.manifest())
        self.ddl.append(change)

    def _stage(self, name: str, rows: DataFrame, kind: str) -> int:
        self.steps += 1
        table = self.manifest().table(name)
        entry = self.store.write(table, rows, ((self.base.version + 1) << 20) + self.steps, kind)
        if entry:
            self.staged.setdefault(table.uid, []).append(entry)
        return entry["rows"] if entry else 0

    def insert(self, name: str, rows: DataFrame, on_duplicate: dict[str, Column] | None = None) -> tuple[int, int]:
        """(rows affected, last id). ``rows`` has columns of the table; missing ones are NULL, a missing integer key counts up.

        With ``on_duplicate``, a row whose key is there updates that row; expressions see the row that is there as
        plain names and the new one as ``new.x``. An update counts as two rows.
        """
        table = self.manifest().table(name)
        have = {c.lower() for c in rows.columns}
        if extra := have - set(table.names):
            raise DatabaseError(f"column not found: {', '.join(sorted(extra))}")
        rows = rows.select(*[(fitted(c) if c.name in have else F.lit(None).cast(SPARK[c.kind])).alias(c.name) for c in table.columns])
        keys = table.unique_keys()
        held = None
        if keys:  # checks and the write read the rows several times: compute them once
            held = f"data/staged-{uuid.uuid4().hex}"
            self.store.save(rows.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), held)
            rows = self.store.spark.read.parquet(f"{self.store.files.root}/{held}")
        try:
            return self._inserted(name, table, rows, keys, on_duplicate)
        finally:
            if held:
                self.store.files.delete(held)

    def _inserted(self, name: str, table: TableSpec, rows: DataFrame, keys: list, on_duplicate: dict[str, Column] | None) -> tuple[int, int]:
        rows, last = self._numbered(table, rows) if table.auto else (rows.drop("_part", "_at"), 0)
        self._not_null(table, rows)
        updated = 0
        if keys:
            for label, key in keys:
                if rows.dropna(subset=key).groupBy(*key).count().where("count > 1").limit(1).count():
                    raise ConstraintError(f"{label}: duplicate values of {', '.join(key)}")
            there = self.rows(name)
            for label, key in keys:
                hit = rows.join(there.select(*key).dropna(), key, "left_semi")
                if on_duplicate is None:
                    if hit.limit(1).count():
                        raise ConstraintError(f"{label}: {', '.join(key)} exists")
                    continue
                new = rows.alias("new")
                old = there.alias("old")
                both = old.join(new, [F.col(f"old.{k}") == F.col(f"new.{k}") for k in key])
                renamed = both.select(*[F.col(f"old.{c}").alias(c) for c in there.columns], F.struct(*[F.col(f"new.{c}").alias(c) for c in table.names]).alias("new"))
                changed = renamed.select("_row_id", *[on_duplicate.get(c, F.col(f"`{c}`")).alias(c) for c in table.names])
                rows = rows.join(there.select(*key).dropna(), key, "left_anti").select(*table.names)
                updated += self.change(name, changed, set(on_duplicate))
            if updated:  # the update may have moved a row to a key of a new one
                there = self.rows(name)
                for label, key in keys:
                    if set(key) & set(on_duplicate or ()) and rows.join(there.select(*key).dropna(), key, "left_semi").limit(1).count():
                        raise ConstraintError(f"{label}: {', '.join(key)} exists")
        first = uuid.uuid4().hex[:12]
        rows = rows.withColumn("_row_id", F.concat(F.lit(f"{first}-"), F.monotonically_increasing_id().cast("string")))
        n = self._stage(name, rows.withColumn("_deleted", F.lit(False)), "insert")
        return n + 2 * updated, last

    def _numbered(self, table: TableSpec, rows: DataFrame) -> tuple[DataFrame, int]:
        """Staged rows with their missing keys counted up without gaps, from partition counts, and the largest key."""
        key = F.col(f"`{table.auto}`")
        missing = {r["_part"]: r["n"] for r in rows.where(key.isNull()).groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}
        top = max(table.next_id - 1, rows.agg(F.max(key)).first()[0] or 0)
        if missing:
            starts, at = {}, top
            for p in sorted(missing):
                starts[p], at = at, at + missing[p]
            # numbers within a partition follow its rows; each partition is numbered by itself
            nth = F.row_number().over(Window.partitionBy("_part", key.isNull()).orderBy("_at"))
            start = F.create_map(*[F.lit(x) for kv in starts.items() for x in kv])[F.col("_part")]
            rows = rows.withColumn(table.auto, F.coalesce(key, start + nth))
            top = at

        def raise_next(m: Manifest) -> None:
            for t in m.tables.values():
                if t.uid == table.uid:
                    t.next_id = max(t.next_id, top + 1)

        self.ddl.append(raise_next)
        return rows.drop("_part", "_at"), top

    def _not_null(self, table: TableSpec, rows: DataFrame) -> None:
        must = [c.name for c in table.columns if not c.nullable or c.pk]
        if must:
            bad = rows.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in must]).first()
            missing = [c for c in must if bad[c]]
            if missing:
                raise ConstraintError(f"NOT NULL: {', '.join(missing)}")

    def change(self, name: str, new: DataFrame, columns: set[str]) -> int:
        """Rows (``_row_id`` and all columns) that take the place of those of their ids; ``columns`` are those that differ."""
        table = self.manifest().table(name)
        new = new.select("_row_id", *[fitted(c).alias(c.name) if c.name in columns else F.col(f"`{c.name}`") for c in table.columns])
        held = f"data/staged-{uuid.uuid4().hex}"  # checks and the write see the same values, computed once
        self.store.save(new, held)
        try:
            return self._changed(name, table, self.store.spark.read.schema(new.schema).parquet(f"{self.store.files.root}/{held}"), columns)
        finally:
            self.store.files.delete(held)

    def _changed(self, name: str, table: TableSpec, new: DataFrame, columns: set[str]) -> int:
        self._not_null(table, new)
        for label, key in table.unique_keys():
            if set(key) & columns:
                rest = with_ids(self.rows(name), size(table.entries), new, new.count(), "left_anti").select(*key)
                if rest.unionByName(new.select(*key)).dropna().groupBy(*key).count().where("count > 1").limit(1).count():
                    raise ConstraintError(f"{label}: duplicate values of {', '.join(key)}")
        return self._stage(name, new.withColumn("_deleted", F.lit(False)), "change")

    def remove(self, name: str, rows: DataFrame) -> int:
        """The rows of some ``_row_id`` go; only their ids are written."""
        table = self.manifest().table(name)
        gone = rows.select("_row_id", F.lit(True).alias("_deleted"), *[F.lit(None).cast(SPARK[c.kind]).alias(c.name) for c in table.columns])
        return self._stage(name, gone, "change")

    def update(self, name: str, assignments: dict[str, Column], condition: Column | None = None) -> int:
        table = self.manifest().table(name)
        for c in assignments:
            table.column(c)
        rows = self.rows(name)
        hit = rows if condition is None else rows.where(condition)
        return self.change(name, hit.select("_row_id", *[assignments.get(c, F.col(f"`{c}`")).alias(c) for c in table.names]), set(assignments))

    def delete(self, name: str, condition: Column | None = None) -> int:
        rows = self.rows(name)
        return self.remove(name, rows if condition is None else rows.where(condition))

    # --- ending

    def savepoint(self, name: str) -> None:
        self.saved.pop(name, None)
        self.saved[name] = ({uid: len(entries) for uid, entries in self.staged.items()}, len(self.ddl))

    def rollback_to(self, name: str) -> None:
        """Undo what came after the savepoint; it stays, later ones go."""
        if name not in self.saved:
            raise DatabaseError(f"savepoint not found: {name}")
        counts, n = self.saved[name]
        for uid in list(self.staged):
            keep = counts.get(uid, 0)
            for e in self.staged[uid][keep:]:
                self.store.files.delete(e["path"])
            self.staged[uid] = self.staged[uid][:keep]
        self.ddl = self.ddl[:n]
        names = list(self.saved)
        self.saved = {k: self.saved[k] for k in names[: names.index(name) + 1]}

    def release(self, name: str) -> None:
        if name not in self.saved:
            raise DatabaseError(f"savepoint not found: {name}")
        names = list(self.saved)
        self.saved = {k: self.saved[k] for k in names[: names.index(name)]}

    def commit(self) -> int:
        """The version that holds the changes. Rows that another commit changed meanwhile are a conflict."""
        staged = {uid: entries for uid, entries in self.staged.items() if entries}
        if not staged and not self.ddl:
            return self.base.version
        while True:
            now = self.store.latest()
            self._check_conflicts(now, staged)
            stamp = micros()
            for change in self.ddl:
                change(now)
            now.version += 1
            for table in now.tables.values():
                table.entries += [e | {"txn": now.version, "time": stamp} for e in staged.get(table.uid, [])]
            if self.store.publish(now):
                return now.version

    def _check_conflicts(self, now: Manifest, staged: dict[str, list[dict]]) -> None:
        if now.version == self.base.version:
            return
        before = {t.uid: t for t in self.base.tables.values()}
        for name, table in now.tables.items():
            entries, base = staged.get(table.uid), before.get(table.uid)
            if not entries:
                continue
            others = table.since(base)
            changes, theirs = [e for e in entries if e["kind"] == "change"], [e for e in others if e["kind"] == "change"]
            if table.floor[0] > self.base.version and changes:
                raise ConflictError(f"{name}: the changes since this transaction began are folded and gone")
            if changes and theirs and with_ids(self.store._scan(table, changes), size(changes), self.store._scan(table, theirs), size(theirs), "left_semi").limit(1).count():
                raise ConflictError(f"{name}: another transaction changed the same rows")
            if not others:
                continue
            for label, key in table.unique_keys():
                physical = [table.column(k).physical for k in key]
                mine = self.store.newest(table, entries).select(F.col("_row_id").alias("_mine"), *physical)
                both = mine.join(self.store.newest(table, others).select("_row_id", *physical).dropna(), physical).where("_mine <> _row_id")
                if both.limit(1).count():
                    raise ConflictError(f"{name}: {label} exists in another transaction")

    def rollback(self) -> None:
        for entries in self.staged.values():
            for e in entries:
                self.store.files.delete(e["path"])
        self.staged, self.ddl, self.saved = {}, [], {}


def size(entries: list[dict]) -> int:
    """Rows that the entries hold, all versions of them."""
    return sum(e["rows"] for e in entries)


def dealt(rows: DataFrame, n: int) -> DataFrame:
    """``n`` rows dealt out by their ids, ``SORTED_ROWS`` to a partition."""
    return rows.repartition(max(1, -(-n // SORTED_ROWS)), "_row_id")


def with_ids(rows: DataFrame, n: int, other: DataFrame, m: int, how: str) -> DataFrame:
    """Those of ``n`` rows whose ids are among the ``m`` rows of another (``left_semi``) or not (``left_anti``).

    Beyond ``BROADCAST_CHANGES`` both sides are dealt out and sorted, whatever Spark makes of the files' sizes, which
    are compressed: broadcast, ids take over 130 bytes each in every executor. That is an outer join, as Spark would
    move a semi or anti join below the repartition.
    """
    ids = other.select("_row_id")
    if m <= BROADCAST_CHANGES:
        return rows.join(F.broadcast(ids.distinct()), "_row_id", how)
    mine, theirs = dealt(rows, n + m).alias("mine"), dealt(ids, n + m).distinct().hint("merge").alias("theirs")
    both, there = mine.join(theirs, F.col("mine._row_id") == F.col("theirs._row_id"), "left"), F.col("theirs._row_id").isNotNull()
    return both.where(~there if how == "left_anti" else there).select("mine.*")


def last_versions(rows: DataFrame, n: int) -> DataFrame:
    """The row of each id with the largest ``_seq``. Ids hardly repeat in one file, so rows are dealt out before they are sorted."""
    rest = [c for c in rows.columns if c != "_row_id"]
    return dealt(rows, n).groupBy("_row_id").agg(F.max_by(F.struct(*rest), "_seq").alias("_v")).select("_row_id", "_v.*")


def fitted(c: ColumnSpec) -> Column:
    """The column cast to its kind; a value that has no such form is an error when it is written."""
    value = F.col(f"`{c.name}`")
    made = scalar.cast(value, c.kind)
    return F.when(value.isNotNull() & made.isNull(), F.raise_error(F.concat(F.lit(f"{MISFIT} {c.name}: "), value.cast("string"))).cast(SPARK[c.kind])).otherwise(made)


def compact(store: Store, name: str) -> int:
    """Fold all versions of a table into one set of files; the folded entries stay as history."""
    now = store.latest()
    table = now.table(name)
    entry = store.write(table, store.rows(table).withColumn("_deleted", F.lit(False)), (now.version + 1) << 20, "insert")
    now.version += 1
    stamp = micros()
    table.fold(now.version, stamp, [entry | {"txn": now.version, "time": stamp, "folds": True}] if entry else [])
    if not store.publish(now):
        raise ConflictError(f"{name}: changed during compaction")
    return now.version


def vacuum(store: Store, keep: int = 1) -> int:
    """Delete all but the last ``keep`` states: older manifests, older folds of the tables, and the data that only these name.

    Data that no manifest ever named is what open transactions staged or failed ones left; it goes after ``GRACE``.
    Returns the number of folders deleted.
    """
    keep = max(1, keep)
    now = store.latest()
    for table in now.tables.values():
        table.forget(keep - 1)
    if now.dump() != store.latest().dump():
        now.version += 1
        if not store.publish(now):
            raise ConflictError("changed while history was dropped")
    versions = sorted(int(n.removesuffix(".json")) for n in store.files.names("manifests") if n.endswith(".json"))
    paths = lambda m: {e["path"].removeprefix("data/") for t in m.tables.values() for part in [t.entries, *[h["entries"] for h in t.history]] for e in part}
    used, named = paths(now), set()
    for v in versions:
        named |= paths(Manifest.load(store.files.read(f"manifests/{v:012d}.json")))
    late = micros() // 1000 - GRACE
    unused = [n for n, at in store.files.listing("data") if n not in used and (n in named or at < late)]
    for v in versions[:-keep]:
        store.files.delete(f"manifests/{v:012d}.json")
    for n in unused:
        store.files.delete(f"data/{n}")
    return len(unused)
