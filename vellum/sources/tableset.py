"""A set of tables that changes as one: versions with a manifest, and readers that keep theirs.

Every batch appends one segment of rows to each table it has rows for, and the ids whose earlier rows
it replaces or deletes. Nothing is rewritten: a row is there if no later batch replaced or deleted its
id, which a reader finds by one join with the ids. ``compacted`` writes the live rows as one segment.

A version is one file of the manifest that lists all segments. It is written last, by a single task
whose output file is moved in place at once, so a reader sees either all tables of a batch or
none, and what a writer that died has left behind is in no manifest. A batch has a name; publishing a name
again changes nothing, so a replayed batch is harmless. One writer at a time, as a stream has, is assumed;
a second one that writes the same version gets an error.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MANIFEST = "version bigint, batch_name string, batch bigint, name string, path string, schema string"
GONE = "_gone"


class TableSet:
    """``keys`` names for each table the columns with the id whose rows a batch replaces.

    ``delete_keys`` names those by which a deleted id takes rows along, where they are others: edges go
    with their source when that is replaced, with either end when it is deleted. Tables without a
    key only grow.
    """

    def __init__(self, spark: SparkSession, root: str, keys: Mapping[str, tuple[str, ...]], delete_keys: Mapping[str, tuple[str, ...]] | None = None) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.keys, self.delete_keys = dict(keys), {**keys, **(delete_keys or {})}

    # ---- manifest

    def _manifest(self) -> DataFrame:
        from pyspark.errors import AnalysisException

        try:
            return self.spark.read.schema(MANIFEST).option("recursiveFileLookup", "true").json(f"{self.root}/_manifest")
        except AnalysisException as fault:
            if fault.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], MANIFEST)

    def version(self) -> int:
        """The newest version; 0 before the first batch."""
        return self._manifest().agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]

    def segments(self, version: int | None = None) -> list:
        """Rows of one version of the manifest: one for each table and batch, so few."""
        at = self.version() if version is None else version
        return self._manifest().where(F.col("version") == at).orderBy("batch", "name").collect()

    def batches(self, version: int | None = None) -> dict[str, int]:
        return {r.batch_name: r.batch for r in self.segments(version)}

    def _write(self, rows: DataFrame, batch: int, name: str) -> tuple[str, str]:
        path = f"{self.root}/data/{name}/{batch:012d}-{uuid.uuid4().hex}"
        rows = rows.withColumn("_batch", F.lit(batch).cast("bigint"))
        rows.write.parquet(path)
        return path, rows.schema.json()

    def _list(self, version: int, rows: list[tuple]) -> None:
        listed = self.spark.createDataFrame([(version, *r) for r in rows], MANIFEST)
        listed.coalesce(1).write.mode("error").json(f"{self.root}/_manifest/{version:012d}")

    # ---- writing

    def publish(self, batch_name: str, tables: Mapping[str, DataFrame], replaced: DataFrame | None = None, deleted: DataFrame | None = None) -> int:
        """Append rows, after taking out all earlier rows of the ids in ``replaced`` and ``deleted`` (column ``id``).

        Returns the version that has the batch; if the name was published before, nothing is written.
        """
        version = self.version()
        known = self.segments(version)
        if any(r.batch_name == batch_name for r in known):
            return version
        batch = 1 + max((r.batch for r in known), default=0)
        new = [(batch_name, batch, name, *self._write(rows, batch, name)) for name, rows in tables.items()]
        gone = None
        for ids, whole in ((replaced, False), (deleted, True)):
            if ids is not None:
                some = ids.select(F.col("id").cast("string").alias("id"), F.lit(whole).alias("deleted")).distinct()
                gone = some if gone is None else gone.unionByName(some)
        if gone is not None:
            new.append((batch_name, batch, GONE, *self._write(gone, batch, GONE)))
        old = [(r.batch_name, r.batch, r.name, r.path, r.schema) for r in known]
        self._list(version + 1, old + new)
        return version + 1

    def compacted(self, merged: Mapping[str, Callable[[DataFrame], DataFrame]] | None = None) -> int:
        """Write the live rows of every table as one segment and publish that; readers of older versions aren't disturbed.

        ``merged`` says how the rows of a table are put together, where there is more to do than to copy them.
        """
        merge = merged or {}
        known = self.segments()
        if not known:
            return 0
        last = max(r.batch for r in known)
        names = {r.batch_name: r.batch for r in known}
        newest = max(names, key=names.get)
        live = {name: self.read(name) for name in sorted({r.name for r in known} - {GONE, ""})}
        rows = [(newest, last, name, *self._write(merge[name](x) if name in merge else x, last, name)) for name, x in live.items()]
        # the other batches' names stay known, so that a replay of them stays harmless
        rows += [(n, b, "", "", "") for n, b in names.items() if n != newest]
        version = self.version() + 1
        self._list(version, rows)
        return version

    # ---- reading

    def _parts(self, name: str, segments: list) -> DataFrame | None:
        paths: dict[str, list[str]] = {}
        for r in segments:
            if r.name == name:
                paths.setdefault(r.schema, []).append(r.path)
        out = None
        for schema, some in paths.items():
            part = self.spark.read.schema(StructType.fromJson(json.loads(schema))).parquet(*some)
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        return out

    def read(self, name: str, version: int | None = None, batches: bool = False) -> DataFrame:
        """The live rows of a table, of the newest version or a pinned one; with ``batches`` also the ``_batch`` that wrote them."""
        segments = self.segments(version)
        rows = self._parts(name, segments)
        if rows is None:
            raise ValueError(f"no table {name!r} in this version")
        gone = self._parts(GONE, segments)
        keys = self.keys.get(name, ())
        for c in (*keys, *(c for c in self.delete_keys.get(name, ()) if c not in keys)) if gone is not None else ():
            ids = (gone if c in keys else gone.where("deleted")).groupBy(F.col("id").alias("_id")).agg(F.max("_batch").alias("_last"))
            rows = rows.join(ids, F.col(c).cast("string") == F.col("_id"), "left").where(F.col("_last").isNull() | (F.col("_batch") >= F.col("_last"))).drop("_id", "_last")
        return rows if batches else rows.drop("_batch")

    def counts(self, version: int | None = None) -> DataFrame:
        """``name, n_rows`` of every table."""
        names = sorted({r.name for r in self.segments(version)} - {GONE, ""})
        out = None
        for name in names:
            one = self.read(name, version).agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("name"), "n_rows")
            out = one if out is None else out.unionByName(one)
        return self.spark.createDataFrame([], "name string, n_rows bigint") if out is None else out
