"""A text index that is kept up to date batch by batch instead of being built anew.

A batch adds one segment: the postings of its documents, and what it changes in the document frequency of every
term, in the number of documents and in their length. For that it reads the postings of the documents that it
replaces or deletes, and no others. Those are hidden from then on by their ids; merging writes what is left.
A search sees an index like any other, whose scores equal those of an index built from the live documents.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.operators import lexical as lx
from vellum.session import written
from vellum.sources.tableset import TableSet


class SegmentedIndex:
    """``key`` is the id by which documents are replaced and deleted; ``ids`` name a document, ``key`` among them."""

    def __init__(self, spark: SparkSession, root: str, cols: Sequence[str], ids: Sequence[str] = ("paper_id",), key: str = "paper_id") -> None:
        self.tables = TableSet(spark, root, {"postings": (key,), "docs": (key,), "terms": (), "sizes": ()})
        self.ids, self.cols, self.key = tuple(ids), tuple(cols), key

    def update(self, batch_name: str, docs: DataFrame, deleted: DataFrame | None = None) -> int:
        """Add or replace documents and delete the ids in ``deleted`` (column ``key``); a batch that is known changes nothing."""
        if batch_name in self.tables.batches():
            return self.tables.version()
        key, ids = self.key, list(self.ids)
        index = lx.persisted(lx.build_index(docs.select(*ids, *self.cols), ids, self.cols))
        docs, postings = index.docs, index.postings
        new_ids = docs.select(F.col(key).alias("id")).distinct()
        gone = new_ids if deleted is None else new_ids.unionByName(deleted.select(F.col(key).alias("id")).distinct()).distinct()
        gone = written(gone, "replaced")
        changes = postings.groupBy("term").agg(F.count("*").alias("df"))
        size = index.stats.select(F.col("n_docs").cast("bigint").alias("n_docs"), F.coalesce(F.col("n_tokens"), F.lit(0)).cast("bigint").alias("n_tokens"))
        if any(r.name == "postings" for r in self.tables.segments()):
            hidden = gone.withColumnRenamed("id", key)
            old = self.tables.read("postings").join(hidden, key, "left_semi")
            changes = changes.unionByName(old.groupBy("term").agg((-F.count("*")).alias("df"))).groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0")
            old_docs = self.tables.read("docs").join(hidden, key, "left_semi")
            less = old_docs.agg((-F.count("*")).alias("n_docs"), (-F.coalesce(F.sum("dl"), F.lit(0))).alias("n_tokens"))
            size = size.unionByName(less).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        with_length = index.rows.select(*ids, *self.cols, F.col("dl").cast("bigint").alias("dl"))
        tables = {"postings": postings, "docs": with_length, "terms": changes, "sizes": size}
        return self.tables.publish(batch_name, tables, replaced=gone.where(F.col("id").isNotNull()))

    def index(self, version: int | None = None) -> lx.TextIndex:
        """The index of the newest version or a pinned one."""
        read = lambda name: self.tables.read(name, version)
        total = read("sizes").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        stats = total.select("n_docs", F.when(F.col("n_docs") > 0, F.col("n_tokens") / F.col("n_docs")).alias("avg_len"), "n_tokens")
        freq = self._terms(read("terms"))
        docs = read("docs").select(*self.ids, *self.cols)
        return lx.TextIndex(read("postings"), stats, docs, self.ids, self.cols, freq, lx.term_rows(docs, self.cols))

    @staticmethod
    def _terms(changes: DataFrame) -> DataFrame:
        return changes.groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0")

    def merge(self) -> int:
        """Write the live postings as one segment, and the changes of counts added up."""
        sizes = lambda x: x.agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return self.tables.compacted({"terms": self._terms, "sizes": sizes})
