"""Exact dedup against a persistent digest index.

The index is a table bucketed and sorted by digest.  A batch is reduced to one
winner a digest by a map-side combined aggregation, sort-merge anti-joined with
the index (which is read by bucket, so only the batch is shuffled) and its new
digests are appended.  Appending is by batch number: a batch that is run again
after a failure sees the index as it was before and adds nothing twice.

Texts are equal when identical after deleting white space (space and
U+0009..U+000D).  Of equal texts in a batch, the one with most code points, then
the smallest id (null after all others), stays; a text that the index knew
before loses to the row that was indexed.  ``dedup`` takes a whole table through
the index in batches from long texts to short ones, so that this is also the
winner of the whole table.

Defined results: null text counts as empty, so null, empty and all-blank texts
are copies of each other; rows with the same id and text count one by one in
group_size and share one decision; an empty batch gives an empty result and
leaves the index as it is; other columns, of any name, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.operators.salting import heavy_join
from kinfold.operators.scratch import delete, scratch_dir, settle

#: White space that does not count.
BLANK = " \t\n\x0b\x0c\r"
BATCHES = 2


def digest(text: Column) -> Column:
    """SHA-256 of a text without white space, 32 bytes."""
    return F.unhex(F.sha2(F.translate(F.coalesce(text, F.lit("")), BLANK, "").cast("binary"), 256))


def hashed(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, digest, n_chars), settled: texts are read and hashed once."""
    n_chars = F.coalesce(F.char_length(F.col(text)), F.lit(0))
    return settle(docs.select(F.col(id).alias("doc_id"), digest(F.col(text)).alias("digest"), n_chars.alias("n_chars")), "hashed")


class DigestIndex:
    """A named table (digest, keep_id, batch) in ``buckets`` buckets: give it as
    many as make a bucket's digests fit a task (about 3 million in 128 MB)."""

    def __init__(self, spark: SparkSession, name: str, buckets: int = 64, path: str | None = None):
        self.spark, self.name, self.buckets = spark, name, buckets
        self.path = path or f"{scratch_dir(spark)}/kinfold/index-{name}"

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.name)

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def _write(self, rows: DataFrame, name: str, path: str) -> None:
        writer = rows.write.bucketBy(self.buckets, "digest").sortBy("digest").mode("append")
        writer.option("path", path).saveAsTable(name)

    def next_batch(self) -> int:
        """The number of a batch that comes after all in the index."""
        last = self.rows().agg(F.max("batch")).first()[0] if self.exists() else None
        return 0 if last is None else last + 1

    def _append(self, new: DataFrame, batch: int) -> None:
        """Each bucket gets one sorted file a batch, as the rows come out of the
        join with the buckets; Spark commits a batch as a whole."""
        if self.rows().filter(F.col("batch") == batch).limit(1).count() == 0:
            self._write(new, self.name, self.path)

    def compact(self) -> None:
        """One sorted file a bucket again, after many batches; a bucket is
        rewritten in its task, without a shuffle."""
        turn = self.path.rsplit("@", 1)
        path = f"{turn[0]}@{int(turn[1]) + 1 if len(turn) > 1 else 1}"
        self._write(self.rows(), f"{self.name}_next", path)
        self.drop()
        self.spark.sql(f"ALTER TABLE {self.name}_next RENAME TO {self.name}")
        self.path = path

    def drop(self) -> None:
        """Remove the table and its files."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        delete(self.spark, self.path)

    def add(self, rows: DataFrame, batch: int | None = None) -> DataFrame:
        """Append the new digests of a batch of hashed rows.  Returns (digest,
        group_size) of the batch, settled."""
        best = F.min(F.struct((-F.col("n_chars")).alias("neg"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id")))
        groups = settle(rows.groupBy("digest").agg(best["id"].alias("keep_id"), F.count("*").alias("group_size")), "groups")
        if not self.exists():
            empty = groups.limit(0).select("digest", "keep_id", F.lit(0).alias("batch"))
            self._write(empty, self.name, self.path)
        batch = self.next_batch() if batch is None else batch
        known = self.rows().filter(F.col("batch") < batch).select("digest")
        fresh = groups.hint("merge").join(known.hint("merge"), "digest", "left_anti")
        self._append(fresh.select("digest", "keep_id", F.lit(batch).alias("batch")), batch)
        return groups.select("digest", "group_size")

    def decide(self, rows: DataFrame, groups: DataFrame) -> DataFrame:
        """doc_id, keep_id (the row that stays), group_size, kept, text_sha256
        of hashed rows whose digests, with their sizes, are ``groups``."""
        decided = settle(groups.hint("merge").join(self.rows().select("digest", "keep_id").hint("merge"), "digest"), "decided")
        out = heavy_join(rows, decided, ["digest"], "group_size", rows.count())
        kept = F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept")
        return out.select("doc_id", "keep_id", "group_size", kept, F.lower(F.hex("digest")).alias("text_sha256"))

    def ingest(self, docs: DataFrame, id: str = "doc_id", text: str = "text", batch: int | None = None) -> DataFrame:
        """Decide on a batch and append its new digests; keep_id is of this
        batch or an earlier one, group_size counts this batch."""
        rows = hashed(docs, id, text)
        return self.decide(rows, self.add(rows, batch))


def dedup(docs: DataFrame, index: DigestIndex, id: str = "doc_id", text: str = "text", batches: int = BATCHES) -> DataFrame:
    """A whole table through an index that knows no later texts, in ``batches``
    batches: long texts first, so that a text that the index knows is the one
    that stays.  Columns as those of ``decide``; group_size counts all batches."""
    rows = hashed(docs, id, text)
    marks = [(i + 1) / batches for i in range(batches - 1)]
    cuts = rows.agg(F.percentile_approx("n_chars", marks)).first()[0] or [] if marks else []
    edges = [None, *sorted(set(cuts), reverse=True), None]
    parts, start = [], index.next_batch()
    for turn, (above, least) in enumerate(zip(edges, edges[1:])):  # lengths from least up to below the last least
        own = rows if above is None else rows.filter(F.col("n_chars") < above)
        own = own if least is None else own.filter(F.col("n_chars") >= least)
        parts.append(index.add(own, start + turn))
    groups = parts[0]
    for part in parts[1:]:
        groups = groups.unionByName(part)
    if len(parts) > 1:
        groups = settle(groups.groupBy("digest").agg(F.sum("group_size").alias("group_size")), "groups")
    return index.decide(rows, groups)
