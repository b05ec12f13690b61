"""Exact duplicate removal against a persistent digest index.

The index is a Parquet table bucketed and sorted by the SHA-256 of the normalised text, one row for each text ever
seen. New data meets it in a sort-merge anti-join: the index side needs no exchange because its buckets already are the
join's partitions. Texts never travel; only 32-byte digests do.

Defined cases: a null text counts as the empty text; equal texts are equal after lower-casing A-Z only; of equal texts
in one call the row with the largest id stays (null ids lose against any other, and an index entry made by an earlier
call wins over every later row); repeated rows form a group like any other copies, and all rows with the id that
stays are marked as kept; an empty table gives an empty result
and leaves the index as it was; other columns are ignored by ``annotate`` whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import ascii_lower, written

#: A digest is hot if it holds over 1/HOT_SHARE of the rows; so fewer than HOT_SHARE are, which bounds what is broadcast.
HOT_SHARE = 1000


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest) of every row; digest: 32 bytes."""
    text = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    return docs.select(F.col(id_col).alias("id"), F.unhex(F.sha2(text, 256)).alias("digest"))


class DigestIndex:
    """A digest table in a folder that outlives the session; open it again with the same path and bucket count."""

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.table = f"digest_index_{uuid.uuid4().hex[:12]}"
        spark.sql(
            f"CREATE TABLE {self.table} (digest BINARY, keep_id BIGINT, group_size BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{path}'"
        )

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def new_groups(self, groups: DataFrame) -> DataFrame:
        """Those of one row per digest that the index lacks: a sort-merge anti-join on the bucketed digest."""
        return groups.join(self.read().select("digest").hint("merge"), "digest", "left_anti")

    def append(self, groups: DataFrame) -> None:
        """Add (digest, keep_id, group_size) rows that ``new_groups`` returned."""
        groups.select("digest", "keep_id", "group_size").repartition(self.buckets, "digest").write.insertInto(self.table)
        self.spark.catalog.refreshTable(self.table)

    def close(self) -> None:
        """Take the table out of the session's catalog; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")

    def dedup(self, rows: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
        """Judge (id, digest) rows, append what is new, and return id, digest, keep_id, group_size.

        group_size counts the rows that the call which first saw a text had of it, or is that of ``sizes`` (digest, group_size).
        """
        groups = rows.groupBy("digest").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        if sizes is not None:
            groups = groups.drop("group_size").join(sizes, "digest")
        new = written(self.new_groups(groups), "digest-new")
        self.append(new)
        index, total = self.read(), rows.count()
        hot = groups.where(F.col("group_size") * HOT_SHARE > F.greatest(F.lit(total), F.lit(HOT_SHARE))).select("digest")
        hot = F.broadcast(index.join(hot, "digest"))
        marked = rows.join(hot.select("digest", F.col("keep_id").alias("hot_id"), F.col("group_size").alias("hot_size")), "digest", "left")
        found = marked.where("hot_size IS NOT NULL").select("id", "digest", F.col("hot_id").alias("keep_id"), F.col("hot_size").alias("group_size"))
        rest = marked.where("hot_size IS NULL").select("id", "digest").join(index.hint("merge"), "digest").select("id", "digest", "keep_id", "group_size")
        return found.unionByName(rest)


def annotate(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text", batches: int = 1) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256 (lower-case hex of the normalised text).

    ``batches``: ranges of ids in which the rows come to the index, the largest ids first, so that later ones meet a
    filled index and the answer is that of one batch. Rows with a null id come last.
    """
    rows = written(digests(docs, id_col, text_col), "digests")
    if batches == 1:
        found = index.dedup(rows)
    else:
        sizes = written(rows.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size")), "digest-sizes")
        low, high = rows.agg(F.min("id"), F.max("id")).first()
        cuts = [] if low is None else [low + (high - low + 1) * k // batches for k in range(batches)]
        found, top = None, None
        for cut in [*reversed(cuts), None]:
            some = F.col("id").isNull() if cut is None else (F.col("id") >= cut) & (F.lit(True) if top is None else F.col("id") < top)
            part, top = written(index.dedup(rows.where(some), sizes), "digest-batch"), cut
            found = part if found is None else found.unionByName(part)
    return found.select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
