"""What the corpus operators share: the shared work folder, written steps, and the normal form of the documents table."""

from __future__ import annotations

import contextlib
import re
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Used only where a local session names no shared folder (single-machine tests).
FALLBACK_DIR = "/tmp/checkpoints"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def work_dir(spark: SparkSession, name: str) -> str:
    """A new path below the folder that all executors share (``spark.checkpoint.dir``)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and re.match(r"local(\[|$)", spark.sparkContext.master):
        base = FALLBACK_DIR
    if not base:
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{base.rstrip('/')}/tidemark/{name}-{uuid.uuid4().hex[:12]}"


@contextlib.contextmanager
def conf(spark: SparkSession, **settings: str) -> Iterator[None]:
    """Set session options (``__`` stands for a dot) and put the old values back."""
    names = {k.replace("__", "."): v for k, v in settings.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Cut the lineage: write ``df`` into the shared folder and read it back. Its shuffle files go once it is written."""
    spark, path = df.sparkSession, work_dir(df.sparkSession, name)
    with conf(spark, **{CLEANUP.replace(".", "__"): "true"}):
        df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a step that ``written`` made and that nothing reads any more."""
    spark = df.sparkSession
    for file in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/tidemark/" in file:
            path = spark._jvm.org.apache.hadoop.fs.Path(file)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII goes the fast way; other texts keep every other letter as it is."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def unused(docs: DataFrame, name: str) -> str:
    """The name, with underscores added until no column has it."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows of a written table of ids that are broadcast at most (tens of MB); beyond it, the join shuffles.
MAX_BROADCAST = 2_000_000


def bounded(small: DataFrame) -> DataFrame:
    """A written table of ids: broadcast where it has ``MAX_BROADCAST`` rows at most."""
    return F.broadcast(small) if small.count() <= MAX_BROADCAST else small
