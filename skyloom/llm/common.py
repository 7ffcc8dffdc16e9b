"""Shared helpers: table loading, scratch tables in the shared folder, label loading."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch handed to Python; they bound a worker's memory with long texts.
ARROW_ROWS, ARROW_BYTES = 1000, 4 << 20


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small: texts can be very long.

    Spark reads these two settings when a query runs, after the operator has returned, so they stay as they are put here;
    smaller values of the session are left alone.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)):
        now = str(spark.conf.get(key)).lower().removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the folder that driver and executors share.

    Only a session in which everything runs in one process may go without such a folder; it gets one in the driver's
    temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = os.path.join(tempfile.gettempdir(), "checkpoints")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


#: Tables that workspaces in use have to clear away.
_made: list[list[DataFrame]] = []


def written(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    if _made:
        _made[-1].append(out)
    return out


@contextmanager
def workspace():
    """Yields a list of the tables to keep; all others that were written inside are deleted at the end, when nothing that
    is still to be computed may depend on them."""
    keep: list[DataFrame] = []
    _made.append([])
    try:
        yield keep
    finally:
        made = _made.pop()
        for t in made:
            if not any(t is k for k in keep):
                jvm = t.sparkSession._jvm
                path = jvm.org.apache.hadoop.fs.Path(t.scratch)
                path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
        if _made:
            _made[-1].extend(t for t in made if any(t is k for k in keep))


def narrow(docs: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra columns with clashing names cannot interfere."""
    return docs.select(*[docs[n].alias(n) for n in names])


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of docs has."""
    taken, out = {c.lower() for c in docs.columns}, []
    for n in names:
        while n in taken:
            n = "_" + n
        taken.add(n)
        out.append(n)
    return out


def crc_mod(doc_id, n: int):
    """crc32 of the decimal text of doc_id, modulo n."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def uniform(doc_id):
    """A number in [0, 1) from a hash of the id."""
    return F.shiftrightunsigned(F.xxhash64(doc_id), 11).cast("double") / F.lit(float(1 << 53))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, keep, bound: int) -> DataFrame:
    """At most `bound` labelled training rows (text, y), taken in hash order of doc_id.

    Of many labels, only about twice as many as needed are ranked. Rows with a null label or id do not train; ties in the
    hash are broken by doc_id.
    """
    ids = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
        .where(keep(F.col("doc_id"))).withColumn("u", uniform(F.col("doc_id")))
    )
    n = ids.count()
    chosen = ids.where(F.col("u") * n < 2.0 * bound).orderBy("u", "doc_id").limit(bound).drop("u")
    return narrow(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id").select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text"), "y"
    )
