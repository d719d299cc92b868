"""Shared helpers: table reading, spooling to the shared folder, text expressions."""

from __future__ import annotations

import atexit
import math
import uuid
from collections.abc import Callable
from contextlib import suppress

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space separates words everywhere in this subpackage.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

_spooled: list[tuple[SparkSession, str]] = []


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only in local mode, where they are one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "/tmp/checkpoints/lectern"
    return root.rstrip("/")


def spool(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage with a copy every executor can reach, so a lost executor
    costs no recomputation, and gives the planner true sizes for its join choices.
    """
    spark = df.sparkSession
    path = track(spark, f"{shared_dir(spark)}/spool-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def track(spark: SparkSession, path: str) -> str:
    """``path``, which goes when the session's Python process ends."""
    _spooled.append((spark, path))
    return path


def _clean() -> None:
    for spark, path in _spooled:
        with suppress(Exception):  # the session may have ended; the other folders are still tried
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


atexit.register(_clean)


def bounded_batches(spark: SparkSession) -> None:
    """Small Arrow batches, by rows and bytes, so that a worker's memory is taken by its work.

    For the queries and stages, which own their session; operators leave its settings alone and work with any.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def carried(docs: DataFrame, *needed: str) -> DataFrame:
    """The needed columns, and all others in one struct, so that no name clashes with an operator's own."""
    others = [F.col(f"`{c.replace('`', '``')}`") for c in docs.columns if c not in needed]
    return docs.select(*needed, F.struct(*others or [F.lit(None).cast("int").alias("none")]).alias("carried"))


def restored(rows: DataFrame, columns: list[str], needed: tuple[str, ...], **changed: Column) -> DataFrame:
    """The columns as they were before :func:`carried`; those in ``changed`` with new values."""
    return rows.select(*[changed[c].alias(c) if c in changed else F.col(c) if c in needed else F.col("carried").getField(c).alias(c) for c in columns])


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def text_digest() -> Column:
    """What two rows of equal text share, and (but for forged texts) no others."""
    return F.unhex(F.md5(text_or_empty()))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD_PATTERN)).cast("long")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once per row."""
    return F.transform(F.array(value), body)[0]


def cuts_up_to(cuts: list, value: Column) -> Column:
    """How many of the sorted ``cuts`` are not above ``value``, by bisection."""
    if not cuts:
        return F.lit(0)
    steps = [1 << k for k in range(len(cuts).bit_length() - 1, -1, -1)]
    table = F.lit(cuts)
    return F.aggregate(F.lit(steps), F.lit(0), lambda at, step: F.when(F.coalesce(F.get(table, at + step - 1) <= value, F.lit(False)), at + step).otherwise(at))


def own_partitions(df: DataFrame, n: int, part: Column, name: str) -> DataFrame:
    """``df`` dealt by ``part`` (0 to n - 1), each part to a partition of its own; ``name`` is the part's key from then on.

    The keys are numbers whose hashes fall into one partition each, so that no two parts meet in one task and the
    engine still knows how the rows are dealt.
    """
    spark = df.sparkSession
    tried = spark.range(int(n * (math.log(n + 1) + 12)))
    found = tried.groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("p")).agg(F.min("id").alias("id")).collect()
    keys = {r["p"]: r["id"] for r in found}
    key = F.element_at(F.lit([keys.get(k, k) for k in range(n)]).cast("array<long>"), part + 1)
    return df.withColumn(name, key).repartition(n, name)
