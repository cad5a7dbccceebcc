"""Helpers that the operators share: the shared folder, splits, lower-casing, hot-key-safe joins."""

from __future__ import annotations

import gc
import os
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType, StructField

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Rows up to which a table is broadcast; beyond it, joins shuffle.
BROADCAST_ROWS = 200_000
#: Bytes up to which it is broadcast.
BROADCAST_BYTES = 64 << 20
#: Bits of a sieve.
SIEVE = 1 << 23
#: Bytes of a row group of an intermediate table, which a writer holds.
GROUP_BYTES = 16 << 20
#: Bytes of an Arrow batch, so that two workers with long texts fit beside a small executor's heap.
BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir. Where that is unset, a local master gets one of its own; a cluster has none that all of it sees, so that is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + os.path.join(tempfile.gettempdir(), f"tessera-{os.getpid()}")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path for one table in the shared folder."""
    return f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"


def local_path(uri: str) -> str:
    """The mounted path of a file: URI. Memory-mapping needs the shared folder mounted on every worker."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    if "://" in uri:
        raise ValueError(f"{uri} is not a mounted folder; set spark.checkpoint.dir to one that all workers mount")
    return uri


def rested(spark: SparkSession) -> None:
    """Ask the executors' JVMs to hand back the heap that they don't use, so that Python workers fit beside them: a collection each, by a job of as many tasks as cores."""
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.reflect(F.lit("java.lang.System"), F.lit("gc"))).write.format("noop").mode("overwrite").save()


def _release(spark: SparkSession) -> None:
    """Let the driver forget the queries that have ended, by which their shuffle files go, and the executors their garbage.

    The event that ends a query holds its plan, and a listener's thread holds the last event: so an empty query goes after it.
    """
    spark.range(0).limit(0).collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(60_000)
    gc.collect()
    spark._jvm.System.gc()
    rested(spark)


def saved(df: DataFrame, name: str, release: bool = False) -> DataFrame:
    """Write df to the shared folder and read it again: cuts the lineage, survives lost executors.

    release: the shuffle files of the steps before, which nobody needs any more, go first and not when the driver happens to collect its garbage.
    """
    if release:
        _release(df.sparkSession)
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("parquet.block.size", GROUP_BYTES).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete a table that saved() wrote and nobody reads any more."""
    spark = df.sparkSession
    for f in {os.path.dirname(x) for x in df.inputFiles()}:
        if "/tessera/" in f:
            path = spark._jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _bytes(field: StructField) -> Column:
    """About the bytes of a column's value in a row."""
    c, kind = F.col(f"`{field.name}`"), field.dataType
    if isinstance(kind, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(kind, ArrayType):
        one = F.aggregate(c, F.lit(0).cast("long"), lambda n, x: n + F.coalesce(F.octet_length(x), F.lit(0)) + 16) if isinstance(kind.elementType, (StringType, BinaryType)) else 8 * F.size(c)
        return F.coalesce(one, F.lit(0)) + 16
    return F.lit(16)


def small(df: DataFrame, rows: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint only if a count shows that it has few rows, and at most so many bytes in them; else df itself."""
    size = sum((_bytes(f) for f in df.schema.fields), F.lit(0)).cast("long")
    n, of = df.select(size.alias("size")).limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).collect()[0]
    return F.broadcast(df) if n <= rows and of <= most else df


def sieved(df: DataFrame, key: str, ids: DataFrame, flag: str, bits: int = SIEVE) -> DataFrame:
    """df with a column flag that is true where the key is among the ids (one column) and, by chance, for some others: rows where it is false need no join.

    A table of bits of fixed size is broadcast, however many ids there are.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    slot = lambda c: F.shiftright(place(c), 6)
    at = lambda c: F.pmod(place(c), F.lit(64)).cast("int")
    word, words = unused(df.columns, "sieve_slot", "sieve_word")
    powers = F.array(*[F.lit(1 << k if k < 63 else -(1 << 63)).cast("long") for k in range(64)])
    of = F.col(ids.columns[0])
    table = saved(ids.select(slot(of).alias(word), F.get(powers, at(of)).alias("bit")).groupBy(word).agg(F.bit_or("bit").alias(words)), "sieve")
    out = df.join(F.broadcast(table), slot(F.col(key)) == F.col(word), "left")
    return out.select(*df.columns, F.coalesce(F.getbit(words, at(F.col(key))) == 1, F.lit(False)).alias(flag))


def unused(columns: list[str], *wanted: str) -> list[str]:
    """The wanted names, each with as many underscores before it as make it clash with no column."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Characters beyond ASCII that lower() might change: upper and title case, and those that Java does not know yet.
CASED = r"[[^\x00-\x7F]&&[\p{IsUppercase}\p{Lt}\p{Cn}]]"


def lower_ascii(c: Column) -> Column:
    """A-Z lower-cased, all else as it is. lower() does the same, and faster, where nothing else has a case to change; only texts beyond ASCII are searched for that."""
    return F.when((F.length(c) != F.octet_length(c)) & c.rlike(CASED), F.translate(c, UPPER, UPPER.lower())).otherwise(F.lower(c))


def fold(id_col: str, mod: int) -> Column:
    """crc32 of the id as text, modulo mod; -1 for a null id, which is in no fold."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % mod, F.lit(-1))


def picked(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Only the named columns, under new names: others can't clash. Python workers get them in batches of bounded size."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in names.items()])
