"""What the corpus operators share: inputs, row keys, lineage cuts, batch sizes."""

from __future__ import annotations

import atexit
import gc
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words, in every operator: blank and \t \n \v \f \r.
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rows and bytes in one Arrow batch; documents may be long, and two workers share an executor.
ARROW_ROWS = 1000
ARROW_BYTES = 32 << 20
#: Rows that Spark's Parquet reader decodes at once. A batch's texts lie in one array that doubles as it
#: grows: with Spark's 4096 rows of 2 KB each, up to 27 MB a task was seen, beside the arrays before it.
READER_ROWS = 256


def prepare(spark: SparkSession) -> SparkSession:
    """Small Arrow batches, so that a Python worker never holds many long texts at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return spark


def short_batches(spark: SparkSession) -> None:
    """Makes scans of long texts decode few rows at once. Like prepare(), a setting of the session, as scans read it when they run."""
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(READER_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's own shared folder. Where none is named: a fresh local one if driver and executors
    are one process, as in tests, else an error, since executors would not see each other's files."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", "") or sc.getCheckpointDir() or ""
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="checkpoint-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
        sc.setCheckpointDir(named)
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


def checkpointed(df: DataFrame) -> DataFrame:
    """The same rows read back from reliable storage: computed once, with no lineage before it."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Like checkpointed(), as a Parquet table: smaller on disk, read by column. It goes when the driver ends."""
    spark, schema = df.sparkSession, df.schema
    path = f"{shared_folder(spark).rstrip('/')}/quarry-{uuid.uuid4().hex}"
    df.write.parquet(path)
    del df  # if the caller does not hold it either, its shuffle files can go
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    release(spark)
    return spark.read.schema(schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished phases; it does so as the driver's garbage goes.
    Spark holds on to the last query that it ran, so a small one takes its place first."""
    spark.range(1).count()
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def row_hash(*cols: str | Column) -> Column:
    """128 bits (binary) that tell rows of the same id apart. Equal rows share them, and get equal results."""
    two = [F.xxhash64(F.lit(seed), *[F.col(c) if isinstance(c, str) else c for c in cols]) for seed in ("row", "row again")]
    return F.unhex(F.concat(*[F.lpad(F.hex(h), 16, "0") for h in two]))


HEAVY = 1000  # a key is heavy if it has more than a 1000th of all rows; there are fewer than 1000 such keys
SALTS = 64


def joined_salted(many: DataFrame, few: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """Inner join of many rows a key with one, so that no key is one task's work.

    few: a row a key (written or checkpointed, as it is read twice); weight: of how many rows of many it
    is the key. Rows of heavy keys are dealt over SALTS tasks; what is broadcast are under HEAVY keys.
    """
    total = few.agg(F.sum(weight)).first()[0] or 0
    is_heavy = F.col(weight) * HEAVY > total
    heavy = few.where(is_heavy).select(*keys, F.lit(True).alias("quarry_heavy"))
    deal = F.pmod(F.xxhash64(*[c for c in many.columns if c not in keys]), F.lit(SALTS)).cast("int")
    left = many.join(F.broadcast(heavy), keys, "left").withColumn("quarry_salt", F.when(F.col("quarry_heavy"), deal).otherwise(0)).drop("quarry_heavy")
    salts = F.when(is_heavy, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    right = few.withColumn("quarry_salt", F.explode(salts)).drop(weight)
    return left.join(right, [*keys, "quarry_salt"]).drop("quarry_salt")


def column_values(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def text_runs(texts: list[bytes], size: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about size bytes together; a longer one stands alone."""
    at, total = 0, 0
    for i, t in enumerate(texts):
        if total and total + len(t) > size:
            yield at, i
            at, total = i, 0
        total += len(t)
    if at < len(texts):
        yield at, len(texts)
