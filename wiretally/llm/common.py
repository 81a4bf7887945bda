"""Reading tables, staging results in the cluster's shared folder, plain text expressions."""

from __future__ import annotations

import string
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

# A word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the one of ``spark.checkpoint.dir`` or ``setCheckpointDir``. A local
    session without either gets a temporary folder; a cluster without one is
    an error, since its machines share no local path.
    """
    context = spark.sparkContext
    folder = context.getCheckpointDir()
    if folder:
        return folder
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="shared-")
    context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    The copy cuts the lineage and outlives executors. It stays in that folder
    until the folder is cleaned, as checkpoints do.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def lower_ascii(text: Column) -> Column:
    """``text`` with A-Z lower-cased and every other character kept."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def bounded_sample(rows: DataFrame, n: int, seed: int, *columns: str) -> DataFrame:
    """The first ``n`` rows of different ``columns`` by a seeded hash of these.

    A share of the hash's range that holds about twice ``n`` different values is
    cut out where rows are read, and copies meet before the shuffle, so neither
    the table's size nor a value in most of its rows adds to what is sorted.
    """
    hashed = rows.withColumn("_hash", F.xxhash64(F.lit(seed), *columns))
    different = hashed.agg(F.approx_count_distinct("_hash")).head()[0]
    share = min(1.0, (2.0 * n + 100) / max(1, different))
    cut = hashed.where(F.abs("_hash") <= share * 2.0**63).dropDuplicates(list(columns))
    return cut.orderBy("_hash", *columns).limit(n).drop("_hash")


def bounded_sample_by(rows: DataFrame, n: int, seed: int, by: str, *columns: str) -> DataFrame:
    """``bounded_sample`` of each value of ``by``; there must be a bounded number of these."""
    hashed = rows.withColumn("_hash", F.xxhash64(F.lit(seed), *columns))
    # Staged, so that its size is known and rows of a common group are not shuffled to meet it.
    counts = staged(
        hashed.groupBy(F.col(by).alias("_by")).agg(F.approx_count_distinct("_hash").alias("_n")), "counts"
    )
    near = F.abs("_hash") <= (2.0 * n + 100) / F.greatest("_n", F.lit(1)) * 2.0**63
    first = F.row_number().over(Window.partitionBy(by).orderBy("_hash", *columns))
    return (
        hashed.join(counts, F.col(by) == F.col("_by"))
        .where(near)
        .dropDuplicates([by, *columns])
        .withColumn("_rank", first)
        .where(F.col("_rank") <= n)
        .drop("_hash", "_by", "_n", "_rank")
    )


def with_field(df: DataFrame, name: str, kind: DataType) -> StructType:
    """The schema of ``df`` with one more column."""
    return StructType([*df.schema.fields, StructField(name, kind)])


def fold(doc_id: Column) -> Column:
    """The number 0, 1 or 2 that says which fold a document is in; 1 is held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3
