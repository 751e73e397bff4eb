"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from scorelake.session import shared_dir

# Words are runs of anything but ASCII white space; this is their separator, for Spark's regular expressions.
GAP = r"[\x20\x09-\x0D]+"
# Rows that Spark may broadcast; one takes about 120 bytes on the driver, several times what it takes in a file.
MOST_BROADCAST = 500_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    """A top-level column, whatever characters its name has."""
    return F.col(quoted(name))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or with underscores in front where the table has a column of that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def text_of(name: str = "text") -> Column:
    return F.coalesce(col(name).cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A to Z in lower case and nothing else changed."""
    return F.translate(text, _UPPER, _LOWER)


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """The rows written once to the shared folder and read back: lineage ends here and sizes are known."""
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def merge_beyond(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` as a side of a join: beyond ``MOST_BROADCAST`` rows it asks for a sort-merge join, below Spark decides. ``rows`` is its count, or a bound of it,
    where known; else the rows are counted, so they should be stored. Spark goes by sizes of files, and leaves out what an explode multiplies them by."""
    return df.hint("merge") if (df.count() if rows is None else rows) > MOST_BROADCAST else df


def small_batches(spark: SparkSession, rows: int = 256, size: int = 16 << 20) -> None:
    """Arrow batches of few rows and bytes, since one row can hold a very long text."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def bucket_of(value: Column) -> Column:
    """Log-linear bucket of a whole number of at least 0."""
    top = F.length(F.bin(value)) - 1
    fine = F.call_function("shiftright", value, F.greatest(top - 5, F.lit(0))).bitwiseAND(31)
    return F.when(value < 32, value.cast("int")).otherwise((top * 32 + fine - 128).cast("int"))


def bucket_floor(bucket: Column) -> Column:
    """The least value of a bucket."""
    scaled = bucket + 128
    return F.when(bucket < 32, bucket.cast("long")).otherwise(
        F.call_function("shiftleft", (F.lit(32) + scaled % 32).cast("long"), (F.floor(scaled / 32) - 5).cast("int")))


def most_frequent(counts: DataFrame, k: int) -> list[Row]:
    """The ``k`` rows of a stored table (word, n) with the largest n, ties by word.

    The log-linear buckets of n tell how far down the first k reach; only rows from there on are ranked, so what comes to the
    driver is k rows and the last bucket at most, and not k rows from every task.
    """
    floor, seen = 0, 0
    buckets = counts.groupBy(bucket_of(F.col("n")).alias("b")).agg(F.count(F.lit(1)).alias("rows"), F.min("n").alias("least")).collect()
    for row in sorted(buckets, key=lambda r: -r["b"]):
        floor, seen = row["least"], seen + row["rows"]
        if seen >= k:
            break
    return counts.where(F.col("n") >= floor).orderBy(F.desc("n"), "word").limit(k).collect()
