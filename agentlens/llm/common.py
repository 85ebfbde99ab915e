"""What the operators of this subpackage share: tables, shared folders, tokens of a row."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that the contracts name: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE_CLASS = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a temporary folder (tests); a cluster is an error, because a folder of one
    machine would not be seen by the others.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    made = "file://" + tempfile.mkdtemp(prefix="agentlens-")
    spark.sparkContext.setCheckpointDir(made)
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: it outlives the executors that made it and cuts the lineage."""
    path = new_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: The largest groups that are broadcast; any other group holds no more than one in so many of all rows.
LARGEST = 1000


def met(left: DataFrame, groups: DataFrame, on: list[str], n: str, spread: list[str], hashed: bool = False) -> DataFrame:
    """``left`` and a column met: the columns of ``groups`` besides ``on``, null where there is none.

    ``groups`` is a written table with a row for each key and the key's number of rows, ``n``. The LARGEST groups are
    broadcast, which bounds what is sent; rows that find theirs there, or have no key, are dealt by ``spread`` instead,
    so that a key which holds a third of all rows does not meet in one task. All other rows are joined by the key;
    ``hashed``: without a sort of both sides, where a partition's share of the groups is small (a row for each key).
    """
    met_with = F.struct(*(c for c in groups.columns if c not in on))
    largest = groups.orderBy(F.desc(n), *on).limit(LARGEST).select(*on, met_with.alias("_large"))
    first = left.join(F.broadcast(largest), on, "left")
    # Where both sides derive the dealing column from the key, it is no condition more for rows that are still to meet.
    at = F.when(F.col("_large").isNull() & F.col(on[0]).isNotNull(), F.xxhash64(*on)).otherwise(F.xxhash64(*spread))
    rest = groups.select(*on, F.xxhash64(*on).alias("_at"), met_with.alias("_rest"))
    rest = rest.hint("shuffle_hash") if hashed else rest
    return first.withColumn("_at", at).join(rest, [*on, "_at"], "left").select(*left.columns, F.coalesce("_large", "_rest").alias("met"))


#: Rows of one key that a task takes in ``dealt_join``.
ROWS_A_PART = 2000


def dealt_join(left: DataFrame, right: DataFrame, on: str, by: str) -> DataFrame:
    """``left`` joined with ``right``, which has few rows of each key, where one key may hold any share of left's rows.

    Rows of left that are among the LARGEST keys are dealt to parts of ROWS_A_PART rows by ``by``; right's rows of these
    keys are repeated for every part. The LARGEST keys and their numbers of parts are all that is broadcast.
    """
    largest = left.groupBy(on).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > ROWS_A_PART).orderBy(F.desc("_n"), on).limit(LARGEST)
    parts = F.broadcast(largest.select(on, F.ceil(F.col("_n") / ROWS_A_PART).alias("_parts")))
    split = F.coalesce("_parts", F.lit(1))
    one = left.join(parts, on, "left").withColumn("_part", F.pmod(F.xxhash64(by), split)).drop("_parts")
    two = right.join(parts, on, "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), split - 1))).drop("_parts")
    return one.join(two, [on, "_part"]).drop("_part")


#: Bits of a bitmap of ids: so many for each id, to a power of two, and at most 2 ** MOST_BITS (128 MB).
BITS_AN_ID, MOST_BITS = 16, 30


def with_bit(rows: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """``rows`` and a column _bit: false only if the row's id is not in ``ids`` (a written table of one column), and nearly
    always then. A bitmap of bounded size is broadcast; nothing is shuffled."""
    bits = min(MOST_BITS, max(15, (ids.count() * BITS_AN_ID).bit_length()))
    at = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(1 << bits)) + 1
    found = ids.select(at(ids.columns[0]).alias("at")).groupBy(F.bitmap_bucket_number("at").alias("_block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("_set"))
    placed = rows.withColumn("_at", at(column)).withColumn("_block", F.bitmap_bucket_number("_at")).withColumn("_at", F.bitmap_bit_position("_at"))
    byte = F.expr("cast(conv(hex(substring(_set, cast(shiftright(_at, 3) as int) + 1, 1)), 16, 10) as int)")
    bit = F.expr("cast(_at & 7 as int)")
    return placed.join(F.broadcast(found), "_block", "left").withColumn("_bit", F.coalesce(F.call_function("shiftright", byte, bit).bitwiseAND(1) == 1, F.lit(False))).drop("_block", "_set", "_at")


def maybe_among(rows: DataFrame, ids: DataFrame, column: str = "doc_id") -> DataFrame:
    """The rows whose id is in ``ids`` (a written table of one column), and perhaps a few others, found where they are read:
    a bitmap of bounded size is broadcast, nothing is shuffled."""
    return with_bit(rows, ids, column).filter("_bit").drop("_bit")


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is not in ``gone`` (one column); null ids stay. Only rows that the bitmap of the
    gone ids does not clear meet the ids themselves; all other rows stay where they are read."""
    ids = written(gone.select(F.col(gone.columns[0]).cast("long").alias("_id")).filter("_id IS NOT NULL").distinct(), "gone")
    marked = with_bit(docs, ids, "doc_id")
    unsure = marked.filter("_bit").drop("_bit")
    return marked.filter("NOT _bit").drop("_bit").unionByName(unsure.join(ids, unsure["doc_id"].cast("long") == F.col("_id"), "left_anti"))


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a folder of ours through Spark's own file systems."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept back from fitting: crc32 of the id as text, modulo 3, is 1. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """For the actions inside: batches that go to Python hold at most ``rows`` rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Batches that go to Python hold fewer rows than Spark's 10,000, as a row here may be a very long text."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
