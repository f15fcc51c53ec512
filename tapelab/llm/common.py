"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Texts can be long: batches that go to Python workers are bounded in bytes, not only in rows.
BATCH_BYTES = "4m"


def bounded(df: DataFrame) -> DataFrame:
    """``df``, whose session sends Arrow batches of BATCH_BYTES, unless its configuration names another size."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not df.sparkSession.sparkContext.getConf().contains(key):
        df.sparkSession.conf.set(key, BATCH_BYTES)
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return bounded(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that is unset, a local master (tests) gets a new folder; on a cluster a folder of one machine would lose rows, so that fails.
    """
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="spark-tapelab-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts the lineage and survives the loss of any executor."""
    spark = df.sparkSession
    at = scratch(spark, name)
    df.write.parquet(at)
    out = spark.read.schema(df.schema).parquet(at)
    out.stored_at = at
    return out


def forget(*dfs: DataFrame) -> None:
    """Deletes tables written by :func:`stored` once nothing that is still to run reads them."""
    for df in dfs:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fold(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``: the fold that the learned operators hold out by."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(col.cast("string").cast("binary")), F.lit(modulus))


#: Runs of bytes between blanks, tabs, line feeds, vertical tabs, form feeds and carriage returns are words.
BLANKS = "\x20\x09-\x0d"


def ascii_lower(col: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often ``body`` uses it, also inside its lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def hot_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """``left`` joined with ``right``, which has a row per key and was aggregated by it, where a key may hold many rows of ``left``.

    An aggregate's output is already dealt by its key, and the join would run in its stage, where Spark can't split a hot
    key. The first key is therefore compared through an expression: both sides get an exchange of their own (the right
    one is small), and adaptive execution splits the hot partitions.
    """
    names = {c: f"__{c}" for c in on}
    r = right.select(*(F.col(c).alias(names.get(c, c)) for c in right.columns))

    def own(c: str) -> Column:
        text = dict(right.dtypes)[on[0]] == "string"
        return F.concat(F.lit("~"), F.col(c)) if text else F.col(c).bitwiseXOR(F.lit(1))

    match = own(on[0]) == own(names[on[0]])
    for c in on[1:]:
        match = match & (F.col(c) == F.col(names[c]))
    return left.join(r, match, how).drop(*names.values())
