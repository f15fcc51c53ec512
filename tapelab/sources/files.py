"""File sources and sinks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share; a local one where none is named and there is no cluster."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-tapelab-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back, for steps that go through its rows more than once."""
    at = shared_path(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


#: Keys that differ only beyond their last bits share a folder: 64 folders, however many keys there are.
FOLDER_BITS = 6


def write_folders(df: DataFrame, path: str, key: str, bits: int = FOLDER_BITS) -> None:
    """CSV files in 2^bits folders named by the last bits of a whole-number ``key``; a file has many keys, and as its last column what its folder leaves of them.

    A folder (and a file) for each key costs far more than its rows where keys are many. Rows are dealt by folder in parts of bounded size, so that a large folder is several files.
    """
    k = F.col(key).cast("long")
    out = df.select(*(c for c in df.columns if c != key), F.shiftright(k, bits).alias(key), k.bitwiseAND(F.lit((1 << bits) - 1)).alias("folder"))
    out.hint("rebalance", "folder").write.partitionBy("folder").csv(path, header=True)


def folder_key(key: str, bits: int = FOLDER_BITS) -> Column:
    """The whole key of rows written by :func:`write_folders`."""
    return F.shiftleft(F.col(key).cast("long"), bits).bitwiseOR(F.col("folder").cast("long"))


def read_bars(spark: SparkSession, path: str, schema: str, bits: int | None = None) -> DataFrame:
    """CSV bars with epoch milliseconds, in a folder per ticker (ticker=...) or, with ``bits``, as :func:`write_folders` leaves them: ``ts`` in UTC and ``ticker``."""
    raw = spark.read.schema(f"{schema}, ticker long" + ", folder long" * (bits is not None)).csv(path, header=True).withColumn("ts", F.timestamp_millis("timestamp"))
    return raw if bits is None else raw.withColumn("ticker", folder_key("ticker", bits)).drop("folder")


def read_grouped_daily(spark: SparkSession, path: str) -> DataFrame:
    """The whole market in a folder per day (day=...): numbers coerced, rows without a close dropped."""
    raw = spark.read.schema("ticker string, open string, close string, volume string, day date").csv(path, header=True)
    num = {c: F.col(c).try_cast("double") for c in ("open", "close", "volume")}
    return raw.withColumns(num | {"ticker": F.col("ticker").try_cast("long")}).filter(F.col("close").isNotNull()).withColumnRenamed("day", "date")


def read_vendor_daily(spark: SparkSession, path: str) -> DataFrame:
    """A vendor's history: the first column is the date, whatever its name; bad values become null, rows without date or close go."""
    raw = spark.read.csv(path, header=True)
    first, rest = raw.columns[0], raw.columns[1:]
    out = raw.select(F.col(f"`{first}`").try_cast("date").alias("date"), *(F.col(f"`{c}`").try_cast("double").alias(c.lower().replace(" ", "_")) for c in rest))
    return out.filter(F.col("date").isNotNull() & F.col("close").isNotNull())


def read_optional(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Parquet at ``path``, or an empty table of the schema where nothing is there."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def flatten_facts(df: DataFrame, key: str, body: str, concepts: list[str], unit: str) -> DataFrame:
    """A row per fact of nested company facts, for some concepts and one unit; facts without a start are left out."""
    fact = "array<struct<start:date,end:date,val:double,filed:date,accn:string>>"
    parsed = df.select(key, F.from_json(body, f"facts map<string, map<string, struct<units:map<string, {fact}>>>>").alias("b"))
    by_concept = parsed.select(key, F.explode(F.col("b.facts")["us-gaap"]).alias("concept", "c")).filter(F.col("concept").isin(concepts))
    return by_concept.select(key, "concept", F.inline(F.col("c.units")[unit])).filter(F.col("start").isNotNull())


def flatten_filings(df: DataFrame, key: str) -> DataFrame:
    """key, filing_date of earnings releases (8-K with item 2.02), from parallel arrays; one a day."""
    z = df.select(key, F.explode(F.arrays_zip("form", "filingDate", "items")).alias("f"))
    return z.filter((F.col("f.form") == "8-K") & F.col("f.items").contains("2.02")).select(key, F.col("f.filingDate").cast("date").alias("filing_date")).dropDuplicates()


def common_universe(spark: SparkSession, path: str, not_common: str, exchanges: dict[str, str]) -> DataFrame:
    """symbol, exchange of listed common stocks: the footer, test issues, odd symbols and names that match ``not_common`` are dropped."""
    raw = spark.read.option("sep", "|").schema("symbol string, name string, exchange string, test string").csv(path, header=True)
    names = spark.createDataFrame(list(exchanges.items()), "code string, label string")
    ok = ~F.col("symbol").startswith("File Creation Time") & (F.col("test") == "N") & ~F.col("symbol").rlike(r"[$^#]") & ~F.col("name").rlike(not_common)
    x = raw.filter(ok).join(F.broadcast(names), F.col("exchange") == F.col("code"), "left")
    return x.select(F.translate("symbol", ".", "-").alias("symbol"), F.coalesce("label", F.lit("OTHER")).alias("exchange")).dropDuplicates(["symbol"])


def write_price_cache(bars: DataFrame, path: str, buckets: int) -> None:
    """Closes by bucket of the ticker, so that a read of some tickers prunes folders."""
    bars.filter(F.col("close").isNotNull()).withColumn("bucket", F.pmod("ticker", F.lit(buckets)).cast("int")).repartition("bucket").write.partitionBy("bucket").parquet(path)


def read_price_cache(spark: SparkSession, path: str, buckets: int) -> DataFrame:
    return spark.read.parquet(path)


def validated(df: DataFrame, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with all required fields, and the others."""
    good = F.lit(True)
    for c in required:
        good = good & F.col(c).isNotNull()
    return df.filter(good), df.filter(~good)
