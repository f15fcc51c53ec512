"""Work state that survives restarts: per key done, failed or pending, and how many attempts it took.

The state is a folder of versions. Each batch of results writes the keys that it changes as one version, under the batch's
number; now and then a version holds all keys, so that a reader needs few. A version counts only once Spark has committed it (its _SUCCESS
is there): a batch that failed halfway is written again, and one that is replayed after its commit changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Every so many versions, one holds all keys.
WHOLE_EVERY = 8


class WorkState:
    """States of keys in the folder ``at``, which all machines share. ``key_type`` is the key's type.

    A key that is done stays done. A failed one is tried again until ``most`` attempts; a pending one at least once more.
    """

    def __init__(self, spark: SparkSession, at: str, key_type: str = "long", most: int = 3):
        self.spark, self.at, self.most = spark, at.rstrip("/"), most
        self.schema = f"key {key_type}, status string, attempts long, result string, error string, version long"

    def _folder(self, version: int, whole: bool) -> str:
        return f"{self.at}/{'whole' if whole else 'change'}-{version:012d}"

    def versions(self) -> list[tuple[int, bool]]:
        """(number, whether it holds all keys) of committed versions, in order."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.at)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(path)]
        done = [n for n in names if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.at}/{n}/_SUCCESS"))]
        return sorted((int(n.rpartition("-")[2]), n.startswith("whole")) for n in done)

    def read(self, before: int | None = None) -> DataFrame:
        """The state of every key, as of the versions below ``before`` (all, if None)."""
        known = [(v, w) for v, w in self.versions() if before is None or v < before]
        last = max((v for v, w in known if w), default=-1)
        paths = [self._folder(v, w) for v, w in known if (w and v == last) or (not w and v > last)]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        rest = ("status", "attempts", "result", "error", "version")
        found = self.spark.read.schema(self.schema).parquet(*paths)
        return found.groupBy("key").agg(F.max_by(F.struct(*rest), "version").alias("s")).select("key", "s.*")

    def _write(self, rows: DataFrame, version: int) -> None:
        self.save(rows.withColumn("version", F.lit(version).cast("long")), self._folder(version, False))
        if version % WHOLE_EVERY == WHOLE_EVERY - 1:
            self.save(self.read(before=version + 1), self._folder(version, True))

    def save(self, rows: DataFrame, folder: str) -> None:
        rows.select("key", "status", "attempts", "result", "error", "version").write.mode("overwrite").parquet(folder)

    def apply(self, results: DataFrame, version: int, order: list[str]) -> None:
        """Takes a batch of ``results`` (key, ok, result, error and the columns of ``order``) in as version ``version``; for foreachBatch.

        Of a key's results, in order, those count that would have been tried: up to the first that is ok, and no more failed ones than are left.
        Null keys are left out; a version that is there already changes nothing.
        """
        if any(v >= version for v, _ in self.versions()):
            return
        before = self.read(before=version).select("key", F.col("status").alias("was"), F.col("attempts").alias("had"))
        had, was = F.coalesce("had", F.lit(0)), F.coalesce("was", F.lit("pending"))
        left = F.when(was == "done", 0).when(was == "failed", F.greatest(self.most - had, F.lit(0))).otherwise(F.greatest(self.most - had, F.lit(1)))
        w = Window.partitionBy("key").orderBy(*order)
        tried = results.filter(F.col("key").isNotNull()).withColumns({"nth": F.row_number().over(w), "done": F.coalesce(F.sum(F.col("ok").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
        tried = tried.filter("done = 0").join(before, "key", "left").filter(F.col("nth") <= left)
        last = tried.groupBy("key").agg((F.max(had) + F.count(F.lit(1))).alias("attempts"), F.max_by(F.struct("ok", "result", "error"), "nth").alias("x"))
        rows = last.select("key", F.when(F.col("x.ok"), "done").otherwise("failed").alias("status"), F.col("attempts").cast("long").alias("attempts"), F.when(F.col("x.ok"), F.col("x.result")).alias("result"), F.when(~F.col("x.ok"), F.col("x.error")).alias("error"))
        self._write(rows, version)

    def reset_failed(self, version: int) -> None:
        """All failed keys become pending, with the attempts they had, as version ``version``."""
        if not any(v >= version for v, _ in self.versions()):
            self._write(self.read(before=version).filter("status = 'failed'").withColumn("status", F.lit("pending")), version)

    def to_do(self, keys: DataFrame) -> DataFrame:
        """The ``keys`` (one column, key) still to be tried: new, pending, and failed ones with attempts left."""
        over = self.read().filter((F.col("status") == "done") | ((F.col("status") == "failed") & (F.col("attempts") >= self.most)))
        return keys.join(over.select("key"), "key", "left_anti")

    def counts(self, keys: DataFrame) -> DataFrame:
        """status, n over ``keys``; keys without a state are pending."""
        return keys.join(self.read(), "key", "left").groupBy(F.coalesce("status", F.lit("pending")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


def fold_stream(results: DataFrame, state: WorkState, checkpoint: str, order: list[str]) -> None:
    """Takes in all that a stream of results holds now, a version a batch; a later call goes on from there."""
    q = results.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, batch: state.apply(df, batch, order)).start()
    q.awaitTermination()


def attempt(ok: Column, result: Column, error: Column) -> list[Column]:
    """Columns of a result as :meth:`WorkState.apply` takes them."""
    return [ok.alias("ok"), result.cast("string").alias("result"), error.cast("string").alias("error")]
