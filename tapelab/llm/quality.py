"""Two quality operators on document statistics: a classifier, and rules with a monotone model behind them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapelab.llm import gbdt
from tapelab.llm.common import fold
from tapelab.llm.textstats import FEATURES, with_statistics

#: At most about so many labelled rows are used to fit a model: rows of the training folds whose hash of the id falls
#: below the share that gives this many.
MAX_TRAINING_ROWS = 20_000
#: The classifier's cut.
THRESHOLD = 0.3
#: The rules reject only below this score.
REJECT_BELOW = 0.15
#: More of these never makes a document better (for the rules).
MONOTONE = {"symbol_ratio": -1, "dup_line_ratio": -1, "repeat_ratio": -1, "bang_ratio": -1, "bar_ratio": -1, "digit_ratio": -1, "upper_ratio": -1}


def training_sample(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS, label: str = "quality") -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of labelled documents outside the held-out fold (crc32(doc_id) mod 5 = 0).

    A bounded sample by hash of the id, the same whatever the partitioning. A document labelled several times takes the
    larger mean side (ties: 1), and of texts of one id the one with the least features is taken; null ids, null labels and labels without a document are left out.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (fold("doc_id", 5) != 0)).groupBy("doc_id").agg(F.avg(label).alias("y"))
    known = known.select(F.col("doc_id").alias("labelled_id"), (F.col("y") >= 0.5).cast("int").alias("y"))
    total = known.count()
    if total > max_rows:
        known = known.filter(F.shiftrightunsigned(F.xxhash64("labelled_id"), 1) < int(2**63 * max_rows / total))
    rows = docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("labelled_id")).select("y", "doc_id", "text")

    def finish(carried, counts, features):
        return [carried[0], carried[1], pa.array(list(features), pa.list_(pa.float64()))]

    found = with_statistics(rows, ["y", "doc_id"], finish, "y int, doc_id long, x array<double>")
    got = found.groupBy("doc_id").agg(F.min(F.struct("x", "y")).alias("r")).select("doc_id", "r.*").toPandas()  # an id that repeats counts once
    got = got.sort_values("doc_id", kind="stable")  # the fit doesn't depend on the partitioning
    return np.array(got["x"].tolist(), np.float64).reshape(len(got), len(FEATURES)), got["y"].to_numpy(np.int64)


def classifier(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS) -> gbdt.Trees:
    return gbdt.fit(*training_sample(docs, labels, max_rows))


def rules_model(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS) -> gbdt.Trees:
    return gbdt.fit(*training_sample(docs, labels, max_rows), monotone={FEATURES.index(k): v for k, v in MONOTONE.items()}, trees=60, depth=3)


def classify(docs: DataFrame, model: gbdt.Trees, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score (likelihood of label 1), predicted; one row per row of ``docs``.

    Null and empty texts are scored by their (zero) statistics. A null doc_id is in no fold: held_out is null.
    """

    def finish(carried, counts, features):
        score = model.predict(features)
        return [*carried, pa.array(score), pa.array((score >= threshold).astype(np.int32))]

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold("doc_id", 5) == 0).alias("held_out"), "text")
    return with_statistics(rows, ["doc_id", "held_out"], finish, "doc_id long, held_out boolean, score double, predicted int")


def apply_rules(docs: DataFrame, model: gbdt.Trees, reject_below: float = REJECT_BELOW) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept.

    The base rules fail documents of fewer than 50 words, or of which more than half of the words repeat. Of the others
    the monotone model rejects those that it scores below ``reject_below``. Null texts are empty: they fail.
    """

    def finish(carried, counts, features):
        failed = (counts[:, 0] < 50) | (100 * counts[:, 4] > 50 * counts[:, 0])
        score = model.predict(features)
        return [carried[0], *(pa.array(c) for c in counts.T), pa.array(failed), pa.array(score), pa.array(~failed & (score >= reject_below))]

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean"
    return with_statistics(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id"], finish, schema)


def filter_rows(docs: DataFrame, model: gbdt.Trees, keep) -> DataFrame:
    """The rows of ``docs``, all their columns, for which ``keep(counts, features)`` holds; texts don't travel for it.

    Null texts are judged as empty ones; rows that repeat are kept or dropped together; an empty table gives no rows.
    """
    names = docs.columns
    at = names.index("text")

    from tapelab.llm.textstats import statistics

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, 1024):
                part = b.slice(k, 1024)
                both = [statistics(t) for t in part.column(at).to_pylist()]
                mask = keep(np.array([x[0] for x in both], np.int64), np.array([x[1] for x in both]), model)
                yield part.filter(pa.array(mask))

    return docs.mapInArrow(run, docs.schema)


def passes_rules(counts: np.ndarray, features: np.ndarray, model: gbdt.Trees) -> np.ndarray:
    return (counts[:, 0] >= 50) & (100 * counts[:, 4] <= 50 * counts[:, 0]) & (model.predict(features) >= REJECT_BELOW)


def passes_classifier(counts: np.ndarray, features: np.ndarray, model: gbdt.Trees) -> np.ndarray:
    return model.predict(features) >= THRESHOLD
