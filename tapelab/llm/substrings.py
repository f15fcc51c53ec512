"""Repeated passages by counts of content-defined blocks and of windows, in place of a relative Lempel-Ziv parse.

Every window of WINDOW words has a rarest place: the ANCHOR-word run in it with the least hash, the leftmost of equals.
Neighbouring windows with the same place are one block, so blocks depend on their own words only and equal passages are
cut into equal blocks but for their ends. Blocks are indexed by the hash of all their words.

There is no parse: no greedy longest match, and no order. Counts by hash stand in its place. A block that stands somewhere
else too is repeated as a whole. Where a block's anchor is found elsewhere but the block isn't, its windows are counted one
by one with those of the other blocks with that anchor. Blocks and windows found are at least WINDOW words, and join to
spans. A word is removed if a window that covers it stands twice, which the counts tell in full; a parse would need the
reference's text in the task that reads the document, and its factors would depend on the order of the corpus.

Nothing is sent in pairs: anchors, blocks and windows are counted by hash (partial sums first, so a passage that a third of
all rows share is as cheap as any), and the counts are joined back to places, a join that splits skewed keys.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapelab.llm.common import hot_join, stored
from tapelab.llm.wordhash import Words, mix, text_parts

WINDOW, ANCHOR = 35, 9
#: A place packs a block's first word and its number of words.
_BITS = 16


def cut_blocks(w: Words, window: int, anchor: int):
    """(text number, first word, words, anchor hash, block hash) of all blocks of a batch; words count from the text's first."""
    n = len(w.hash)
    if n < window:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    grams = w.run(np.arange(n - anchor + 1), anchor)
    width = window - anchor + 1
    low = np.uint64(2**30 - 1)
    v = (mix(grams) & ~low) | (np.arange(len(grams), dtype=np.uint64) & low)
    span = 1
    while span * 2 <= width:
        v = np.minimum(v[:-span], v[span:])
        span *= 2
    if span < width:
        v = np.minimum(v[: len(v) - (width - span)], v[width - span :])
    place = (v & low).astype(np.int64)  # of the least gram of the window that begins here
    inside = w.doc[: n - window + 1] == w.doc[window - 1 :]
    at = np.flatnonzero(inside)
    if not len(at):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    new = np.concatenate([[True], (place[at[1:]] != place[at[:-1]]) | (np.diff(at) > 1)])
    first = at[new]
    last = at[np.concatenate([new[1:], [True]])]
    words = last - first + window
    doc = w.doc[first]
    return doc, first - w.first[doc], words, grams[place[first]], w.run(first, words)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def places(keyed: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, text: str | Column = "text") -> DataFrame:
    """anchor, block, key, at: every block of every text."""

    def run(batches):
        for b in batches:
            keys = b.column(0).to_numpy(zero_copy_only=False)
            for i, j, texts in text_parts(b.column(1)):
                doc, first, words, a, block = cut_blocks(Words(texts), window, anchor)
                if len(doc):
                    yield pa.RecordBatch.from_arrays([_signed(a), _signed(block), pa.array(keys[i:j][doc]), pa.array((first << _BITS) | words)], ["anchor", "block", "key", "at"])

    return keyed.select("key", text).mapInArrow(run, "anchor long, block long, key long, at long")


def repeated_ranges(keyed: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, text: str | Column = "text") -> DataFrame:
    """key, ranges: for every text with a repeated window, its places (first word and number of words, packed) to remove.

    ``keyed`` has the text (``text``: its column) and a column ``key`` that is the same for rows with the same id and text only; other columns are no matter.
    """
    found = places(keyed, window, anchor, text)
    common = found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor")
    kept = stored(hot_join(found, common, ["anchor"], "left_semi"), "blocks")
    # the index: how often each block stands, and where it stands first
    index = kept.groupBy("anchor", "block").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "at")).alias("reference"))
    parsed = hot_join(kept, index, ["block", "anchor"])
    whole = parsed.filter("n > 1").select("key", "at")
    # windows of blocks that stand once, and, to compare with, of one of each block that stands more often
    check = parsed.filter("n = 1 or (key = reference.key and at = reference.at)").select("key", F.struct("at", (F.col("n") > 1).alias("known")).alias("place"))
    lists = check.groupBy("key").agg(F.collect_set("place").alias("todo"))

    def windows(batches):
        for b in batches:
            keys = b.column(1).to_numpy(zero_copy_only=False)
            for i, j, texts in text_parts(b.column(0)):
                w = Words(texts)
                at, known, key = [], [], []
                for d, places_ in enumerate(b.column(2).slice(i, j - i).to_pylist()):
                    for p in places_:
                        first, words = p["at"] >> _BITS, p["at"] & (2**_BITS - 1)
                        m = words - window + 1
                        at.append(np.arange(m) + (w.first[d] + first))
                        known.append(np.full(m, p["known"]))
                        key.append(np.full(m, keys[i + d]))
                if at:
                    at, known, key = np.concatenate(at), np.concatenate(known), np.concatenate(key)
                    where = ((at - w.first[w.doc[at]]) << _BITS) | window
                    yield pa.RecordBatch.from_arrays([_signed(w.run(at, window)), _signed(w.run(at, window, second=True)), pa.array(key), pa.array(where), pa.array(known)], ["h1", "h2", "key", "at", "known"])

    # every column of ``keyed`` is taken along, so that this join and the caller's read one exchange of the texts
    joined = keyed.join(lists, "key").select(text, "key", "todo", *(c for c in keyed.columns if c not in ("text", "key")))
    checked = joined.mapInArrow(windows, "h1 long, h2 long, key long, at long, known boolean")
    again = checked.groupBy("h1", "h2").agg(F.sum(F.when(F.col("known"), 2).otherwise(1)).alias("n")).filter("n > 1").select("h1", "h2")
    single = hot_join(checked.filter("not known"), again, ["h1", "h2"], "left_semi").select("key", "at")
    return whole.unionByName(single).groupBy("key").agg(F.collect_set("at").alias("ranges"))


def with_key(docs: DataFrame) -> DataFrame:
    return docs.withColumn("key", F.xxhash64("doc_id", "text"))


def covered(ranges: list[int] | None, n: int) -> np.ndarray:
    """Which of a text's words lie in a range."""
    steps = np.zeros(n + 1, np.int64)
    for r in ranges or ():
        first, words = r >> _BITS, r & (2**_BITS - 1)
        if first < n:
            steps[first] += 1
            steps[min(first + words, n)] -= 1
    return steps.cumsum()[:-1] > 0


def removal_digests(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row.

    Null, empty and short texts lose nothing. Rows that repeat an id and text repeat each other's windows, so they lose
    all words of texts of at least ``window`` words. An empty table gives no rows.
    """
    keyed = docs.select(F.xxhash64("doc_id", "text").alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches):
        for b in batches:
            for i, j, texts in text_parts(b.column(1)):
                out = []
                for data, ranges in zip(texts, b.column(2).slice(i, j - i).to_pylist()):
                    words = data.split()
                    if ranges:
                        gone = covered(ranges, len(words))
                        kept = b" ".join(compress(words, ~gone))
                        out.append((len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest()))
                    else:
                        out.append((len(words), 0, hashlib.sha256(b" ".join(words)).hexdigest()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), *(pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string())))], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    joined = keyed.join(repeated_ranges(keyed, window, anchor), "key", "left").select("doc_id", "text", "ranges")
    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """``docs`` with repeated passages removed from ``text`` (and ``n_chars``, where there is one, counted anew).

    Texts that lose nothing stay as they are; of others the kept words are joined by one space. All rows stay.
    """
    text = F.col("row.text").cast("string").alias("text")
    # the text travels in ``row``; names of other columns can't clash with ours
    keyed = docs.select(F.xxhash64("doc_id", "text").alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    ranges = repeated_ranges(keyed, window, anchor, text)

    def run(batches):
        for b in batches:
            for i, j, texts in text_parts(b.column(0)):
                out = []
                for data, ranges in zip(texts, b.column(1).slice(i, j - i).to_pylist()):
                    words = data.split()
                    out.append(b" ".join(compress(words, ~covered(ranges, len(words)))).decode("utf-8") if ranges else None)
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), b.column(2).slice(i, j - i)], ["kept_text", "row"])

    joined = keyed.join(ranges, "key", "left").select(text, "ranges", "row")
    row_type = keyed.schema["row"].dataType.simpleString()
    done = joined.mapInArrow(run, f"kept_text string, row {row_type}")
    cut = F.col("kept_text").isNotNull()
    new = {"text": F.when(cut, F.col("kept_text")).otherwise(F.col("row.text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(cut, F.char_length("kept_text").cast("long")).otherwise(F.col("row.n_chars"))
    return done.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))
