"""Vector codes: each part of a vector becomes the number of its nearest codebook entry, in whole numbers throughout.

Components are scaled and floored to integers. Parts and entries are padded with zeros to a power of two and sent through
the Walsh-Hadamard transform, which keeps squared distances but for the factor of its length. Coefficients are taken in
the order of their sequency (sign changes), the smooth ones first: the squared differences so far are a lower bound of the
scaled distance, so entries above the full distance of the best so far are dropped before the rest is looked at. Ties are
never dropped; the least entry of the least distance wins. Numbers that could pass 64 bits are taken as Python integers.

Codebooks begin as the first vectors by id. A round sends every row through the assignment, adds up sums and counts in
each task, and sums those in Spark; the driver holds the codebooks only, whose size doesn't depend on the number of rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapelab.llm.common import hot_join, stored

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Rows that are compared with all entries at a time.
BLOCK = 1024
#: Sums leave a task in limbs of 32 bits.
LIMBS = 6


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id, label, x (array<double>) of the rows whose vector is not null and has finite components only."""
    odd = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), F.col(column).cast("array<double>").alias("x"))
    return rows.filter(F.col("x").isNotNull() & ~F.exists("x", odd))


def whole_numbers(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of doubles; int64, or Python integers where a component is too large for that."""
    if not x.size or np.abs(x).max() < 2**40:
        return np.floor(x * scale).astype(np.int64)
    flat = [int(v) * scale if abs(v) >= 2**53 else int(np.floor(v * scale)) for v in x.ravel().tolist()]
    return np.array(flat, object).reshape(x.shape)


def padded_length(width: int) -> int:
    return 1 << max(width - 1, 0).bit_length()


def by_sequency(n: int) -> np.ndarray:
    """Places of the transform's natural order (``n`` a power of two), by the number of sign changes of their rows."""
    bits = n.bit_length() - 1
    changes = np.zeros(n, np.int64)
    for b in range(bits):  # the number's bits in reverse, read as a Gray code
        changes |= ((np.arange(n) >> b) & 1) << (bits - 1 - b)
    step = 1
    while step < bits:
        changes ^= changes >> step
        step *= 2
    return np.argsort(changes, kind="stable")


def transform(a: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of the rows, padded with zeros, in the order of sequency."""
    n = padded_length(a.shape[1])
    out = np.zeros((len(a), n), a.dtype)
    out[:, : a.shape[1]] = a
    half = 1
    while half < n:
        v = out.reshape(len(a), n // (2 * half), 2, half)
        out = np.stack([v[:, :, 0] + v[:, :, 1], v[:, :, 0] - v[:, :, 1]], 2).reshape(len(a), n)
        half *= 2
    return out[:, by_sequency(n)]


def nearest(rows: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row, the nearest entry (ties: the least) and its squared distance."""
    n = padded_length(rows.shape[1])
    most = max(int(abs(a).max()) if a.size else 0 for a in (rows, entries))
    kind = np.int64 if 4 * n * n * most * most < 2**62 else object  # a scaled distance is n times at most n * (2 * most)**2
    e = transform(entries.astype(kind))
    at, far = np.zeros(len(rows), np.int64), np.zeros(len(rows), kind)
    step = max(1, n // 8)
    for a in range(0, len(rows), BLOCK):
        x = transform(rows[a : a + BLOCK].astype(kind))
        m, k = len(x), len(e)
        sums = np.zeros((m, k), kind)
        for c in range(step):
            sums += (x[:, c, None] - e[:, c]) ** 2
        row, entry, done = np.repeat(np.arange(m), k), np.tile(np.arange(k), m), step
        sums, bound = sums.ravel(), None
        while done < n:
            # the row's best so far, taken to the end, bounds what its others may have
            first = np.flatnonzero(np.diff(row, prepend=-1))
            low = np.minimum.reduceat(sums, first)
            best = np.flatnonzero(sums == low[row])
            best = best[np.flatnonzero(np.diff(row[best], prepend=-1))]
            full = low + ((x[:, done:] - e[entry[best], done:]) ** 2).sum(1)
            bound = full if bound is None else np.minimum(bound, full)
            stay = sums <= bound[row]
            row, entry, sums = row[stay], entry[stay], sums[stay]
            to = min(done + step, n)
            for c in range(done, to):
                sums = sums + (x[row, c] - e[entry, c]) ** 2
            done = to
        low = np.minimum.reduceat(sums, np.flatnonzero(np.diff(row, prepend=-1)))
        best = np.flatnonzero(sums == low[row])
        best = best[np.flatnonzero(np.diff(row[best], prepend=-1))]
        at[a : a + m], far[a : a + m] = entry[best], low // n
    return at, far


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """The vectors of a batch as rows of whole numbers; shorter ones are padded with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width))
    out[np.arange(width) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return whole_numbers(out)


def codebook_sums(rows: DataFrame, books: list[np.ndarray], width: int) -> DataFrame:
    """cell, limb, value: for each cell (part, entry, position; the last position counts rows), its sum in limbs of 32 bits with its sign."""
    entries, part_width = books[0].shape

    def run(batches):
        total = np.zeros((PARTS, entries, part_width + 1), object)
        for b in batches:
            x = matrix(b.column(0), width)
            for p in range(PARTS if len(x) else 0):
                part = x[:, p * part_width : (p + 1) * part_width]
                code, _ = nearest(part, books[p])
                order = np.argsort(code, kind="stable")
                used, first = np.unique(code[order], return_index=True)
                if part_width:
                    total[p, used, :-1] += np.add.reduceat(part[order], first)
                total[p, used, -1] += np.diff(np.append(first, len(order)))
        flat = total.ravel()
        sign, rest = np.where(flat < 0, -1, 1), abs(flat)
        for limb in range(LIMBS):
            value = ((rest & 0xFFFFFFFF) * sign).astype(np.int64)
            rest = rest >> 32
            cell = np.flatnonzero(value)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(np.full(len(cell), limb)), pa.array(value[cell])], ["cell", "limb", "value"])

    return rows.select("x").mapInArrow(run, "cell long, limb long, value long").groupBy("cell", "limb").agg(F.sum("value").alias("value"))


def train(rows: DataFrame, rounds: int = ROUNDS) -> tuple[list[np.ndarray], int]:
    """The codebooks of the parts after ``rounds`` rounds, and the width of the vectors; without rows, empty codebooks.

    They begin as the first vectors by id (null ids last, equal ids by components). Vectors of other lengths are padded with zeros to the greatest length.
    """
    longest = rows.agg(F.max(F.size("x"))).first()[0] or 0
    part_width = -(-longest // PARTS)
    width = part_width * PARTS
    ids = [r[0] for r in rows.select("vec_id").orderBy(F.col("vec_id").asc_nulls_last()).limit(ENTRIES).collect()]
    low = rows.filter(F.col("vec_id") <= ids[-1]) if len(ids) == ENTRIES and ids[-1] is not None else rows  # vectors of the first ids only
    first = low.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(ENTRIES).select("x").toArrow()["x"].combine_chunks()
    start = matrix(first, width) if len(first) else np.zeros((0, width), np.int64)
    books = [start[:, p * part_width : (p + 1) * part_width] for p in range(PARTS)]
    for _ in range(rounds if len(start) else 0):
        total = np.zeros(PARTS * len(start) * (part_width + 1), object)
        for r in codebook_sums(rows, books, width).collect():  # at most LIMBS for each number of the codebooks
            total[r["cell"]] += r["value"] << (32 * r["limb"])
        total = total.reshape(PARTS, len(start), part_width + 1)
        for p in range(PARTS):
            used = total[p, :, -1] > 0
            book = books[p].astype(object)
            book[used] = total[p, used, :-1] // total[p, used, -1:]
            small = not book.size or abs(book).max() < 2**62
            books[p] = book.astype(np.int64) if small else book
    return books, width


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()


def encode(rows: DataFrame, books: list[np.ndarray], width: int) -> DataFrame:
    """vec_id, label, code, error of every row; an error beyond 64 bits is null."""
    part_width = width // PARTS

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column(2), width)
            both = [nearest(x[:, p * part_width : (p + 1) * part_width], books[p]) for p in range(PARTS)]
            error = sum(d.astype(object) for _, d in both)
            codes = np.stack([c for c, _ in both], 1).astype(np.uint8)
            text = codes.tobytes().hex()
            step = 2 * PARTS
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([text[i : i + step] for i in range(0, len(text), step)], pa.string()), pa.array([int(e) if e < 2**63 else None for e in error], pa.int64())], ["vec_id", "label", "code", "error"])

    return rows.select("vec_id", "label", "x").mapInArrow(run, f"vec_id long, label {dict(rows.dtypes)['label']}, code string, error long")


def label_text(label: str | Column) -> Column:
    """A label as a key that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(label).cast("string")), F.lit("null"))


def compress(vectors: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, label, code, error, label_error, codebooks_sha256: a row per usable vector.

    Null vectors and those with null or non-finite components are left out; rows that repeat are coded alike and each count; empty vectors have code 0; null
    labels are one label; sums of errors beyond 64 bits are null. An empty table gives no rows.
    """
    rows = usable(vectors)
    books, width = train(rows, rounds)
    coded = stored(encode(rows, books, width) if len(books[0]) else rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")).limit(0), "codes")
    coded = coded.withColumn("key", label_text("label"))
    total = F.when(F.max(F.col("error").isNull()), None).otherwise(F.sum(F.col("error").cast("decimal(38,0)")))
    sums = coded.groupBy("key").agg(total.alias("total")).select("key", F.expr("try_cast(total as bigint)").alias("label_error"))
    return hot_join(coded, sums, ["key"]).select("vec_id", "label", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
