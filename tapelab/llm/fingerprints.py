"""Threshold-scaled sketches, in DataFrame functions alone.

A document's sketch is every hash of its word shingles below a fixed share of the hash range: half of it, as short texts have few
shingles and a smaller share loses their likeness. Sketches of parts merge by union, and because all use the same threshold,
containment and likeness are estimates between documents of very unequal length; of m different shingles in two texts about m / 2 are looked at,
so a likeness J is off by about sqrt(2 * J * (1 - J) / m). The printed fingerprint begins with a digest of the text, so texts without a hash
have fingerprints of their own; hashes are printed to the base 64, which keeps a fingerprint shorter than its text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapelab.llm.common import BLANKS, let

SHINGLE = 5
#: One shingle hash in so many is kept.
SCALE = 2
DOCS_PER_BUCKET = 1000
MAX_BUCKETS = 1 << 18


def words(text: Column) -> Column:
    return F.filter(F.split(text, f"[{BLANKS}]+"), lambda w: w != "")


def sketch(text: Column, k: int = SHINGLE, scale: int = SCALE) -> Column:
    """Sorted distinct shingle hashes below the threshold. Texts of 1 to k-1 words are one shingle; without words: none."""
    limit = -(2**63) + 2**64 // scale - 1

    def of(ws: Column) -> Column:
        n = F.greatest(F.size(ws) - (k - 1), F.least(F.size(ws), F.lit(1)))
        hashes = F.transform(F.slice(ws, F.lit(1), n), lambda w, i: F.xxhash64(w, *(F.get(ws, i + j) for j in range(1, k))))
        return F.array_sort(F.array_distinct(F.filter(hashes, lambda h: h <= limit)))

    return let(words(text), of)


def likeness(a: Column, b: Column, same: Column) -> Column:
    """Jaccard similarity of two sketches, an estimate of the texts'; without any hash on either side, whether the texts are the same."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either == 0, same.cast("double")).otherwise(both / F.greatest(either, F.lit(1)))


def containment(a: Column, b: Column) -> Column:
    """Share of ``a``'s shingles that ``b`` has; null where ``a`` has no hash."""
    return F.try_divide(F.size(F.array_intersect(a, b)), F.size(a))


def merge(a: Column, b: Column) -> Column:
    """Sketch of two documents together."""
    return F.array_sort(F.array_union(a, b))


def printed(digest: Column, hashes: Column) -> Column:
    return F.concat(digest, F.lit(":"), F.base64(F.unhex(F.array_join(F.transform(hashes, lambda h: F.lpad(F.hex(h), 16, "0")), ""))))


def with_next(rows: DataFrame, key: str, carry: list[str], per_bucket: int = DOCS_PER_BUCKET) -> DataFrame:
    """Each row with ``next``: the struct of ``carry`` of the row that follows it by descending key; after the last, the first.

    Keys are dealt into ranges of about ``per_bucket`` rows, at quantiles of the key. The head of each range is copied to
    the end of the range before it, so one shuffle and a window within ranges give every row its follower. Null keys come
    last; equal keys are ordered by the carried columns' hash. A key that is several quantiles at once, or null, holds more rows
    than a range should: its rows are dealt into several ranges by that hash. An empty table gives no rows.
    """
    spark = rows.sparkSession
    counts = rows.agg(F.count(key).alias("n"), F.count_if(F.col(key).isNull()).alias("nulls")).first()
    n = max(1, min(MAX_BUCKETS, -(-counts["n"] // per_bucket)))
    share = [i / n for i in range(1, n)]
    found = rows.agg(F.percentile_approx(key, share, max(10_000, 4 * n)).alias("b")).first()["b"] or [] if share else []
    bounds = sorted(set(found))
    # ranges by descending key; before the rest of its range, a bound that was found several times has as many ranges of its own
    own = [found.count(b) if len(found) > len(bounds) else 1 for b in bounds]
    starts, at = [0] * (len(bounds) + 1), 1
    for j in range(len(bounds) - 1, -1, -1):
        starts[j] = at
        at += 1 + (own[j] if own[j] > 1 else 0)
    nulls = -(-counts["nulls"] // per_bucket)
    hashed = nulls > 0 or any(m > 1 for m in own)
    step = max(1, int(len(bounds) ** 0.5))
    edges = spark.createDataFrame([(bounds, bounds[::step], starts, own)], "bounds array<bigint>, coarse array<bigint>, starts array<int>, own array<int>")

    def share_of(m: Column) -> Column:
        """Which of ``m`` equal parts of the hash range a row's hash lies in."""
        return F.shiftright(F.shiftrightunsigned(F.col("h").bitwiseXOR(F.lit(-(2**63))), 33) * m, 31).cast("int")

    def bucket(k: Column) -> Column:
        skip = F.size(F.filter("coarse", lambda b: b < k))  # coarse bounds below the key
        start = F.greatest((skip - 1) * step, F.lit(0))
        j = start + F.size(F.filter(F.slice("bounds", start + 1, F.lit(step)), lambda b: b < k))
        alone, several = F.coalesce(F.get("bounds", j) == k, F.lit(False)), F.coalesce(F.get("own", j), F.lit(1))
        mine = F.when(several == 1, 0).when(alone, share_of(several)).otherwise(several) if hashed else F.lit(0)
        return F.when(k.isNull(), at + share_of(F.lit(nulls)) if nulls else F.lit(at)).otherwise(F.get("starts", j) + mine)

    dealt = (rows.withColumn("h", F.xxhash64(*carry)) if hashed else rows.withColumn("h", F.lit(0).cast("long"))).join(F.broadcast(edges))
    dealt = dealt.withColumn("bucket", bucket(F.col(key))).drop("bounds", "coarse", "starts", "own")
    order = [F.col(key).desc_nulls_last(), F.xxhash64(*carry)]
    first = F.max(F.struct(F.col(key).alias("k"), F.bitwise_not("h").alias("not_h"))).alias("head")
    heads = dealt.select("bucket", key, "h").groupBy("bucket").agg(first)
    # ranges are few (at most MAX_BUCKETS or so), so their order fits one task
    ring = Window.partitionBy(F.lit(0)).orderBy(F.col("bucket"))
    before = heads.select(F.col("bucket").alias("head_bucket"), "head", F.coalesce(F.lag("bucket").over(ring), F.max("bucket").over(Window.partitionBy(F.lit(0)))).alias("to"))
    marked = dealt.join(F.broadcast(before), F.col("bucket") == F.col("head_bucket"))
    is_head = F.col(key).eqNullSafe(F.col("head.k")) & (F.bitwise_not("h") == F.col("head.not_h"))
    copies = F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("copy")), F.when(is_head, F.struct(F.col("to").alias("bucket"), F.lit(True).alias("copy"))))
    spread = marked.withColumn("place", F.explode(F.array_compact(copies))).select(*rows.columns, F.col("place.bucket").alias("bucket"), F.col("place.copy").alias("copy"))
    w = Window.partitionBy("bucket").orderBy("copy", *order)
    return spread.withColumn("next", F.lead(F.struct(*carry)).over(w)).filter("not copy").drop("bucket", "copy")


def fingerprint_edits(docs: DataFrame, k: int = SHINGLE, scale: int = SCALE) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and containments.

    The edited text is the text with its last floor(n/2) code points replaced by the first as many of the next document's
    text (or all of it, where that is shorter). Null texts are empty. A single document is its own next. Rows without id come last;
    rows of one id follow each other by a hash of their texts. An empty table gives no rows.
    """
    digest = lambda c: F.substring(F.sha2(c.cast("binary"), 256), 1, 16)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = with_next(rows, "doc_id", ["text"])  # texts are shipped alone: hashes take longer to ship than to make
    half = F.floor(F.char_length("text") / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), F.char_length("text") - half), F.substring(F.col("next.text"), F.lit(1), half)))
    rows = rows.withColumns({"hashes": sketch(F.col("text"), k, scale), "next_hashes": sketch(F.col("next.text"), k, scale), "edited_hashes": sketch(F.col("edited"), k, scale)})
    return rows.select(
        "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        printed(digest(F.col("text")), F.col("hashes")).alias("fingerprint"), printed(digest(F.col("edited")), F.col("edited_hashes")).alias("edited_fingerprint"),
        likeness(F.col("hashes"), F.col("edited_hashes"), F.col("text") == F.col("edited")).alias("near_edited"),
        likeness(F.col("hashes"), F.col("next_hashes"), F.col("text") == F.col("next.text")).alias("near_next"),
        containment(F.col("hashes"), F.col("edited_hashes")).alias("edited_holds"),
    )
