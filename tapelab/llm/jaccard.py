"""Exact Jaccard join of documents on word n-grams, by grouped prefixes.

Each document is the set of its shingles' hashes; documents of one set are one member. Shingles have one global order
(those known to be frequent last, then by hash). Two sets of Jaccard similarity t share a shingle in their prefixes, the
first size - ceil(t * size) + 1 in that order. Members of the same prefix and size are one group. Groups that share a
prefix shingle are paired, and pairs are filtered by size, by how many prefix shingles they share, and by parity bitmaps of their sets. Lists of shingles that
aren't known to be frequent are made in one exchange by shingle; the frequent ones are summed before they are dealt.

A list of more than LIST groups isn't paired off. It is expanded to its members and, like a group of several members, taken in three steps:

* Each group is paired with one other only: of the least groups of its long lists, that of most lists, and its least neighbour in short ones. Whole texts of
  pairs whose bitmaps are near are sent together and verified; what is linked is one component.
* Members of one component need no comparison any more. The others of a list are compared by bitmap, in blocks
  (what is in the list's largest component only with what isn't), and each is verified with its nearest.
* What isn't connected then is compared again, and whole texts of all near pairs are verified.

So every link between different texts counts, texts travel only for pairs that bitmaps leave in doubt, no list is held by one
task, and no family is sent in pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapelab.llm.common import forget, hot_join, stored
from tapelab.llm.components import connected_components
from tapelab.llm.wordhash import SEGMENT, Words, batches_of, mix, text_parts

SHINGLE = 5
#: Similarity, as a ratio of integers.
NUMERATOR, DENOMINATOR = 80, 100
LIST = 64
#: A block holds about so many members at most.
BLOCK = 512
#: So many of its lists a member knows.
FIRST_LISTS = 8
#: Keys that a task remembers, so as to send a text that repeats in it once.
REMEMBERED = 1 << 16
#: Bits of the filter of frequent shingles. At most one in eight is set: with more shingles, frequent means more often.
FILTER_BITS = 23


def shingle_sets(texts: list[bytes], k: int = SHINGLE):
    """The sorted distinct shingle hashes of each text, end to end, and how many each has."""
    w = Words(texts)
    n = len(w.hash)
    at = np.flatnonzero(w.doc[: n - k + 1] == w.doc[k - 1 :]) if n >= k else np.zeros(0, np.int64)
    short = np.flatnonzero((w.count > 0) & (w.count < k))
    h = np.concatenate([w.run(at, k), w.run(w.first[short], w.count[short])])
    doc = np.concatenate([w.doc[at], short])
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, np.bincount(doc, minlength=len(texts))


def set_ids(h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A hash of each whole set."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h ^ np.uint64(0x5851F42D4C957F2D)))])
    ends = np.cumsum(sizes)
    return mix(total[ends] - total[ends - sizes] + sizes.astype(np.uint64))


def frequent_filter(docs: DataFrame, k: int = SHINGLE, flush: int = 1 << 20) -> np.ndarray:
    """Bits of the shingles that stand in many members: a bounded hint for the order, gathered from all documents.

    Tasks count their own shingles and send those that they saw at least twice. Sums above LIST set a bit, or above the power of two
    that leaves the filter mostly empty at any size of the corpus. A rare shingle that is missed, or one that shares a
    bit, makes the order less good and the result no different.
    """

    def count(batches):
        held, size = [], 0

        def out():
            v, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(v[n > 1].view(np.int64)), pa.array(n[n > 1].astype(np.int64))], ["shingle", "n"])

        for b in batches:
            for _, _, texts in text_parts(b.column(0), lower=True):
                h, sizes = shingle_sets(texts, k)
                ids = set_ids(h, sizes)
                keep = np.zeros(len(sizes), bool)
                keep[np.unique(ids, return_index=True)[1]] = True  # a set counts once in a batch
                held.append(h[np.repeat(keep, sizes)])
                size += len(held[-1])
                if size > flush:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    sums = docs.select("text").mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).filter(F.col("n") > LIST)
    sums = stored(sums, "frequent")
    level = F.floor(F.log2(F.col("n").cast("double"))).cast("int")
    above, least = 0, LIST
    for r in sums.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("level").desc()).collect():  # at most 63 rows
        above += r["n"]
        if above > 1 << (FILTER_BITS - 3):
            least = 2 << r["level"]
            break
    out = hash_bits(sums.filter(F.col("n") > least).select("shingle"))
    forget(sums)
    return out


def hash_bits(hashes: DataFrame) -> np.ndarray:
    """A bitmap of 2**FILTER_BITS bits, whatever the number of ``hashes`` (one column): set where a hash's first bits point to."""
    h = F.col(hashes.columns[0])
    bit = F.shiftrightunsigned(h, 64 - FILTER_BITS)
    mask = F.element_at(F.array(*(F.lit(1 << i).cast("long") for i in range(32))), (bit.bitwiseAND(F.lit(31)) + 1).cast("int"))
    got = hashes.select(F.shiftright(bit, 5).alias("word"), mask.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()  # at most 2**(FILTER_BITS - 5) rows
    out = np.zeros(1 << (FILTER_BITS - 5), np.uint32)
    out[got["word"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64).astype(np.uint32)
    return out


def has_bit(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """1 where the bit of a hash (uint64) is set, else 0."""
    bit = h >> np.uint64(64 - FILTER_BITS)
    return (bits[(bit >> np.uint64(5)).astype(np.int64)] >> (bit & np.uint64(31)).astype(np.uint32)) & np.uint32(1)


def ordered(texts: list[bytes], frequent: np.ndarray, k: int, num: int, den: int):
    """Of a batch: sizes, set ids and prefix lengths of the texts; their shingles in the global order, end to end, which are in the prefix, and which are frequent."""
    h, sizes = shingle_sets(texts, k)
    ids = set_ids(h, sizes)
    late = has_bit(frequent, h)
    # shingles of a text are sorted already: a stable split by ``late`` keeps the order
    doc = np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(doc * 2 + late, kind="stable")
    h, late = h[order], late[order]
    lengths = np.where(sizes > 0, sizes - -(-num * sizes // den) + 1, 0)
    rank = np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return sizes, ids, lengths, h, doc, rank < np.repeat(lengths, sizes), late


def group_ids(h: np.ndarray, inside: np.ndarray, lengths: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A hash of each text's prefix and size."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h[inside]))])
    ends = np.cumsum(lengths)
    return mix(total[ends] - total[ends - lengths] ^ sizes.astype(np.uint64))


def prefixes(docs: DataFrame, frequent: np.ndarray, often: bool, k: int, num: int, den: int) -> DataFrame:
    """token, grp, size: the tokens of each group's prefix that are known to be frequent (``often``) or aren't; a group that repeats in a batch counts once."""

    def run(batches):
        for b in batches:
            for _, _, texts in text_parts(b.column(0), lower=True):
                sizes, _, lengths, h, doc, inside, late = ordered(texts, frequent, k, num, den)
                groups = group_ids(h, inside, lengths, sizes)
                keep = np.zeros(len(sizes), bool)
                keep[np.unique(groups, return_index=True)[1]] = True
                inside = inside & keep[doc] & (late == np.uint32(often))
                doc, h = doc[inside], h[inside]
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(groups[doc].view(np.int64)), pa.array(sizes[doc].astype(np.int32))], ["token", "grp", "size"])

    return docs.select("text").mapInArrow(run, "token long, grp long, size int")


def parity_bits(h: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """For each set a bitmap of as many bits as its size, or up to twice as many: a bit tells whether an odd number of its hashes falls there.

    Two sets differ in at least as many shingles as their bitmaps do in bits. The longer of two bitmaps is folded by halves.
    """
    width = np.left_shift(np.int64(1), np.ceil(np.log2(np.maximum(sizes, 64))).astype(np.int64))
    ends = np.cumsum(width)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    at = (ends - width)[doc] + (mix(h) & (width[doc] - 1).astype(np.uint64)).astype(np.int64)
    data = np.packbits((np.bincount(at, minlength=int(ends[-1]) if len(ends) else 0) & 1).astype(np.uint8), bitorder="little").tobytes()
    return [data[i:j] for i, j in zip(((ends - width) // 8).tolist(), (ends // 8).tolist())]


def folded(bits: list[bytes], width: int) -> np.ndarray:
    """Bitmaps of ``width`` bytes or a power of two times as many, all folded to ``width``, as a matrix."""
    out = np.empty((len(bits), width), np.uint8)
    by: dict[int, list[int]] = {}
    for i, x in enumerate(bits):
        by.setdefault(len(x), []).append(i)
    for n, at in by.items():
        x = np.frombuffer(b"".join([bits[i] for i in at]), np.uint8).reshape(len(at), n)
        while x.shape[1] > width:
            x = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :]
        out[at] = x
    return out


def near_pairs(bits: list[bytes], sizes: np.ndarray, a: np.ndarray, b: np.ndarray, num: int, den: int) -> np.ndarray:
    """In how many bits the bitmaps of each pair (a[i], b[i]) of sets differ; -1 where they can't be linked."""
    widths = np.array(list(map(len, bits)), np.int64)
    width, out = np.minimum(widths[a], widths[b]), np.full(len(a), -1)
    total = sizes[a] + sizes[b]
    for w in np.unique(width).tolist():
        at = np.flatnonzero(width == w)
        rows, where = np.unique(np.concatenate([a[at], b[at]]), return_inverse=True)
        m = folded([bits[i] for i in rows.tolist()], w).view(np.uint64)
        x, y = where[: len(at)], where[len(at) :]
        for k in range(0, len(at), max(1, (1 << 22) // w)):
            some = slice(k, k + max(1, (1 << 22) // w))
            apart = np.bitwise_count(m[x[some]] ^ m[y[some]]).sum(1, dtype=np.int64)
            out[at[some]] = np.where((total[at[some]] - apart) * (den + num) >= 2 * num * total[at[some]], apart, -1)
    return out


def near_by_bits(pairs: DataFrame, num: int, den: int) -> DataFrame:
    """Of (a, b, size, size2, bits, bits2) the (a, b) whose bitmaps leave room for a link; pairs without both bitmaps stay."""

    def run(batches):
        for b in batches:
            bits = b.column(4).to_pylist() + b.column(5).to_pylist()
            sizes = np.concatenate([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (2, 3)])
            at = np.array([i for i in range(b.num_rows) if bits[i] is not None and bits[i + b.num_rows] is not None], np.int64)
            keep = np.ones(b.num_rows, bool)
            if len(at):
                keep[at] = near_pairs([x or b"" for x in bits], sizes, at, at + b.num_rows, num, den) >= 0
            yield b.select(["a", "b"]).filter(pa.array(keep))

    return pairs.select("a", "b", "size", "size2", "bits", "bits2").mapInArrow(run, "a long, b long")


def members_of(docs: DataFrame, frequent: np.ndarray, carry: list[str], k: int = SHINGLE, num: int = NUMERATOR, den: int = DENOMINATOR) -> DataFrame:
    """carry..., key (of the text), member (hash of the shingle set; null without words), grp (of its prefix and size), n_shingles, last (the prefix's end in the global order), bits (of the set)."""
    fields = {f.name: f.dataType.simpleString() for f in docs.schema.fields}

    def run(batches):
        for b in batches:
            for i, j, texts in text_parts(b.column(len(carry)), lower=True):
                sizes, ids, lengths, h, _, inside, late = ordered(texts, frequent, k, num, den)
                group = group_ids(h, inside, lengths, sizes).view(np.int64)
                # the place in the global order, as a signed number
                place = ((h >> np.uint64(1)) | (late.astype(np.uint64) << np.uint64(63))) ^ np.uint64(1 << 63)
                at = np.where(sizes > 0, np.cumsum(sizes) - sizes + lengths - 1, 0)
                last = place[at] if len(place) else np.zeros(len(at), np.uint64)
                cols = [b.column(c).slice(i, j - i) for c in range(len(carry))] + [b.column(len(carry) + 1).slice(i, j - i)]
                out = [*cols, pa.array(ids.view(np.int64), mask=sizes == 0), pa.array(group), pa.array(sizes.astype(np.int64)), pa.array(last.view(np.int64)), pa.array(parity_bits(h, sizes), pa.binary())]
                yield pa.RecordBatch.from_arrays(out, [*carry, "key", "member", "grp", "n_shingles", "last", "bits"])

    schema = ", ".join(f"{c} {fields[c]}" for c in carry) + (", " if carry else "") + "key long, member long, grp long, n_shingles long, last long, bits binary"
    return docs.select(*carry, "text", F.xxhash64("text").alias("key")).mapInArrow(run, schema)


def links(docs: DataFrame, members: DataFrame, frequent: np.ndarray, k: int = SHINGLE, num: int = NUMERATOR, den: int = DENOMINATOR, most: int = LIST, block: int = BLOCK) -> DataFrame:
    """node, root of all links between members (different shingle sets). ``docs``: text; ``members``: of the same rows."""
    rare = prefixes(docs, frequent, False, k, num, den).repartition("token").distinct()
    own = Window.partitionBy("token")
    rare = stored(rare.select("*", F.count(F.lit(1)).over(own).alias("n"), F.min("grp").over(own).alias("low")).filter("n > 1"), "rare")
    often = stored(prefixes(docs, frequent, True, k, num, den).distinct(), "often")
    lists = often.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.min("grp").alias("low")).filter("n > 1")
    shared = rare.unionByName(hot_join(often, lists, ["token"]))

    # short lists: pairs of groups, filtered by size and by the number of common prefix shingles. A frequent shingle that
    # isn't counted here brings both groups into one cluster anyway.
    grouped = shared.filter(F.col("n") <= most).select("token", "grp", "size")
    other = grouped.select("token", F.col("grp").alias("grp2"), F.col("size").alias("size2"))
    fits = (num * F.greatest("size", "size2") <= den * F.least("size", "size2")) & (F.col("grp") < F.col("grp2"))
    pairs = grouped.join(other, "token").filter(fits).groupBy("grp", "grp2", "size", "size2").agg(F.count(F.lit(1)).alias("common"))

    # the prefix that ends first holds all that is common up to its end; the rest lies behind that place in both sets
    behind = lambda s: F.ceil(num * F.col(s) / den) - 1
    enough = lambda more: (F.col("common") + more) * (den + num) >= num * (F.col("size") + F.col("size2"))
    pairs = pairs.filter(enough(F.greatest(behind("size"), behind("size2"))))
    ends = members.filter("member is not null").groupBy("grp").agg(F.first("last").alias("last"))
    pairs = pairs.join(ends, "grp").join(ends.select(F.col("grp").alias("grp2"), F.col("last").alias("last2")), "grp2")
    rest = F.when(F.col("last") < F.col("last2"), behind("size")).when(F.col("last") > F.col("last2"), behind("size2")).otherwise(F.least(behind("size"), behind("size2")))
    pairs = pairs.filter(enough(rest)).select(F.col("grp").alias("a"), F.col("grp2").alias("b"), "size", "size2")
    # a group of one set has its bitmap
    alone = members.filter("member is not null").groupBy("grp").agg(F.min("member").alias("low"), F.max("member").alias("high"), F.min("bits").alias("bits")).filter("low = high").select("grp", "bits")
    pairs = pairs.join(alone.withColumnRenamed("grp", "a"), "a", "left").join(alone.select(F.col("grp").alias("b"), F.col("bits").alias("bits2")), "b", "left")
    pairs = near_by_bits(pairs, num, den)

    pairs = stored(pairs, "pairs")
    long = shared.filter(F.col("n") > most)
    # of lists of the same groups one does
    same = long.groupBy("token").agg(F.count(F.lit(1)).alias("n"), *(F.bit_xor(F.xxhash64(F.lit(i), "grp")).alias(f"x{i}") for i in (1, 2)))
    one = same.groupBy("n", "x1", "x2").agg(F.min("token").alias("token")).select("token")
    long = stored(hot_join(long, one, ["token"], "left_semi").select("token", "grp", "low"), "long")
    forget(rare, often)
    roots = _verify(docs, members, pairs, long, k, num, den, block)
    forget(pairs, long)
    return roots


def _verify(docs: DataFrame, members: DataFrame, pairs: DataFrame, long: DataFrame, k: int, num: int, den: int, block: int) -> DataFrame:
    """node, root of the links between members of paired groups (a, b), of groups of a long list (token, grp, low) and of one group."""
    facts = members.filter("member is not null").groupBy("member").agg(F.min("key").alias("key"), F.first("n_shingles").alias("size"), F.first("grp").alias("grp"), F.first("bits").alias("bits"))
    busy = pairs.select(F.col("a").alias("grp")).unionByName(pairs.select(F.col("b").alias("grp"))).unionByName(long.select("grp")).distinct()
    groups = facts.groupBy("grp").agg(F.min("member").alias("rep"), F.count(F.lit(1)).alias("n"))
    groups = hot_join(groups, busy.withColumn("busy", F.lit(True)), ["grp"], "left").filter("n > 1 or busy").select("grp", "rep", "n")
    facts = stored(hot_join(facts, groups, ["grp"]), "candidates")
    reps = facts.filter("member = rep").select("grp", "member", "n")

    # first step: a pair for each
    ends = pairs.select(F.col("a").alias("g"), F.col("b").alias("o")).unionByName(pairs.select(F.col("b").alias("g"), F.col("a").alias("o"))).groupBy("g").agg(F.min("o").alias("o"))
    most = long.filter("grp <> low").groupBy("grp", "low").agg(F.count(F.lit(1)).alias("n")).groupBy(F.col("grp").alias("g")).agg(F.max_by("low", F.struct("n", "low")).alias("o"))
    star = ends.unionByName(most).select(F.least("g", "o").alias("ga"), F.greatest("g", "o").alias("gb")).distinct()
    rep = lambda g, m: reps.select(F.col("grp").alias(g), F.col("member").alias(m))
    first = hot_join(hot_join(star, rep("ga", "a"), ["ga"]), rep("gb", "b"), ["gb"]).select("a", "b").unionByName(facts.filter("member <> rep").select(F.col("rep").alias("a"), F.col("member").alias("b")))
    roots = stored(connected_components(_compare(docs, facts, _near(first, facts, num, den), k, num, den)), "roots")

    # second and third step: what isn't connected yet
    for nearest in (True, False):
        labels = roots.select(F.col("node").alias("member"), F.col("root").alias("label"))
        labelled = stored(hot_join(facts, labels, ["member"], "left").select("member", "grp", "n", "size", "bits", F.coalesce("label", "member").alias("label")), "labelled")
        pure = labelled.groupBy("grp").agg(F.first("n").alias("n"), F.min("member").alias("m"), F.min("label").alias("label"), F.max("label").alias("high"))
        pure = pure.select("grp", "n", "m", F.when(F.col("label") == F.col("high"), F.col("label")).alias("label"))
        side = lambda s: pure.select(F.col("grp").alias(s), F.col("n").alias(f"n_{s}"), F.col("m").alias(f"m_{s}"), F.col("label").alias(f"label_{s}"))  # noqa: B023, E731
        rest = hot_join(hot_join(pairs, side("a"), ["a"]), side("b"), ["b"]).filter(~F.coalesce(F.col("label_a") == F.col("label_b"), F.lit(False)))
        rest = stored(rest, "rest")
        lists = rest.filter("n_a > 1 or n_b > 1").select(F.xxhash64("a", "b").alias("list"), F.explode(F.array("a", "b")).alias("grp"))
        lists = lists.unionByName(long.select(F.col("token").alias("list"), "grp")).unionByName(pure.filter("label is null").select(F.xxhash64("grp").alias("list"), "grp"))
        found = _near_in_lists(lists, labelled, num, den, block, nearest)
        if not nearest:
            found = found.unionByName(rest.filter("n_a = 1 and n_b = 1").select(F.col("m_a").alias("a"), F.col("m_b").alias("b")))  # their bitmaps were near
        more = _compare(docs, facts, found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), k, num, den)
        roots, spent = stored(connected_components(more.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))), "roots"), roots
        forget(spent, labelled, rest)
    forget(facts)
    return roots


def _near(pairs: DataFrame, facts: DataFrame, num: int, den: int) -> DataFrame:
    """Of pairs of members those whose sizes and bitmaps leave room for a link."""
    end = lambda m, s, b: facts.select(F.col("member").alias(m), F.col("size").alias(s), F.col("bits").alias(b))
    t = hot_join(hot_join(pairs.filter("a <> b"), end("a", "size", "bits"), ["a"]), end("b", "size2", "bits2"), ["b"])
    return near_by_bits(t.filter(num * F.greatest("size", "size2") <= den * F.least("size", "size2")), num, den)


def _near_in_lists(lists: DataFrame, members: DataFrame, num: int, den: int, block: int, nearest: bool) -> DataFrame:
    """a, b: pairs of members of one list (list, grp) that have different labels and near bitmaps; or each member with its ``nearest`` in a block.

    Members know their first lists, so that most pairs that share several come from one.

    A list of at most ``block`` members is one job. A longer one is cut into levels of sizes that differ by less than den / num,
    so that sets can match in their own and the next only, and into those of its largest label and the others; blocks of these meet in pairs, but
    for two of the largest label.
    """
    lists = stored(lists.distinct(), "entries")
    firsts = lists.groupBy("grp").agg(F.slice(F.array_sort(F.collect_set("list")), 1, FIRST_LISTS).alias("firsts"))  # a group is in fewer lists than its prefix is long
    entries = members.select("grp", "member", "size", "label", "bits").join(firsts, "grp").join(lists, "grp")
    counts = entries.groupBy("list", "label").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("list").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("labels"), F.max(F.struct("n", "label")).alias("most")).filter("labels > 1").select("list", "total", F.col("most.label").alias("main"))
    rows = hot_join(entries, totals, ["list"])
    whole = F.col("total") <= block
    level = F.when(whole, 0).otherwise(F.floor(F.log(F.col("size").cast("double")) / F.log(F.lit(den / num)))).cast("int")
    grade = F.when(whole, 0).otherwise((F.col("label") == F.col("main")).cast("int"))
    rows = stored(rows.select("list", "member", "size", "label", "bits", "firsts", level.alias("level"), grade.alias("grade")), "lists")
    parts = rows.groupBy("list", "level", "grade").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts"))
    placed = hot_join(rows, parts, ["list", "level", "grade"]).withColumn("part", F.pmod(F.xxhash64("member"), F.col("parts")).cast("int")).drop("parts")
    numbers = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    x = parts.select("list", F.col("level").alias("la"), F.col("grade").alias("ga"), numbers.alias("pa"))
    y = parts.select("list", F.explode(F.array("level", F.col("level") - 1)).alias("la"), F.col("level").alias("lb"), F.col("grade").alias("gb"), numbers.alias("pb"))
    behind = (F.col("lb") > F.col("la")) | (F.col("gb") > F.col("ga")) | ((F.col("gb") == F.col("ga")) & (F.col("pb") >= F.col("pa")))
    blocks = x.filter("ga = 0").join(y, ["list", "la"]).filter(behind).unionByName(x.filter("ga = 1").join(y.filter("gb = 0"), ["list", "la"]).filter("lb > la"))
    job = ["list", "la", "ga", "pa", "lb", "gb", "pb"]
    sides = []
    for n, (lv, gr, pt) in enumerate((("la", "ga", "pa"), ("lb", "gb", "pb"))):
        wanted = blocks if n == 0 else blocks.filter("not (la = lb and ga = gb and pa = pb)")
        wanted = wanted.select("list", F.col(lv).alias("level"), F.col(gr).alias("grade"), F.col(pt).alias("part"), F.xxhash64(*job).alias("j1"), F.xxhash64(F.lit("second"), *job).alias("j2"), F.lit(n).alias("side"))
        sides.append(placed.join(wanted, ["list", "level", "grade", "part"]).select("j1", "j2", "side", "member", "size", "label", "bits", "list", "firsts"))

    def compare(t: pa.Table) -> pa.RecordBatch:
        side, ids, sizes, labels = (t.column(c).to_numpy() for c in (2, 3, 4, 5))
        bits = t.column(6).to_pylist()
        left = np.flatnonzero(side == 0)
        same = len(left) == len(side)
        right = left if same else np.flatnonzero(side == 1)
        one, two = sizes[left][:, None], sizes[right][None, :]
        fits = (labels[left][:, None] != labels[right][None, :]) & (num * np.maximum(one, two) <= den * np.minimum(one, two))
        a, b = np.nonzero(np.triu(fits) if same else fits)
        a, b = left[a], right[b]
        # pairs that share a list before this one come from there
        own, firsts = t.column(7)[0].as_py(), np.full((len(ids), FIRST_LISTS), own_end := np.iinfo(np.int64).max)
        for i, x in enumerate(t.column(8).to_pylist()):
            firsts[i, : len(x)] = x
        firsts[firsts >= own] = own_end
        here = np.ones(len(a), bool)
        for at in range(0, len(a), 1 << 16):
            x, y = firsts[a[at : at + (1 << 16)]], firsts[b[at : at + (1 << 16)]]
            for c in range(FIRST_LISTS):
                here[at : at + (1 << 16)] &= ~((x == y[:, c : c + 1]) & (x != own_end)).any(1)
        a, b = a[here], b[here]
        apart = near_pairs(bits, sizes, a, b, num, den)
        keep = apart >= 0
        a, b, apart = a[keep], b[keep], apart[keep]
        if nearest:
            row, other, far = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([apart, apart])
            order = np.lexsort((ids[other], far, row))
            first = order[np.concatenate([[True], row[order[1:]] != row[order[:-1]]])] if len(order) else order
            a, b = row[first], other[first]
        return pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], ["a", "b"])

    def run(batches):
        for t in whole_jobs(batches, least=0):
            yield compare(t)

    return sides[0].unionByName(sides[1]).repartition("j1", "j2").sortWithinPartitions("j1", "j2").mapInArrow(run, "a long, b long")


def whole_jobs(batches, least: int):
    """Tables of whole jobs from batches that are sorted by their first two columns: one job each, or as many as have ``least`` bytes together."""
    held: list[pa.RecordBatch] = []
    last, size = None, 0
    for b in batches:
        if not b.num_rows:
            continue
        j1, j2 = b.column(0).to_numpy(), b.column(1).to_numpy()
        new = (np.flatnonzero((j1[1:] != j1[:-1]) | (j2[1:] != j2[:-1])) + 1).tolist()
        starts = [0, *new] if last is not None and last != (j1[0], j2[0]) else new
        at = 0
        for to in starts:  # a job begins here
            if to > at:
                held.append(b.slice(at, to - at))
                size += held[-1].nbytes
                at = to
            if held and size > least:
                yield pa.Table.from_batches(held)
                held, size = [], 0
        held.append(b.slice(at))
        size += held[-1].nbytes
        last = (j1[-1], j2[-1])
    if held:
        yield pa.Table.from_batches(held)


def _compare(docs: DataFrame, facts: DataFrame, pairs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """a, b: the pairs of members that are linked, by their whole texts. ``facts``: member, key (of one of its texts)."""

    pairs = stored(pairs, "to-verify")
    sides = [pairs.select("a", "b", F.col(m).alias("member")) for m in ("a", "b")]
    wanted = hot_join(sides[0].unionByName(sides[1]), facts.select("member", "key"), ["member"])
    needed = hash_bits(wanted.select("key"))  # most texts that no pair needs stay where they are

    def to_bodies(batches):
        pack, seen = zstandard.ZstdCompressor().compress, set()
        for b in batches:
            keys, new = b.column(0).to_numpy(), []
            some = np.flatnonzero(has_bit(needed, keys.view(np.uint64)))
            for at, key in zip(some.tolist(), keys[some].tolist()):
                if key not in seen:
                    seen.add(key)
                    new.append(at)
            if len(seen) > REMEMBERED:
                seen = set()
            column, names = b.column(1).take(pa.array(new, pa.int64())), pa.array(keys[new], pa.int64()) if new else pa.array([], pa.int64())
            for i, j, texts in text_parts(column, lower=True):
                yield pa.RecordBatch.from_arrays([names.slice(i, j - i), pa.array(list(map(pack, texts)), pa.binary())], ["key", "body"])

    bodies = docs.select(F.xxhash64("text").alias("key"), "text").mapInArrow(to_bodies, "key long, body binary")
    # tasks send the same text each; different texts of one key are told apart by the set that they give
    sent = hot_join(wanted, bodies.withColumn("other", F.xxhash64("body")).dropDuplicates(["key", "other"]), ["key"]).select("a", "b", "member", "body")

    def verify(t: pa.Table) -> pa.RecordBatch:
        a, b, ids, unpack = t["a"].to_numpy(), t["b"].to_numpy(), t["member"].to_numpy(), zstandard.ZstdDecompressor().decompress
        job = np.concatenate([[0], np.cumsum((a[1:] != a[:-1]) | (b[1:] != b[:-1]))])
        flat, sizes = [], []
        for at in range(0, len(ids), 64):
            texts = [unpack(x) for x in t["body"].slice(at, 64).to_pylist()]
            for i, j in batches_of(texts):
                h, n = shingle_sets(texts[i:j], k)
                right = set_ids(h, n).view(np.int64) == ids[at + i : at + j]
                flat.append(h[np.repeat(right, n)])
                sizes.append(np.where(right, n, 0))
        h, sizes = np.concatenate(flat), np.concatenate(sizes)
        rows = np.repeat(job, sizes)
        order = np.lexsort((h, rows))
        same = (h[order[1:]] == h[order[:-1]]) & (rows[order[1:]] == rows[order[:-1]])
        both, total = np.bincount(rows[order[1:]][same], minlength=int(job[-1]) + 1), np.bincount(job, sizes, int(job[-1]) + 1).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], job[1:] != job[:-1]]))
        hit = (both > 0) & (den * both >= num * (total - both))
        return pa.RecordBatch.from_arrays([pa.array(a[first][hit]), pa.array(b[first][hit])], ["a", "b"])

    def run(batches):
        for t in whole_jobs(batches, least=SEGMENT):
            yield verify(t)

    return sent.repartition("a", "b").sortWithinPartitions("a", "b").mapInArrow(run, "a long, b long")


def members_with_roots(rows: DataFrame, carry: list[str], k: int, num: int, den: int, most: int = LIST, block: int = BLOCK) -> DataFrame:
    """carry..., n_shingles, root: a component's id as a hash; null for texts without words."""
    frequent = frequent_filter(rows, k)
    members = stored(members_of(rows, frequent, carry, k, num, den), "members")
    roots = links(rows.select("text"), members, frequent, k, num, den, most, block)
    out = stored(hot_join(members, roots.withColumnRenamed("node", "member").withColumnRenamed("root", "reached"), ["member"], "left").select(*carry, "n_shingles", F.coalesce("reached", "member").alias("root")), "roots")
    forget(members)
    return out


def components(docs: DataFrame, k: int = SHINGLE, num: int = NUMERATOR, den: int = DENOMINATOR, most: int = LIST, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id of every row: the least doc_id that links reach.

    Documents of fewer words than a shingle are one shingle; null, empty and blank texts have none and are linked with nothing, not even with each other. Rows that
    repeat are linked. A row without doc_id is a member like any other; its component's id is the least id there is, or null.
    An empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    member = members_with_roots(rows, ["doc_id"], k, num, den, most, block)
    least = member.filter("root is not null").groupBy("root").agg(F.min("doc_id").alias("least"))
    return hot_join(member, least, ["root"], "left").select("doc_id", "n_shingles", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def keep_one(docs: DataFrame, k: int = SHINGLE, num: int = NUMERATOR, den: int = DENOMINATOR) -> DataFrame:
    """``docs`` with one row of each component: that of the least doc_id (null ids last; of equal ids, the least hash).

    Rows without words are linked with nothing and all stay. An empty table gives no rows. Rows are told apart by 128 bits of hashes of id and text.
    """
    hashes = {"row_key": F.xxhash64("doc_id", "text"), "row_key2": F.xxhash64(F.lit(k), "text", "doc_id")}
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(c.alias(n) for n, c in hashes.items()), F.col("text").cast("string").alias("text"))
    member = members_with_roots(rows, ["doc_id", *hashes], k, num, den)
    best = member.filter("root is not null").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", *hashes)).alias("best"))
    keep = best.select("best.row_key", "best.row_key2", F.lit(True).alias("one")).unionByName(member.filter("root is null").select(*hashes, F.lit(False).alias("one")).distinct())
    carried = docs.select(*(c.alias(n) for n, c in hashes.items()), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    kept = carried.join(keep, [*hashes]).withColumn("nth", F.when(F.col("one"), F.lit(0).cast("long")).otherwise(F.monotonically_increasing_id() + 1))
    return kept.dropDuplicates([*hashes, "nth"]).select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))
