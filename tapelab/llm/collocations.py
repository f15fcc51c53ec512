"""Phrase collocations: frequent phrases of two to four words of each language, ranked by how well they hold together.

Candidates are found level by level. A phrase can only be frequent if the phrases without its last and without its first
word are, so each task counts, by 64-bit hash, the phrases of k words at whose place and at the next place frequent phrases of k - 1
words begin; tasks add up what they see before Spark sums it. What is frequent goes back to the tasks as a bitmap of bounded
size. Hashes and bitmaps only let too many through: no frequent phrase is lost.

The candidates' words are then read once (from the texts whose mark is least, so that each is sent a few times only) and laid
out as tries in double arrays, of at most about MAX_PHRASES phrases each. A trie goes to all tasks; there all places of the texts
step from state to state at once, a word a level, and accepting states are counted. These counts, summed by Spark, are the exact ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapelab.llm.common import forget, stored
from tapelab.llm.hashing import HashTable
from tapelab.llm.wordhash import _BLANK, Words, mix, text_parts

LONGEST, LEAST, TOP = 4, 30, 2000
#: A longer phrase with at least this share (in hundredths) of a phrase's places makes the shorter one superfluous.
ABSORBED = 80
#: Phrases of one trie, and so of one pass over the texts.
MAX_PHRASES = 1 << 20
#: A bitmap has eight bits or more for each phrase, and at most this power of two.
MAX_BITS = 26
#: Places that a task gathers before it adds up what repeats.
GATHERED = 1 << 20
#: Parts of a trie's phrases that are numbered, and of a language's that are ranked, apart.
LOTS = 256
#: Counts that travel in one row.
LANES = 64

#: A-Z are lowered, what ends a piece becomes a line feed, and a tab a blank.
_READ = bytes(10 if c in b".,;:!?\x0a\x0b\x0c\x0d" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))


class Pieces(Words):
    """Words of a batch of texts, the piece that each word is in, and where it begins and ends in ``data``."""

    def __init__(self, texts: list[bytes]):
        texts = [t.translate(_READ) for t in texts]
        super().__init__(texts)
        self.data = b"\n".join([b"", *texts, b""])
        buf = np.frombuffer(self.data, np.uint8)
        blank = _BLANK[buf]
        self.begin = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
        self.end = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
        self.piece = np.searchsorted(np.flatnonzero(buf == 10), self.begin)

    def key(self, at: np.ndarray, k: int, seeds: np.ndarray) -> np.ndarray:
        """Hashes of the phrases of ``k`` words from words ``at``, each with its text's language."""
        return mix(self.run(at, k) ^ seeds[self.doc[at]])

    def marks(self) -> np.ndarray:
        """A hash of 31 bits of each text's words."""
        return (self.run(self.first[:-1], self.count) >> np.uint64(33)).astype(np.int64)

    def phrase(self, at: int, k: int) -> bytes:
        return b" ".join(self.data[self.begin[at] : self.end[at + k - 1]].split())


def has_bit(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether the bit of a hash is set in a bitmap of 2**n bits, whose place is the hash's first n bits."""
    n = (len(bits) * 32).bit_length() - 1
    bit = h >> np.uint64(64 - n)
    return (bits[(bit >> np.uint64(5)).astype(np.int64)] >> (bit & np.uint64(31)).astype(np.uint32)) & np.uint32(1) > 0


def bitmap(hashes: DataFrame) -> np.ndarray:
    """The bitmap of the hashes (one column, long): at most 2**MAX_BITS bits, put together in Spark."""
    h = F.col(hashes.columns[0])
    n = min(MAX_BITS, max(10, (8 * hashes.count()).bit_length()))
    bit = F.shiftrightunsigned(h, 64 - n)
    mask = F.element_at(F.array(*(F.lit(1 << i).cast("long") for i in range(32))), (bit.bitwiseAND(F.lit(31)) + 1).cast("int"))
    got = hashes.select(F.shiftright(bit, 5).alias("word"), mask.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()  # at most 2**(MAX_BITS - 5) rows
    out = np.zeros(1 << (n - 5), np.uint32)
    out[got["word"].to_numpy()] = got["bits"].to_numpy().astype(np.uint32)
    del got
    pa.default_memory_pool().release_unused()
    return out


def frequent_places(w: Pieces, seeds: np.ndarray, filters: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For k from 1 on, the places of phrases of k words that pass their bitmap, with their keys; last, for the level
    without a bitmap, all places that the levels below leave."""
    at = np.arange(len(w.hash))
    for k in range(1, len(filters) + 2):
        key = w.key(at, k, seeds)
        if k <= len(filters):
            hit = has_bit(filters[k - 1], key)
            at, key = at[hit], key[hit]
        yield k, at, key
        flag = np.zeros(len(w.hash) + 1, bool)
        flag[at] = True
        at = at[flag[at + 1]]
        at = at[w.piece[at] == w.piece[at + k]]


def _summed(keys: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, how often each stands, and its least mark."""
    order = np.argsort(keys)
    keys, marks = keys[order], marks[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.diff(np.append(first, len(keys))), np.minimum.reduceat(marks, first)


def _columns(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, Pieces, int]]:
    """Seeds, words and the first row's number of runs of rows of a batch (seed, text, ...)."""
    seeds = b.column(0).to_numpy().view(np.uint64)
    for at, to, texts in text_parts(b.column(1)):
        yield seeds[at:to], Pieces(texts), at


def count_level(texts: DataFrame, filters: list[np.ndarray]) -> DataFrame:
    """total, key, n, mark: counts of the phrases of the level above ``filters``; on the first level also (total = 1) each language's words."""
    level = len(filters) + 1

    def run(batches):
        have, size = [], 0

        def flush():
            keys, n, marks = _summed(np.concatenate([x[0] for x in have]), np.concatenate([x[1] for x in have]))
            for a in range(0, len(keys), 1 << 16):
                part = slice(a, a + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(keys[part]), np.int32)), pa.array(keys[part].view(np.int64)), pa.array(n[part]), pa.array(marks[part].astype(np.int32))], ["total", "key", "n", "mark"])

        for b in batches:
            for seeds, w, _ in _columns(b):
                if level == 1 and len(w.count):
                    langs, which = np.unique(seeds, return_inverse=True)
                    n = np.zeros(len(langs), np.int64)
                    np.add.at(n, which, w.count)
                    yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(langs), np.int32)), pa.array(langs.view(np.int64)), pa.array(n), pa.array(np.zeros(len(langs), np.int32))], ["total", "key", "n", "mark"])
                for k, at, key in frequent_places(w, seeds, filters):
                    if k == level and len(at):
                        have.append((key, w.marks()[w.doc[at]]))
                        size += len(at)
                if size >= GATHERED:
                    yield from flush()
                    have, size = [], 0
        if size:
            yield from flush()

    return texts.select("seed", "text").mapInArrow(run, "total int, key long, n long, mark int").groupBy("total", "key").agg(F.sum("n").alias("n"), F.min("mark").alias("mark"))


def marked(key: np.ndarray, mark: np.ndarray) -> np.ndarray:
    return mix(key ^ mix(mark.astype(np.uint64)))


def marked_keys(frequent: DataFrame) -> DataFrame:
    """The hash of each key with its least mark, as :func:`marked` makes it."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(marked(b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy()).view(np.int64))], ["hash"])

    return frequent.select("key", "mark").mapInArrow(run, "hash long")


def spelled_out(texts: DataFrame, filters: list[np.ndarray], chosen: list[np.ndarray]) -> DataFrame:
    """lang, k, key, phrase: the words of the phrases that pass ``filters``, from texts that ``chosen`` names for them."""

    def run(batches):
        for b in batches:
            for seeds, w, first in _columns(b):
                langs, marks = b.column(2), w.marks()
                for k, at, key in frequent_places(w, seeds, filters):
                    if k > len(filters):
                        break
                    hit = has_bit(chosen[k - 1], marked(key, marks[w.doc[at]]))
                    key, one = np.unique(key[hit], return_index=True)
                    at = at[hit][one]
                    if len(at):
                        yield pa.RecordBatch.from_arrays([langs.take(pa.array(w.doc[at] + first)).cast(pa.string()), pa.array(np.full(len(at), k, np.int32)), pa.array(key.view(np.int64)), pa.array([w.phrase(i, k).decode() for i in at.tolist()], pa.string())], ["lang", "k", "key", "phrase"])

    return texts.select("seed", "text", "lang").mapInArrow(run, "lang string, k int, key long, phrase string").distinct()


@dataclass
class Trie:
    """A double array: from state s, symbol c leads to base[s] + c, if check[base[s] + c] is s. A word is two symbols, the
    digits of its number to the base ``radix``, so that no state has more than ``radix`` children and the array stays dense. State 0 is
    the root, from which each language, numbered like a word, leads on; accept is a phrase's number, or -1."""

    base: np.ndarray
    check: np.ndarray
    accept: np.ndarray
    radix: int
    words: HashTable
    langs: dict[int, int]

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which states have a next one for their word, by place, and those states."""
        to = self.base[state] + word // self.radix
        at = np.flatnonzero(self.check[to] == state)
        half = to[at]
        to = self.base[half] + word[at] % self.radix
        there = self.check[to] == half
        return at[there], to[there]


def place(parent: np.ndarray, symbol: np.ndarray, nodes: int, symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """Bases of the nodes and slots of the edges (parent, symbol), so that no two edges share a slot and slot 0 stays free.

    Nodes of many children come first and one by one, behind all others if they fit nowhere soon; the others all try a slot at once, and those that meet no other keep it.
    """
    order = np.argsort(parent, kind="stable").astype(np.int32)
    count = np.bincount(parent, minlength=nodes).astype(np.int32)
    first = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
    slots = max(1024, 2 * (len(parent) + 1))
    rng = np.random.default_rng(0)
    used = np.zeros(slots + symbols, bool)
    used[0] = True
    end = 1
    base = np.full(nodes, -1, np.int64)
    inner = np.flatnonzero(count)
    for node in inner[np.argsort(-count[inner], kind="stable")]:
        if count[node] <= 16:
            break
        mine = symbol[order[first[node] : first[node + 1]]]
        if max(slots, end) + symbols > len(used):
            used = np.concatenate([used, np.zeros(len(used) // 4 + symbols, bool)])
        for b in [*rng.integers(1, max(slots, end), 24).tolist(), end]:
            if not used[b + mine].any():
                break
        base[node] = b
        used[b + mine] = True
        end = max(end, b + int(mine.max()) + 1)
    slots = max(slots, end)
    for least in (8, 4, 3, 2, 1):
        tries = 0
        while len(todo := np.flatnonzero((base < 0) & (count >= least) & (count <= 16))):
            tries += 1
            if tries % 64 == 0:  # too full for the rest
                slots += slots // 2
            if slots + symbols > len(used):
                used = np.concatenate([used, np.zeros(slots + symbols - len(used), bool)])
            trial = rng.integers(1, slots, len(todo))
            which = np.repeat(np.arange(len(todo), dtype=np.int32), count[todo])
            slot = first[todo[which]] - np.repeat((np.cumsum(count[todo]) - count[todo]).astype(np.int32), count[todo]) + np.arange(len(which), dtype=np.int32)
            slot = trial[which] + symbol[order[slot]]
            owner = np.full(len(used), len(todo), np.int32)
            np.minimum.at(owner, slot, which)
            bad = np.bincount(which, used[slot] | (owner[slot] != which), len(todo)) > 0
            base[todo[~bad]] = trial[~bad]
            used[slot[~bad[which]]] = True
    return base, base[parent] + symbol


def build_trie(seeds: np.ndarray, sizes: np.ndarray, hashes: np.ndarray, numbers: np.ndarray) -> Trie:
    """The trie of phrases: each below the symbol of its language's seed, ``sizes`` words long, its words' hashes a row of ``hashes``."""
    words, word, uses = np.unique(hashes[np.arange(hashes.shape[1]) < sizes[:, None]], return_inverse=True, return_counts=True)
    rank = np.empty(len(words), np.int64)
    rank[np.argsort(-uses, kind="stable")] = np.arange(len(words))  # common words are near each other
    word, first = rank[word].astype(np.int32), np.concatenate([[0], np.cumsum(sizes)])
    del uses
    langs, lang = np.unique(seeds, return_inverse=True)
    radix = int(np.ceil(np.sqrt(len(words) + len(langs))))
    parents, symbols, nodes = [], [], 1
    at = np.zeros(len(seeds), np.int64)  # each phrase's node so far
    for k in range(int(sizes.max(initial=0)) + 1):
        live = np.flatnonzero(sizes >= k)
        number = len(words) + lang[live] if k == 0 else word[first[live] + k - 1]
        for symbol in (number // radix, number % radix):
            pairs, child = np.unique(at[live] * radix + symbol, return_inverse=True)
            parents.append((pairs // radix).astype(np.int32))
            symbols.append((pairs % radix).astype(np.int32))
            at[live] = nodes + child
            nodes += len(pairs)
    parent, symbol = np.concatenate(parents), np.concatenate(symbols)
    del parents, symbols, word, first, live, number, pairs, child
    base_of, slot = place(parent, symbol, nodes, radix)
    slot_of = np.concatenate([[0], slot])  # nodes are numbered as their edges are, after the root
    size = int(base_of.max()) + radix + 1
    base, check, accept = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    base[slot_of] = np.maximum(base_of, 0)
    check[slot] = slot_of[parent]
    accept[slot_of[at]] = numbers
    return Trie(base, check, accept, radix, HashTable(words, rank), {int(s): len(words) + i for i, s in enumerate(langs)})


def word_hashes(phrases: list[bytes], longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray]:
    """How many words each phrase has, and their hashes in ``longest`` columns."""
    w = Words(phrases)
    out = np.zeros((len(phrases), longest), np.uint64)
    out[w.doc, np.arange(len(w.hash)) - w.first[w.doc]] = w.hash
    return w.count, out


def trie_of(numbered: DataFrame, longest: int) -> tuple[Trie, int] | None:
    """The trie of a shard's phrases (lang, phrase, lot, nth), and how many numbers a lot has; only hashes of words come to the driver."""
    columns = [f"h{i}" for i in range(longest)]

    def run(batches):
        for b in batches:
            sizes, hashes = word_hashes([p.encode() for p in b.column(1).to_pylist()], longest)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes), b.column(2), b.column(3), *(pa.array(np.ascontiguousarray(hashes[:, i]).view(np.int64)) for i in range(longest))], ["seed", "size", "lot", "nth", *columns])

    rows = numbered.select(F.xxhash64("lang").alias("seed"), "phrase", "lot", "nth").mapInArrow(run, "seed long, size long, lot int, nth int, " + ", ".join(f"{c} long" for c in columns))
    got = rows.toArrow()  # about max_phrases rows of numbers
    if not len(got):
        return None
    stride = int(got["nth"].to_numpy().max()) + 1
    hashes = np.stack([got[c].to_numpy().view(np.uint64) for c in columns], 1)
    seeds, sizes, numbers = got["seed"].to_numpy().view(np.uint64), got["size"].to_numpy(), got["lot"].to_numpy().astype(np.int64) * stride + got["nth"].to_numpy()
    del got
    pa.default_memory_pool().release_unused()  # the trie's own work needs the room
    return build_trie(seeds, sizes, hashes, numbers), stride


def accepted(w: Pieces, seeds: np.ndarray, trie: Trie) -> Iterator[np.ndarray]:
    """The numbers of the phrases at all places of a batch, level by level."""
    doc_state = np.full(len(seeds), -1, np.int64)
    for seed in np.unique(seeds):
        if int(seed) in trie.langs:
            _, doc_state[seeds == seed] = trie.step(np.zeros(1, np.int64), np.array([trie.langs[int(seed)]]))
    symbol = np.append(trie.words.get(w.hash), -1).astype(np.int64)
    piece = np.append(w.piece, -1)
    state = doc_state[w.doc]
    at = np.flatnonzero((symbol[:-1] >= 0) & (state >= 0))
    state = state[at]
    for k in range(1, LONGEST + 1):
        there, state = trie.step(state, symbol[at + k - 1])
        at = at[there]
        number = trie.accept[state]
        yield number[number >= 0]
        if k == LONGEST:
            break
        after = at + k  # the place behind the last word is in no piece
        on = (piece[after] == piece[at]) & (symbol[after] >= 0)
        at, state = at[on], state[on]


def count_phrases(texts: DataFrame, trie: Trie, size: int) -> DataFrame:
    """number, f: how often each phrase of the trie stands in ``texts``; numbers are below ``size``."""
    blocks = -(-size // LANES)
    lanes = [f"c{i}" for i in range(LANES)]

    def run(batches):
        total, have, waiting = np.zeros(blocks * LANES, np.int64), [], 0
        for b in batches:
            for seeds, w, _ in _columns(b):
                for found in accepted(w, seeds, trie):
                    have.append(found)
                    waiting += len(found)
                if waiting >= GATHERED:
                    total += np.bincount(np.concatenate(have), minlength=len(total))
                    have, waiting = [], 0
        if waiting:
            total += np.bincount(np.concatenate(have), minlength=len(total))
        rows = total.reshape(blocks, LANES)
        some = np.flatnonzero(rows.any(1))
        for a in range(0, len(some), 4096):
            part = some[a : a + 4096]
            yield pa.RecordBatch.from_arrays([pa.array(part), *(pa.array(np.ascontiguousarray(rows[part, i])) for i in range(LANES))], ["block", *lanes])

    sums = texts.select("seed", "text").mapInArrow(run, "block long, " + ", ".join(f"{c} long" for c in lanes)).groupBy("block").agg(*(F.sum(c).alias(c) for c in lanes))
    return sums.select("block", F.posexplode(F.array(*lanes))).select((F.col("block") * LANES + F.col("pos")).alias("number"), F.col("col").alias("f")).filter("f > 0")


def frequent_phrases(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, max_phrases: int = MAX_PHRASES) -> tuple[DataFrame, DataFrame]:
    """(lang, k, phrase, f) of all phrases of up to ``longest`` words that stand ``least`` times or more, and (lang_seed, n), each language's words."""
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und"))
    texts = docs.select(F.xxhash64(lang).alias("seed"), F.col("text").cast("string").alias("text"), lang.alias("lang"))
    filters, chosen, levels, totals = [], [], [], None
    for k in range(1, longest + 1):
        counts = count_level(texts, filters).filter((F.col("n") >= least) | (F.col("total") == 1))
        level = stored(counts, f"phrases-{k}")
        if k == 1:
            totals = level.filter("total = 1").select(F.col("key").alias("lang_seed"), "n")
        level_keys = level.filter("total = 0")
        levels.append(level)
        filters.append(bitmap(level_keys.select("key")))
        chosen.append(bitmap(marked_keys(level_keys)))
    keys = levels[0].filter("total = 0").select(F.lit(1).alias("k"), "key")
    for k, level in enumerate(levels[1:], 2):
        keys = keys.unionAll(level.select(F.lit(k).alias("k"), "key"))
    found = stored(spelled_out(texts, filters, chosen).join(keys, ["k", "key"], "left_semi").drop("key"), "spelled")
    del filters, chosen
    shards = max(1, -(-found.count() // max_phrases))
    h = F.xxhash64("lang", "phrase")
    lots = found.withColumn("shard", F.pmod(h, F.lit(shards)).cast("int")).withColumn("lot", F.pmod(F.shiftrightunsigned(h, 32), F.lit(LOTS)).cast("int"))
    lots = stored(lots.withColumn("nth", F.row_number().over(Window.partitionBy("shard", "lot").orderBy("lang", "phrase")) - 1), "numbered")
    counted = []
    for shard in range(shards):
        built = trie_of(lots.filter(F.col("shard") == shard), longest)
        if built is None:
            continue
        trie, stride = built
        counts = count_phrases(texts, trie, LOTS * stride)
        place_of = counts.select(F.lit(shard).alias("shard"), F.floor(F.col("number") / stride).cast("int").alias("lot"), F.pmod("number", F.lit(stride)).cast("int").alias("nth"), "f")
        counted.append(stored(lots.join(place_of, ["shard", "lot", "nth"]).filter(F.col("f") >= least).select("lang", "k", "phrase", "f"), "counted"))
    out = counted[0] if counted else found.select("lang", "k", "phrase", F.lit(0).cast("long").alias("f")).limit(0)
    for c in counted[1:]:
        out = out.unionAll(c)
    forget(*levels[1:], found)
    return out, totals


def _wide(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(20,0)")


def scored(phrases: DataFrame) -> DataFrame:
    """lang, k, phrase, a, l, r, score of the phrases of two words and more: the cut of the least score, ties to the earlier cut."""
    words = F.split("phrase", " ")
    long = phrases.filter("k >= 2").select("lang", "k", "phrase", F.col("f").alias("a"), words.alias("w"))
    cuts = long.select("lang", "k", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("lang", "k", "phrase", "a", "cut", F.array_join(F.slice("w", F.lit(1), F.col("cut")), " ").alias("head"), F.array_join(F.slice("w", F.col("cut") + 1, F.col("k") - F.col("cut")), " ").alias("tail"))
    heads = phrases.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    tails = phrases.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r"))
    both = cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"])
    score = both.withColumn("wide", _wide("a") * 2_000_000).withColumn("sum", _wide("l") + _wide("r")).withColumn("score", F.expr("wide div sum"))
    return score.groupBy("lang", "k", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best")).select("lang", "k", "phrase", "a", "best.l", "best.r", "best.score")


def not_absorbed(candidates: DataFrame, share: int = ABSORBED) -> DataFrame:
    """Without the candidates that stand inside a longer one of at least ``share`` hundredths of their places."""
    w = F.split("phrase", " ")
    longer = candidates.filter("k >= 3").select("lang", "k", "a", w.alias("w"))
    inner = longer.select("lang", "k", "a", "w", F.explode(F.sequence(F.lit(2), F.col("k") - 1)).alias("size"))
    inner = inner.select("lang", "a", "w", "size", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("size") + 1)).alias("from"))
    most = inner.select("lang", F.array_join(F.slice("w", F.col("from"), F.col("size")), " ").alias("phrase"), F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = candidates.join(most, ["lang", "phrase"], "left")
    return kept.filter(F.col("longer").isNull() | (_wide("longer") * 100 < _wide("a") * share)).drop("longer")


def best(candidates: DataFrame, top: int = TOP) -> DataFrame:
    """rank: the first ``top`` of each language by score, places and phrase. Lots of a language are cut to ``top`` before they meet."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    lot = F.pmod(F.xxhash64("phrase"), F.lit(LOTS))
    first = candidates.withColumn("lot", lot).withColumn("nth", F.row_number().over(Window.partitionBy("lang", "lot").orderBy(*order))).filter(F.col("nth") <= top).drop("lot", "nth")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)


def mine(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int = TOP, max_phrases: int = MAX_PHRASES) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases.

    Null texts are empty, null languages are und; rows that repeat count each; ties go by places, then by phrase in byte
    order; texts without a frequent phrase and empty tables give no rows.
    """
    phrases, totals = frequent_phrases(docs, longest, least, max_phrases)
    ranked = best(not_absorbed(scored(phrases)), top)
    return ranked.withColumn("lang_seed", F.xxhash64("lang")).join(totals, "lang_seed").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
