"""Packing token sequences by minimum bin slack.

A task packs the documents of its partition as they stream by. A document longer than a sequence fills whole sequences
first; its rest waits in a pool. Each time the pool is large enough, the longest rest opens a sequence, and a bitset
subset-sum dynamic program over the multiset of waiting lengths finds the sum closest to the room that is left; the
counts of each length are backtracked. Room that no subset fills is filled by cutting one waiting rest. What the
stream leaves in the end is cut into sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 2048
POOL = 256
END_ID = 1
#: Bytes of texts whose distinct words are looked up together.
TOGETHER = 4 << 20


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: ASCII punctuation: behind a run of letters it is a pre-token of its own.
_PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())


@lru_cache(maxsize=1)
def _letters_apart() -> re.Pattern:
    """Letters that the tokenizer takes apart into a letter and a mark: in lower case and composed they are no letters any more."""
    return re.compile("[" + "".join(c for c in map(chr, range(128, 0x20000)) if c.isalpha() and not unicodedata.normalize("NFC", c.lower()).isalpha()) + "]")


class WordTokens:
    """Ids of texts by a tokenizer that never joins across blanks: each distinct word of a batch is looked at once, by Arrow where it can be.

    Most words are a run of letters with ASCII punctuation behind: two pre-tokens, of which each ends with the only token
    that carries the end-of-word mark. Such runs are encoded many to a call, whatever their case, and cut at those marks; other words one by
    one, also those with a letter that the tokenizer takes apart into a letter and a mark. Ids are held as bytes (little-endian int32), so that
    those of a text are its words' behind one another. What was encoded is kept in (bounded) caches, which forget what wasn't used for a generation.
    """

    def __init__(self, path: str, cache_words: int = 100_000):
        self.encode = _tokenizer(path).encode_batch_fast
        vocab = _tokenizer(path).get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.words, self.runs = _Cache(self._encode_words, cache_words), _Cache(self._encode_runs, cache_words)

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, "<i4") for x in self.encode(texts, add_special_tokens=False)]

    def _encode_runs(self, runs: list[bytes], together: int = 200) -> list[bytes]:
        out = []
        parts = [runs[k : k + together] for k in range(0, len(runs), together)]
        for part, ids in zip(parts, self._ids([b" ".join(p).decode("utf-8") for p in parts])):
            ends = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
            data = ids.tobytes()
            if len(ends) == len(part):
                out += [data[i:j] for i, j in zip([0, *ends[:-1]], ends)]
            else:
                out += self._encode_words(part)
        return out

    def _encode_words(self, words: list[bytes]) -> list[bytes]:
        return [x.tobytes() for x in self._ids([w.decode("utf-8") for w in words])]

    def _of_distinct(self, words: pa.Array) -> pa.Array:
        """The ids of each of the words, which differ; an empty one has none."""
        core = pc.ascii_rtrim(words, _PUNCTUATION.decode())
        tail_bytes = pc.subtract(pc.binary_length(words), pc.binary_length(core)).to_numpy()
        plain = pc.ascii_is_alpha(core).to_numpy(zero_copy_only=False)
        rest, tailed = np.flatnonzero(~plain), np.flatnonzero(tail_bytes)
        cores, others = _bytes(core.take(pa.array(rest))), []
        apart = _letters_apart()
        if not apart.search(b" ".join(cores).decode("utf-8")):  # most often none has such a letter
            apart = None
        for k, c in enumerate(cores):
            if c and len(c) < 200 and (s := c.decode("utf-8")).isalpha() and not (apart and apart.search(s)):
                if "Σ" not in s:
                    cores[k] = s.lower().encode("utf-8")
            else:
                others.append(k)
                cores[k] = b""
        tails = [w[len(w) - n :] for w, n in zip(_bytes(words.take(pa.array(tailed))), tail_bytes[tailed].tolist())]
        lower = pc.ascii_lower(core).view(pa.binary())
        runs = pa.concat_arrays([lower.filter(pa.array(plain)), pa.array([*cores, *tails, b""], pa.binary())]).dictionary_encode()
        ids = pa.array(self.runs.of(_bytes(runs.dictionary)), pa.large_binary())
        at, n = runs.indices.to_numpy(), len(words)
        first, last = np.empty(n, np.int32), np.full(n, at[-1], np.int32)
        first[plain], first[rest] = at[: n - len(rest)], at[n - len(rest) : n]
        last[tailed] = at[n:-1]
        out = pc.binary_join_element_wise(ids.take(pa.array(first)), ids.take(pa.array(last)), pa.scalar(b"", pa.large_binary()))
        if others:
            own = rest[others]
            whole = pa.array(self.words.of(_bytes(words.take(pa.array(own)))), pa.large_binary())
            place = np.arange(n)
            place[own] = n + np.arange(len(own))
            out = pa.concat_arrays([out, whole]).take(pa.array(place))
        return out

    def column(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of every text of a string column; a null is empty."""
        split = pc.ascii_split_whitespace(texts.cast(pa.string()).fill_null(""))
        words = split.flatten().dictionary_encode()
        if not len(words):
            return [np.empty(0, "<i4")] * len(texts)
        ids = self._of_distinct(words.dictionary).take(words.indices)
        ends = np.concatenate([[0], np.cumsum(pc.binary_length(ids).to_numpy() // 4)])
        at = ends[np.concatenate([[0], np.cumsum(split.value_lengths().to_numpy())])].tolist()
        data = np.frombuffer(ids.buffers()[2] or b"", "<i4")
        return [data[a:b] for a, b in zip(at, at[1:])]

    def batch(self, texts: list[str | None]) -> list[np.ndarray]:
        return self.column(pa.array([(t or "").encode("utf-8", "replace") for t in texts], pa.binary()).view(pa.string()))


def _bytes(strings: pa.Array) -> list[bytes]:
    return strings.view(pa.binary()).to_numpy(zero_copy_only=False).tolist()


class _Cache:
    """Ids by word, made by ``encode`` for those that are new; long words are not kept."""

    def __init__(self, encode, most: int):
        self.encode, self.most = encode, most
        self.now: dict[bytes, bytes] = {}
        self.old = self.now

    def of(self, words: list[bytes]) -> list[bytes]:
        if len(self.now) > self.most:
            self.old, self.now = self.now, {}
        self.now[b""] = b""
        out = list(map(self.now.get, words))
        gone = [k for k, x in enumerate(out) if x is None]
        new = []
        for k in gone:  # what was used in the generation before lives on
            if (x := self.old.get(words[k])) is None:
                new.append(k)
            else:
                out[k] = self.now[words[k]] = x
        for k, x in zip(new, self.encode([words[k] for k in new]) if new else ()):
            out[k] = x
            if len(words[k]) <= 64:
                self.now[words[k]] = x
        return out


@lru_cache(maxsize=1)
def word_tokens(path: str) -> WordTokens:
    """One cache for all tasks of a worker."""
    return WordTokens(path)


def best_subset(counts: dict[int, int], room: int) -> dict[int, int]:
    """How many of each length to take so that their sum is as near below ``room`` as any: bitset subset sums, backtracked."""
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for length, n in counts.items():
        n = min(n, room // length)
        k = 1
        while n > 0 and not reach >> room:
            k = min(k, n)
            steps.append((length, k, reach))
            reach |= (reach << (length * k)) & mask
            n -= k
            k *= 2
        if reach >> room:
            break
    at, take = reach.bit_length() - 1, {}
    for length, k, before in reversed(steps):
        if not before >> at & 1:
            take[length] = take.get(length, 0) + k
            at -= length * k
    return take


class Packer:
    """Takes (key, ids) one after the other; ``rows`` collects pieces as (key, start, ids, doc_tokens, sequence, offset)."""

    def __init__(self, first_sequence: int, capacity: int = CAPACITY, pool: int = POOL):
        self.sequence, self.capacity, self.most = first_sequence, capacity, pool
        self.pool: dict[int, list] = {}
        self.n = self.tokens = 0
        self.rows: list[tuple] = []

    def _emit(self, pieces: list) -> None:
        offset = 0
        for key, start, ids, total in pieces:
            self.rows.append((key, start, ids, total, self.sequence, offset))
            offset += len(ids)
        self.sequence += 1

    def _put(self, piece) -> None:
        self.pool.setdefault(len(piece[2]), []).append(piece)
        self.n += 1
        self.tokens += len(piece[2])

    def _take(self, length: int):
        waiting = self.pool[length]
        piece = waiting.pop()
        if not waiting:
            del self.pool[length]
        self.n -= 1
        self.tokens -= length
        return piece

    def add(self, key, ids: np.ndarray) -> None:
        whole = len(ids) // self.capacity * self.capacity
        for s in range(0, whole, self.capacity):
            self._emit([(key, s, ids[s : s + self.capacity], len(ids))])
        if whole < len(ids):
            self._put((key, whole, ids[whole:], len(ids)))
        while self.n >= self.most and self.tokens >= self.capacity:
            self._fill()

    def _fill(self) -> None:
        """One full sequence from a pool that holds at least as many tokens."""
        pieces = [self._take(max(self.pool))]
        room = self.capacity - len(pieces[0][2])
        if room:
            for length, k in best_subset({n: len(x) for n, x in self.pool.items() if n <= room}, room).items():
                pieces += [self._take(length) for _ in range(k)]
            room = self.capacity - sum(len(x[2]) for x in pieces)
            while room:
                key, start, ids, total = self._take(min((n for n in self.pool if n > room), default=max(self.pool)))
                pieces.append((key, start, ids[:room], total))
                if len(ids) > room:
                    self._put((key, start + room, ids[room:], total))
                room -= len(pieces[-1][2])
        self._emit(pieces)

    def finish(self) -> None:
        while self.tokens >= self.capacity:
            self._fill()
        left = [self._take(n) for n in sorted(self.pool, reverse=True) for _ in range(len(self.pool[n]))]
        size = self.capacity
        while left:
            while size > sum(len(x[2]) for x in left):
                size //= 2
            room, pieces = size, []
            while room:
                key, start, ids, total = left.pop(0)
                pieces.append((key, start, ids[:room], total))
                if len(ids) > room:
                    left.insert(0, (key, start + room, ids[room:], total))
                room -= len(pieces[-1][2])
            self._emit(pieces)


def pack(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, pool: int = POOL, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids) of every piece.

    Null texts are empty: they are the end id alone. A row is packed by its own, so repeated rows and null doc_ids are
    just packed. Sequence ids begin with the partition's number and don't repeat. Empty tables give no pieces.
    """
    path = tokenizer_path or default_tokenizer()
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    names = [x.split()[0] for x in schema.split(", ")]

    def batch(rows):
        cols = [
            pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([len(r[2]) for r in rows], pa.int64()),
            pa.array([zlib.crc32(r[2].astype("<u4").tobytes()) for r in rows], pa.int64()), *(pa.array([r[k] for r in rows], pa.int64()) for k in (3, 4, 5)),
        ]
        return pa.RecordBatch.from_arrays(cols + [pa.array([r[2] for r in rows], pa.list_(pa.int32()))] * with_ids, names)

    def run(batches):
        tokens, packer = word_tokens(path), Packer(TaskContext.get().partitionId() << 40, capacity, pool)
        for b in batches:
            step = max(1, min(2048, b.num_rows * TOGETHER // max(1, b.nbytes)))  # rows, of about TOGETHER bytes
            for k in range(0, b.num_rows, step):
                part = b.slice(k, step)
                for key, ids in zip(part.column(0).to_pylist(), tokens.column(part.column(1))):
                    packer.add(key, np.append(ids, np.int32(END_ID)))
                if packer.rows:
                    yield batch(packer.rows)
                    packer.rows = []
        packer.finish()
        if packer.rows:
            yield batch(packer.rows)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
