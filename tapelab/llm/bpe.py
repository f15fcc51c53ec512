"""Byte-level BPE in numpy: encoding by ranks and decoding.

Texts are cut where no match of the pattern can reach across: before a single space or line feed that a visible character
follows. Each distinct chunk, and each distinct pre-token in it, is encoded once per cache. New pre-tokens are bucketed by
length into padded matrices; each round every row merges its leftmost pair of least rank, found by a hashed lookup of
neighbouring pairs (after the first round, of the two new pairs), and the matrix is compacted by one column; rows without a
pair are done.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapelab.llm.hashing import HashTable

NO_PAIR = np.int32(2**31 - 1)
#: Longer pre-tokens are rows of their own: there a round merges all places of the least pair that don't depend on each other, which
#: gives the same ids in far fewer rounds.
LONG = 256
#: Texts are encoded together up to so many rows and characters.
ROWS, CHARS = 256, 1 << 20
#: What White_Space means to the pattern; the engine used here would count four more control characters.
_SPACE = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CUT = re.compile(f"(?=[{_SPACE}][^{_SPACE}])")
_OTHER_SPACE = re.compile(f"[{_SPACE}]".replace(r"\n", "").replace(" ", "")).search


class Ranks:
    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.bytes = {i: b for b, i in self.rank.items()}
        self.first = np.array([self.rank[bytes([i])] for i in range(256)], np.int32)
        self.pad = np.int32(max(self.bytes) + 1)  # is in no pair
        self.width = np.uint64(int(self.pad) + 1)
        self.token = [self.bytes.get(i, b"") for i in range(int(self.pad))]
        shown = [b"%d " % i for i in range(int(self.pad))]
        self.shown_len = np.array(list(map(len, shown)), np.int64)
        self.shown = np.frombuffer(b"".join(x.ljust(len(shown[-1])) for x in shown), np.uint8).reshape(len(shown), -1)
        keys, values = [], []
        for token, r in self.rank.items():
            for k in range(1, len(token)):
                a, b = self.rank.get(token[:k]), self.rank.get(token[k:])
                if a is not None and b is not None:
                    keys.append(a * int(self.width) + b)
                    values.append(r)
        self.pairs = HashTable(np.array(keys, np.uint64), np.array(values, np.int32))
        self.find = regex.compile(pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^{_SPACE}\p{{L}}\p{{N}}]").replace(r"\s", f"[{_SPACE}]").replace(r"\S", f"[^{_SPACE}]")).findall

    def lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair (a[i], b[i])."""
        got = self.pairs.get((a.astype(np.uint64) * self.width + b.astype(np.uint64)).ravel()).reshape(a.shape)
        return np.where(got < 0, NO_PAIR, got).astype(np.int32)

    def encode_all(self, tokens: list[bytes]) -> list[bytes]:
        """Ids of each pre-token, as little-endian int32."""
        out: list = [b""] * len(tokens)
        buckets: dict[int, list[int]] = {}
        for i, t in enumerate(tokens):
            if (r := self.rank.get(t)) is not None:
                out[i] = r.to_bytes(4, "little")
            elif len(t) > LONG:
                out[i] = self._long(t).tobytes()
            elif t:
                buckets.setdefault(max(4, 1 << (len(t) - 1).bit_length()), []).append(i)
        for n, at in buckets.items():
            for k in range(0, len(at), max(1, (1 << 20) // n)):
                part = at[k : k + max(1, (1 << 20) // n)]
                self._merge_rows([tokens[i] for i in part], part, n, out)
        return out

    def _merge_rows(self, tokens: list[bytes], at: list[int], n: int, out: list) -> None:
        sizes = np.array(list(map(len, tokens)))
        m = self.first[np.frombuffer(b"".join(t.ljust(n, b"\0") for t in tokens), np.uint8).reshape(len(at), n)]
        m[np.arange(n) >= sizes[:, None]] = self.pad
        rows, ranks = np.array(at), self.lookup(m[:, :-1], m[:, 1:])
        while len(rows):
            where = ranks.argmin(1) if ranks.shape[1] else np.zeros(len(m), np.int64)
            best = ranks[np.arange(len(m)), where] if ranks.shape[1] else np.full(len(m), NO_PAIR)
            done = best == NO_PAIR
            if done.any():
                own = m[done]
                inside = own != self.pad
                ends = (inside.sum(1).cumsum() * 4).tolist()
                data = own[inside].astype("<i4").tobytes()
                for i, a, b in zip(rows[done].tolist(), [0, *ends], ends):
                    out[i] = data[a:b]
                rows, m, ranks, where, best = rows[~done], m[~done], ranks[~done], where[~done], best[~done]
            if not len(rows):
                break
            each = np.arange(len(m))
            m[each, where] = best
            keep = np.ones(m.shape, bool)
            keep[each, where + 1] = False
            m = m[keep].reshape(len(m), -1)
            keep = np.ones(ranks.shape, bool)
            keep[each, where] = False
            ranks = ranks[keep].reshape(len(m), -1)
            left = np.flatnonzero(where > 0)
            ranks[left, where[left] - 1] = self.lookup(m[left, where[left] - 1], m[left, where[left]])
            right = np.flatnonzero(where < ranks.shape[1])
            ranks[right, where[right]] = self.lookup(m[right, where[right]], m[right, where[right] + 1])

    def _long(self, token: bytes) -> np.ndarray:
        ids = self.first[np.frombuffer(token, np.uint8)]
        while len(ids) > 1:
            ranks = self.lookup(ids[:-1], ids[1:])
            best = ranks.min()
            if best == NO_PAIR:
                break
            at = np.flatnonzero(ranks == best)
            if len(at) > 1 and (np.diff(at) == 1).any():  # of overlapping places, every other from the left of each run
                run = np.concatenate([[0], np.cumsum(np.diff(at) > 1)])
                first = np.concatenate([[0], np.flatnonzero(np.diff(at) > 1) + 1])
                at = at[(np.arange(len(at)) - first[run]) % 2 == 0]
            merged = self._merge(ids, at, best)
            if len(at) > 1 and len(merged) > 1 and self.lookup(merged[:-1], merged[1:]).min() < best:
                merged = self._merge(ids, at[:1], best)  # a merge made a pair that goes before the other places
            ids = merged
        return ids

    @staticmethod
    def _merge(ids: np.ndarray, at: np.ndarray, rank: int) -> np.ndarray:
        out = ids.copy()
        out[at] = rank
        return np.delete(out, at + 1)


@lru_cache(maxsize=2)
def ranks(path: str, pattern: str) -> Ranks:
    return Ranks(path, pattern)


@lru_cache(maxsize=1)
def encoder(path: str, pattern: str) -> Encoder:
    """One cache of chunks for all tasks of a worker."""
    return Encoder(path, pattern)


def defaults() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


class Encoder:
    """Encodes texts with bounded caches of chunks and of pre-tokens; what wasn't used for a generation is forgotten."""

    def __init__(self, path: str, pattern: str, cache_chunks: int = 150_000):
        self.ranks, self.most = ranks(path, pattern), cache_chunks
        self.chunks: dict[str, bytes] = {}  # behind a space (or, beginning with a line feed, as they are)
        self.tokens: dict[str, bytes] = {}
        self.old_chunks, self.old_tokens = self.chunks, self.tokens

    def _ids(self, tokens: list[str]) -> list[bytes]:
        """Ids of each pre-token, from the cache or new."""
        new = set(tokens).difference(self.tokens)
        self.tokens.update([(t, self.old_tokens[t]) for t in new if t in self.old_tokens])
        new = list(new.difference(self.tokens))
        self.tokens.update(zip(new, self.ranks.encode_all([t.encode("utf-8", "replace") for t in new])))
        got = list(map(self.tokens.__getitem__, tokens))
        _forget_long(self.tokens, new)
        return got

    def _encode_chunks(self, new: list[str]) -> list[bytes]:
        """New chunks: laid end to end they are a text that is cut where each begins, so one search finds all pre-tokens."""
        whole = [c if c[:1] == "\n" else " " + c for c in new]
        found = self.ranks.find("".join(whole))
        ids = self._ids(found)
        last = np.searchsorted(np.cumsum(list(map(len, found))), np.cumsum(list(map(len, whole))))  # of each chunk's pre-tokens
        ends = np.cumsum(list(map(len, ids)))[last].tolist()
        data = b"".join(ids)
        return [data[a:b] for a, b in zip([0, *ends], ends)]

    def batch(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, as little-endian int32."""
        if len(self.chunks) > self.most:
            self.old_chunks, self.chunks = self.chunks, {}
        if len(self.tokens) > self.most:
            self.old_tokens, self.tokens = self.tokens, {}
        heads, cut = [], []
        for t in texts:
            t = t or ""
            if "  " in t or " \n" in t or "\n " in t or "\n\n" in t or _OTHER_SPACE(t):  # runs of white space, or white space of another kind
                parts = _CUT.split(t)
                heads.append(parts[0])
                # a part behind the first begins with one white space and goes on with another character
                rest = [p[1:] if p[0] == " " else p for p in parts[1:]]
                cut.append(rest if all(p[0] == " " or p[0] == "\n" for p in parts[1:]) else None)
                if cut[-1] is None:
                    heads[-1], cut[-1] = t, []
            else:
                head, *rest = t.replace("\n", " \n").split(" ")
                heads.append(head)
                cut.append(rest)
        new = set().union(*cut).difference(self.chunks)
        self.chunks.update([(c, self.old_chunks[c]) for c in new if c in self.old_chunks])
        new = new.difference(self.chunks)
        self.chunks.update((c, self._ids([c or " "])[0]) for c in ("", "\n") if c in new)  # at the end of a text
        rest = list(new.difference(("", "\n")))
        self.chunks.update(zip(rest, self._encode_chunks(rest)))
        found = list(map(self.ranks.find, heads))
        ids = iter(self._ids([x for xs in found for x in xs]))
        out = [b"".join([next(ids) for _ in xs]) + b"".join(map(self.chunks.__getitem__, parts)) for xs, parts in zip(found, cut)]
        _forget_long(self.chunks, new)
        return out


def _forget_long(cache: dict[str, bytes], new) -> None:
    for c in [c for c in new if len(c) > 64]:
        del cache[c]


def _parts(column):
    """(rows, texts) of an Arrow column, ROWS rows or about CHARS characters at a time."""
    for k in range(0, len(column), ROWS):
        texts, at, size = column.slice(k, ROWS).to_pylist(), 0, 0
        for i, t in enumerate(texts, 1):
            size += len(t or "")
            if size >= CHARS or i == len(texts):
                yield slice(k + at, k + i), texts[at:i]
                at, size = i, 0


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, ids array<int> of every whole text; a null or empty text has no ids. Rows that repeat stay; an empty table gives none."""
    path, pattern = path or defaults()[0], pattern or defaults()[1]

    def run(batches):
        e = encoder(path, pattern)
        for b in batches:
            for rows, texts in _parts(b.column(1)):
                ids = [np.frombuffer(x, "<i4") for x in e.batch(texts)]
                yield pa.RecordBatch.from_arrays([b.column(0)[rows], pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, text (bytes) of rows of ids; null ids are empty, an unknown id fails."""
    path, pattern = path or defaults()[0], pattern or defaults()[1]

    def run(batches):
        of = ranks(path, pattern).bytes
        for b in batches:
            text = [b"".join(map(of.__getitem__, ids or ())) for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(text, pa.binary())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text binary")


def round_trip_digests(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: every whole text encoded, its ids decoded, both digested in the task.

    A null text is empty: no tokens, and the digests of nothing. Rows that repeat stay; an empty table gives no rows.
    """
    path, pattern = path or defaults()[0], pattern or defaults()[1]

    def run(batches):
        e = encoder(path, pattern)
        token, shown, shown_len = e.ranks.token, e.ranks.shown, e.ranks.shown_len
        place = np.arange(shown.shape[1])
        for b in batches:
            for rows, texts in _parts(b.column(1)):
                each = e.batch(texts)
                n = np.array([len(x) // 4 for x in each])
                ids = np.frombuffer(b"".join(each), "<i4")
                chars = shown_len[ids]
                decimal = shown[ids][place < chars[:, None]].tobytes()
                ends = np.concatenate([np.zeros(1, np.int64), chars.cumsum()])[np.concatenate([[0], n.cumsum()])].tolist()
                digests = [hashlib.sha256(decimal[i : max(i, j - 1)]).hexdigest() for i, j in zip(ends, ends[1:])]
                decoded = [hashlib.sha256(b"".join(map(token.__getitem__, np.frombuffer(x, "<i4").tolist()))).hexdigest() for x in each]
                yield pa.RecordBatch.from_arrays([b.column(0)[rows], pa.array(n, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
