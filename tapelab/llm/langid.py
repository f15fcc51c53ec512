"""Language identification by segmentation-marginalised unigrams.

Each language has probabilities for the pieces of one fixed public vocabulary. A word's probability in a language is
the sum, over all ways to cut it into pieces, of the product of their probabilities: a forward algorithm along the
word. Words are cut alone, so a text's log-likelihood is the sum over its words, and each distinct word of a batch is
scored once. Probabilities are learned by expectation-maximisation over the words of a bounded sample.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapelab.llm.common import fold
from tapelab.llm.hashing import HashTable

#: At most about so many documents of each language are learned from: rows of the training folds whose hash
#: falls below the share that gives this many.
MAX_DOCS_PER_LANG = 1000
ROUNDS = 3
#: A piece that a language didn't use counts as this many uses; a character outside the vocabulary has the rarest piece's share.
SMOOTHING = 0.05
_WORDS = re.compile(r"[^\W\d_]+")
_SPACE = "▁"
_B = 0x100000001B3


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@lru_cache(maxsize=2)
def vocabulary(path: str) -> tuple[tuple[str, ...], HashTable]:
    """The lower-case pieces of letters (a word's first piece begins with the space mark), and hash -> index; the table knows the pieces' ``longest`` length."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i))}
    kept = tuple(sorted(p for p in pieces if p == p.lower() and (p[0] == _SPACE or p.isalpha()) and (p == _SPACE or p.lstrip(_SPACE).isalpha())))
    return kept, table_of(kept)


def table_of(pieces: tuple[str, ...]) -> HashTable:
    table = HashTable(np.array([_hash(p) for p in pieces], np.uint64), np.arange(len(pieces), dtype=np.int32))
    table.longest = max(map(len, pieces), default=1)
    table.powers = np.array([pow(_B, k, 2**64) for k in range(table.longest)], np.uint64)
    return table


def _hash(piece: str) -> int:
    h = 0
    for c in piece:
        h = (h * _B + ord(c) + 1) & (2**64 - 1)
    return h


def words_of(text: str | None) -> list[str]:
    return _WORDS.findall(text.lower()) if text else []


def has_letter(text: str | None, words: list[str]) -> bool:
    return any(w.isalpha() for w in words) or any(map(str.isalpha, text or ""))


def _by_length(words: list[str]):
    """(positions, code points + 1 as a matrix, its first column the space mark) for each length of word."""
    groups: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        groups.setdefault(len(w), []).append(i)
    for n, at in groups.items():
        for k in range(0, len(at), max(1, 200_000 // (n + 1))):
            part = at[k : k + max(1, 200_000 // (n + 1))]
            points = np.frombuffer("".join(words[i] for i in part).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(part), n)
            yield part, np.concatenate([np.full((len(part), 1), ord(_SPACE), np.uint32), points], 1).astype(np.uint64) + np.uint64(1)


def _ends(m: np.ndarray, t: int, table: HashTable):
    """(length, piece index or -1 of each row) for the pieces that end before position t."""
    h = np.zeros(len(m), np.uint64)
    for n in range(1, min(t, table.longest) + 1):
        h = h + m[:, t - n] * table.powers[n - 1]
        yield n, table.get(h)


def word_scores(words: list[str], table: HashTable, p: np.ndarray, unknown: np.ndarray) -> np.ndarray:
    """Log-probability of each word in each language. ``p``: pieces x languages; ``unknown``: of any other character."""
    out = np.empty((len(words), p.shape[1]))
    for part, m in _by_length(words):
        n = m.shape[1]
        a = np.zeros((n + 1, len(m), p.shape[1]))
        a[0], log = 1, np.zeros(a.shape[1:])
        for t in range(1, n + 1):
            for k, ids in _ends(m, t, table):
                hit = np.flatnonzero(ids >= 0)
                if len(hit):
                    a[t][hit] += a[t - k][hit] * p[ids[hit]]
                if k == 1:
                    miss = np.flatnonzero(ids < 0)
                    a[t][miss] += a[t - 1][miss] * unknown
            if t % 8 == 0:  # long words would underflow
                window = a[max(0, t - table.longest) : t + 1]
                top = np.maximum(window.max(0), 1e-300)
                window /= top
                log += np.log(top)
        out[part] = np.log(np.maximum(a[n], 1e-300)) + log
    return out


def expected_counts(words: list[str], weights: np.ndarray, table: HashTable, p: np.ndarray, unknown: float) -> np.ndarray:
    """Expected uses of each piece over all segmentations of weighted words of one language (forward and backward)."""
    counts = np.zeros(len(p))
    for part, m in _by_length(words):
        n, w = m.shape[1], weights[part]
        ends = {t: list(_ends(m, t, table)) for t in range(1, n + 1)}
        prob = lambda ids, k: np.where(ids >= 0, p[ids], unknown if k == 1 else 0.0)
        # c[t] is the forward sum at t over that at t - 1, and b the backward sum times what that makes one, so no length underflows
        c, b = np.ones((n + 1, len(m))), np.zeros((n + 1, len(m)))
        for t in range(1, n + 1):
            total, over = np.zeros(len(m)), np.ones(len(m))
            for k, ids in ends[t]:
                total += over * prob(ids, k)
                over = over / c[t - k]
            c[t] = total
        b[n] = 1
        for t in range(n, 0, -1):
            over = b[t] / c[t]
            for k, ids in ends[t]:
                used = over * prob(ids, k)
                b[t - k] += used
                hit = ids >= 0
                np.add.at(counts, ids[hit], (w * used)[hit])
                over = over / c[t - k]
    return counts


def fit(docs: DataFrame, vocabulary_path: str | None = None, max_docs: int = MAX_DOCS_PER_LANG, rounds: int = ROUNDS) -> dict:
    """Languages and their log-free piece probabilities, from rows with a text and a lang whose fold (crc32(doc_id) mod 3) isn't 1.

    The sample is bounded (``max_docs`` a language, by hash of id and text) and taken by content, not by order; its word
    counts stay a Spark table, each round is a job over it, and only pieces x languages sums come to the driver.
    """
    path = vocabulary_path or default_vocabulary()
    pieces, _ = vocabulary(path)
    train = docs.select("doc_id", "text", "lang").filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.coalesce(fold("doc_id", 3) != 1, F.lit(False)))
    sizes = {r["lang"]: r["n"] for r in train.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(sizes)
    model = {"path": path, "langs": langs, "p": np.zeros((len(pieces), 0)), "unknown": np.zeros(0)}
    if not langs:
        return model
    share = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, max_docs / n)))])
    place = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 1).cast("double") / F.lit(2.0**63)  # of the row, in 0 to 1
    sample = train.filter(place < share[F.col("lang")]).select("lang", "text")

    def count(batches):
        for b in batches:
            seen: dict = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for w in words_of(text):
                    seen[lang, w] = seen.get((lang, w), 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], ["lang", "word", "n"])

    words = sample.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).persist()
    at = {k: i for i, k in enumerate(langs)}
    p, unknown = np.full((len(pieces), len(langs)), 1 / len(pieces)), np.full(len(langs), 1 / len(pieces))

    def step(p, unknown):
        def expect(batches):
            pieces_, table = vocabulary(path)
            sums = np.zeros((len(pieces_), len(langs)))
            for b in batches:
                by: dict[int, tuple[list, list]] = {}
                for lang, w, n in zip(*(b.column(i).to_pylist() for i in range(3))):
                    x = by.setdefault(at[lang], ([], []))
                    x[0].append(w)
                    x[1].append(n)
                for i, (ws, ns) in by.items():
                    sums[:, i] += expected_counts(ws, np.array(ns, float), table, p[:, i], unknown[i])
            k, i = np.nonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(i.astype(np.int32)), pa.array(sums[k, i])], ["piece", "lang", "n"])

        return words.mapInArrow(expect, "piece int, lang int, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas()

    for _ in range(rounds):
        got = step(p, unknown)
        sums = np.full(p.shape, SMOOTHING)
        sums[got["piece"], got["lang"]] += got["n"].round(9)
        p = sums / sums.sum(0)
        unknown = p.min(0)
    words.unpersist()
    return model | {"p": p, "unknown": unknown}


def predict(docs: DataFrame, model: dict, cache_words: int = 300_000) -> DataFrame:
    """doc_id, held_out, lang_pred, score: the likeliest language of each whole text and its share of the likelihood.

    Null texts and texts without a letter are ``und`` with score 0; so is every text where nothing could be learned. A null
    doc_id is in no fold. Ties take the language that sorts first.
    """
    langs = model["langs"]

    def run(batches):
        _, table = vocabulary(model["path"])
        index: dict[str, int] = {}
        scores = np.zeros((0, len(langs)))
        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                texts = part.column(2).to_pylist()
                words = [words_of(t) for t in texts]
                if len(index) > cache_words:
                    index, scores = {}, np.zeros((0, len(langs)))
                new = [w for w in set().union(*words) if w not in index] if langs else []
                if new:
                    index.update(zip(new, range(len(index), len(index) + len(new))))
                    scores = np.concatenate([scores, word_scores(new, table, model["p"], model["unknown"])])
                pred, score = [], []
                for t, ws in zip(texts, words):
                    if not langs or not has_letter(t, ws):
                        pred.append("und")
                        score.append(0.0)
                        continue
                    s = scores[np.fromiter(map(index.__getitem__, ws), np.int64, len(ws))].sum(0)
                    i = int(s.argmax())
                    pred.append(langs[i])
                    score.append(float(1 / np.exp(s - s[i]).sum()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold("doc_id", 3) == 1).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
