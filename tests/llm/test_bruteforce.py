"""Corpus operators against brute force, the public libraries, or held-out labels, on whole small tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from tapelab.llm import bpe, fingerprints, jaccard, packing, queries
from tapelab.llm.common import stored

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs():
    return duckdb.sql(f"SELECT doc_id, text, lang FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    r = c.execute(queries.ORACLES[name])
    names = [x[0] for x in r.description]
    at = [names.index(x) for x in cols]
    assert sorted(map(str, (tuple(x[i] for i in at) for x in r.fetchall()))) == sorted(map(str, map(tuple, df.select(cols).collect())))


def test_language_held_out(spark, docs):
    got, lang = by_id(queries.op2_language_id(spark, SF)), {i: x for i, _, x in docs}
    held = [i for i in lang if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i]["held_out"] == (i in set(held)) for i in lang)
    assert sum(got[i]["lang_pred"] == lang[i] for i in held) >= 0.97 * len(held)


def test_quality_held_out(spark):
    got = by_id(queries.op3_quality_classifier(spark, "/root/testdata/sf0.01"))
    rows = duckdb.sql("SELECT doc_id, quality FROM '/root/testdata/sf0.01/labels.parquet'").fetchall()
    held = [(i, q) for i, q in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(got[i]["predicted"] == q for i, q in held) >= 0.95 * len(held)


def test_rules_base_counts(spark, docs):
    got = by_id(queries.op4_quality_rules(spark, SF))
    for i, text, _ in docs:
        w = words(text)
        grams = Counter(zip(w, w[1:], w[2:]))
        hit = {j + k for j in range(len(w) - 2) if grams[tuple(w[j : j + 3])] > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if words(x)]
        dup = sum(x in lines[:n] for n, x in enumerate(lines))
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(hit) > 50 * len(w)) and not (r["kept"] and r["base_failed"])


def test_rules_keep_good_documents(spark):
    got = by_id(queries.op4_quality_rules(spark, "/root/testdata/sf0.01"))
    good = [i for (i,) in duckdb.sql("SELECT doc_id FROM '/root/testdata/sf0.01/labels.parquet' WHERE quality = 1").fetchall() if not got[i]["base_failed"]]
    assert sum(got[i]["kept"] for i in good) >= 0.99 * len(good)


def test_packing_ids(spark, docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    ids = {i: [*tok.encode(t, add_special_tokens=False).ids, 1] for i, t, _ in docs}
    pieces, at, room = defaultdict(list), defaultdict(list), 0
    for r in queries.op5_packing(spark, SF).collect():
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part)) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        at[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, own in pieces.items():
        assert sum(n for _, n in own) == len(ids[i]) and all(a + n == b for (a, n), (b, _) in zip(sorted(own), sorted(own)[1:]))
    assert set(pieces) == set(ids)
    for own in at.values():
        n = sum(x for _, x in own)
        assert n <= 2048 and sorted(own)[0][0] == 0 and all(a + x == b for (a, x), (b, _) in zip(sorted(own), sorted(own)[1:]))
        room += 0 if n & (n - 1) == 0 else 2048 - n
    assert room == 0


def test_packing_ids_of_marks(spark):
    """Marks within and between words, against the library as it comes from its file."""
    from tokenizers import Tokenizer

    tok, end, start = Tokenizer.from_file(packing.default_tokenizer()), "<|endoftext|>", "<|startoftext|>"
    texts = [f"one {end} two", f"one{end}two", f"{start}{end}", f"({end}).", f"{start} Über,{end}\n{end} x.", f"ONE {end.upper()} Two", "one <|endoftext| > two", f" {end}{end} ", "plain words, no mark"]
    want = {i: [*tok.encode(t, add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    assert want[0] == [637, 49407, 1237, 1]
    got = defaultdict(dict)
    for r in packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), with_ids=True).collect():
        got[r["doc_id"]] |= dict(enumerate(r["ids"], r["start"]))
        assert r["doc_tokens"] == len(want[r["doc_id"]])
    assert {i: [x for _, x in sorted(own.items())] for i, own in got.items()} == want


def test_packing_ids_of_letters_that_come_apart():
    """Every letter of the first plane, bare and before each punctuation mark, against the library."""
    from tokenizers import Tokenizer

    tok, own = Tokenizer.from_file(packing.default_tokenizer()), packing.WordTokens(packing.default_tokenizer())
    letters = [chr(c) for c in range(0x10000) if chr(c).isalpha() and not 0xAC00 <= c < 0xD7A4 and not 0x3400 <= c < 0xA000]  # not all Hangul syllables and ideographs: all alike
    odd = ["\u0130", "\u0958", "\u095d", "\u09dc", "\u0a36", "\u0f57", "\ufb30", "\ufb4e"]
    texts = [x + m for x in letters for m in ("", ",")] + [f"ab{x}c{m} {x}{m}{x}" for x in odd + ["ß", "é", "Σ"] for m in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"]
    got = own.batch(texts)
    assert [list(g) for g in got] == [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]


def test_packing_looks_at_a_word_once_however_often_it_stands():
    """Columns with nulls, every kind of blank, empty and odd words, in slices and with caches that overflow, against the library; repeats are no work word by word."""
    import random

    import pyarrow as pa
    from tokenizers import Tokenizer

    tok, own = Tokenizer.from_file(packing.default_tokenizer()), packing.WordTokens(packing.default_tokenizer(), cache_words=50)
    rng = random.Random(5)
    odd = ["Über,", "ΣΑΣ.", "İx", "###", "a" * 300 + "!", "é" * 150 + "?", "x1", "don't", "12.5%", "中文。", "\x1cab", "\u00a0", "😀!", "<|endoftext|>", "..", "ab" + "-" * 70, "\x00"]
    word = lambda: rng.choice(odd) if rng.random() < 0.2 else "".join(rng.choices("abcdeÀéñß", k=rng.randint(1, 4))) + rng.choice(["", "", ".", ",!"])
    texts = [None, "", " ", "\n\t a\x0bb\x0cc\r ", *("".join(word() + rng.choice(" \t\n\r\x0b\x0c") * rng.randint(1, 2) for _ in range(rng.randint(0, 60))) for _ in range(200))]
    want = [e.ids for e in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    col = pa.array(["before", *texts, "behind"], pa.string())
    for step in (7, 300):
        assert [list(g) for k in range(0, len(texts), step) for g in own.column(col.slice(1 + k, min(step, len(texts) - k)))] == want
    assert [list(g) for g in own.column(col.cast(pa.large_string()).slice(1, len(texts)))] == want
    asked, of = [], own.runs.of
    own.runs.of = lambda words: asked.extend(words) or of(words)
    assert len(own.column(pa.array(["one two, One "] * 1000))) == 1000 and len(asked) < 10


def test_best_subset_is_best():
    import itertools
    import random

    rng = random.Random(3)
    for _ in range(200):
        items = [rng.randint(1, 30) for _ in range(rng.randint(1, 9))]
        room = rng.randint(1, 60)
        take = packing.best_subset(dict(Counter(items)), room)
        best = max(s for k in range(len(items) + 1) for c in itertools.combinations(items, k) if (s := sum(c)) <= room)
        assert sum(a * b for a, b in take.items()) == best and all(b <= Counter(items)[a] for a, b in take.items())


def test_bpe_equals_tiktoken(spark, docs):
    import random

    import tiktoken

    path, pattern = bpe.defaults()
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.ranks(path, pattern).rank, special_tokens={})
    got = by_id(queries.op6_byte_bpe(spark, SF))
    for i, text, _ in docs:
        ids = enc.encode_ordinary(text)
        assert (got[i]["n_tokens"], got[i]["ids_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
    rng, e = random.Random(5), bpe.Encoder(path, pattern, cache_chunks=2000)
    odd = ["".join(rng.choice("ab '\n\t 1é.ſ\x1c　日🙂s") for _ in range(rng.randint(0, 50))) for _ in range(2000)] + ["a" * 1000, "abc" * 400, "ab" * 300 + "c" * 301, "日本" * 200]
    odd += ["".join(rng.choice("ab \n") for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    odd += ["".join(rng.choice(["the ", "ing", "a", "th", "\n", "sh", "  "]) for _ in range(rng.randint(0, 12))) for _ in range(1000)]
    odd += ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz"[:k]) for _ in range(n)) for k in (1, 2, 5, 26) for n in (*range(bpe.LONG - 12, bpe.LONG + 12), 2000)]
    rng.shuffle(odd)
    for k in range(0, len(odd), 256):
        for text, ids in zip(odd[k : k + 256], e.batch(odd[k : k + 256])):
            assert np.frombuffer(ids, "<i4").tolist() == enc.encode_ordinary(text), repr(text)


def shingles(text):
    w = words((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def test_sketch_estimates_likeness(spark, docs):
    got, sets = by_id(queries.op8_fingerprints(spark, SF)), {}
    assert len({t for _, t, _ in docs}) == len({r["fingerprint"] for r in got.values()})
    order = sorted(docs, key=lambda d: -d[0])
    error = []
    for n, (i, text, _) in enumerate(order):
        nxt, h = order[(n + 1) % len(order)][1], len(text) // 2
        edited = text[: len(text) - h] + nxt[:h]
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and got[i]["n_chars"] == len(text)
        a, b = (frozenset(tuple(words(x)[j : j + 5]) for j in range(len(words(x)) - 4)) for x in (text, edited))
        if len(a | b) > 400:
            error.append(abs(got[i]["near_edited"] - len(a & b) / len(a | b)))
    assert sum(error) / len(error) < 0.05


def brute_components(texts):
    """For each text the first one that links reach, by comparing all pairs."""
    sets, up = [shingles(t) for t in texts], list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 0.8 * len(a) <= len(b) <= 1.25 * len(a) and 100 * len(a & b) >= 80 * len(a | b):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(texts))]


@pytest.mark.parametrize("most, block", [(64, 512), (2, 8), (5, 30)])
def test_jaccard_components(spark, docs, most, block):
    import random

    rng = random.Random(1)
    base = words(docs[3][1])[:90]
    extra = []
    for n in range(120):  # a family with links of links
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = f"edit{rng.randint(0, 9)}"
        extra.append((100_000 + n, " ".join(w), "en"))
    rows = [*docs, *extra]
    got = by_id(jaccard.components(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4), most=most, block=block))
    root = brute_components([t for _, t, _ in rows])
    sets = [shingles(t) for _, t, _ in rows]
    assert all(got[r[0]]["component_id"] == rows[root[i]][0] and got[r[0]]["n_shingles"] == len(sets[i]) for i, r in enumerate(rows))


def test_containment_of_unequal_documents(spark):
    text = " ".join(f"w{i}" for i in range(4000))
    d = spark.createDataFrame([(text, " ".join(f"w{i}" for i in range(500)))], "a string, b string").select(fingerprints.sketch(fingerprints.F.col("a")).alias("a"), fingerprints.sketch(fingerprints.F.col("b")).alias("b"))
    r = d.select(fingerprints.containment(d["b"], d["a"]).alias("x"), fingerprints.merge(d["a"], d["b"]).alias("m"), "a").first()
    assert r["x"] == 1.0 and r["m"] == r["a"]


def cased_shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(len(w), 1)))}


def test_likeness_of_texts_of_every_length(spark, docs):
    """With all hashes kept, likeness is exact: no pair is left out, and one middle word changed in texts of 1 to 60 words."""
    texts = [t for _, t, _ in docs] + [" ".join(f"w{n}x{i}" for i in range(n)) for n in range(1, 61)]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = by_id(fingerprints.fingerprint_edits(d, scale=1))
    for i, text in enumerate(texts):
        nxt, h = texts[i - 1], len(text) // 2
        a, b, c = (cased_shingles(x) for x in (text, text[: len(text) - h] + nxt[:h], nxt))
        assert got[i]["near_edited"] == pytest.approx(len(a & b) / len(a | b)) and got[i]["near_next"] == pytest.approx(len(a & c) / len(a | c)) and got[i]["edited_holds"] == pytest.approx(len(a & b) / len(a))
    pairs = [(t, " ".join("other" if k == len(t.split()) // 2 else x for k, x in enumerate(t.split()))) for t in texts[-60:]]
    both = spark.createDataFrame(pairs, "a string, b string").select("a", "b", fingerprints.likeness(fingerprints.sketch(fingerprints.F.col("a"), scale=1), fingerprints.sketch(fingerprints.F.col("b"), scale=1), fingerprints.F.lit(False)).alias("x"))
    for r in both.collect():
        a, b = cased_shingles(r["a"]), cased_shingles(r["b"])
        assert r["x"] == pytest.approx(len(a & b) / len(a | b))


def test_threshold_keeps_half_and_bounds_the_error(spark, docs):
    """Of texts of every length: the error of a likeness, how many hashes are kept, and the size of fingerprints."""
    texts = [t for _, t, _ in docs] + [" ".join(f"w{n}x{i}" for i in range(n)) for n in range(1, 61)]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = by_id(fingerprints.fingerprint_edits(d))
    errors = []
    for i, text in enumerate(texts):
        h = len(text) // 2
        a, b = cased_shingles(text), cased_shingles(text[: len(text) - h] + texts[i - 1][:h])
        m, true = len(a | b), len(a & b) / len(a | b)
        errors.append((m, abs(got[i]["near_edited"] - true)))
        assert errors[-1][1] <= min(1, 4.5 * (2 * true * (1 - true) / m) ** 0.5 + 4 / m)
    assert max(e for m, e in errors if m > 1000) < 0.05 and sum(e for m, e in errors if m > 100) < 0.03 * sum(m > 100 for m, _ in errors)
    all_shingles = sum(len(cased_shingles(t)) for t in texts)
    kept = d.select(fingerprints.sketch(fingerprints.F.col("text")).alias("s")).agg(fingerprints.F.sum(fingerprints.F.size("s"))).first()[0]
    assert 0.48 * all_shingles < kept < 0.52 * all_shingles
    assert sum(len(r["fingerprint"]) for r in got.values()) < sum(map(len, texts))


def test_pipeline_stages(spark, docs):
    """Each stage on what the one before kept, against plain Python; with planted copies, near copies, passages and junk."""
    from tokenizers import Tokenizer

    from tapelab.llm import quality, textstats

    good = [t for i, t, _ in docs if len(words(t)) > 150][:30]
    extra = [good[0], good[1] + " end", " ".join(words(good[2])[:60] + words(good[3])), "buy now! " * 90, "", None, "word " * 10]
    d = spark.read.parquet(f"{SF}/documents.parquet")
    more = spark.createDataFrame([(900_000 + n, t, "en", "planted", len(t or "")) for n, t in enumerate(extra)], d.schema)
    d = stored(d.unionByName(more), "planted")
    columns, rows = d.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = sorted((r["doc_id"], r["text"]) for r in d.select("doc_id", "text").collect() if r["text"] is not None)
        source, d = d, stored(stage(spark, d, SF), "stage")
        if name == "packing":
            break
        assert d.columns == columns
        after = {r["doc_id"]: r["text"] for r in d.collect()}
        rows[name] = len(after)
        if name.startswith("quality"):
            model = (quality.rules_model if "rules" in name else quality.classifier)(source, spark.read.parquet(f"{SF}/labels.parquet"))
            verdict = quality.passes_rules if "rules" in name else quality.passes_classifier
            both = [textstats.statistics(t) for _, t in before]
            keep = verdict(np.array([x[0] for x in both]), np.array([x[1] for x in both]), model)
            assert after == {i: t for (i, t), ok in zip(before, keep) if ok}
        elif name == "n-gram Jaccard join":
            root = brute_components([t for _, t in before])
            assert after == {i: t for n, (i, t) in enumerate(before) if root[n] == n}
        else:
            assert after == {i: kept if gone else t for (i, t), (_, gone, kept) in zip(before, removed_by_windows(before))}
            assert rows["n-gram Jaccard join"] == len(after) and after != dict(before)
    assert rows["quality rules"] >= rows["quality classifier"] > rows["n-gram Jaccard join"] > 50
    tok, got = Tokenizer.from_file(packing.default_tokenizer()), defaultdict(list)
    for r in d.collect():
        got[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"]))
    assert set(got) == {i for i, _ in before}
    for i, text in before:
        ids = [*tok.encode(text, add_special_tokens=False).ids, 1]
        assert [(a, n, zlib.crc32(np.array(ids[a : a + n], "<u4").tobytes())) for a, n, _ in sorted(got[i])] == sorted(got[i]) and sum(n for _, n, _ in got[i]) == len(ids)


def test_pipeline_of_empty_tables(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        d = stored(stage(spark, d, SF), "stage")
        assert d.count() == 0


def test_license_base_columns_and_spans(spark, docs):
    """Base columns by a plain scan of every text, and planted notices: whole, with words put in, of two licenses that share most words."""
    import random

    from tapelab.llm import licenses

    rng = random.Random(9)
    parts = ["MIT", "mit", "license", "License", "apache", "general", "public", "x", "é", "İ", "-", "\n", "GNU"]
    odd = [(200_000 + n, " ".join(rng.choice(parts) for _ in range(rng.randint(0, 14))), None) for n in range(300)]
    body = dict(enumerate(b for _, b in licenses.TEMPLATES))
    label = dict(enumerate(x for x, _ in licenses.TEMPLATES))
    whole = [(300_000 + n, f"Some words before it. {b} And more behind, {n}.", None) for n, b in body.items()]
    longer = [(400_000 + n, "front " + " ".join(b.split()[: len(b.split()) // 2] + ["two", "more"] + b.split()[len(b.split()) // 2 :]), None) for n, b in body.items() if len(b.split()) > 20]
    got = by_id(licenses.scan(spark.createDataFrame([*docs, *odd, *whole, *longer], "doc_id long, text string, lang string").repartition(5)))
    for i, text, _ in [*docs, *odd]:
        w = [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER)) if x]
        at = [(n, name) for phrase, name in licenses.PHRASES for n in range(len(w)) if w[n : n + len(phrase.split())] == phrase.split()]
        r = got[i]
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(w), len(at), ",".join(sorted({x for _, x in at})))
        assert (r["first_word"], r["last_word"]) == ((min(at)[0], max(at)[0]) if at else (None, None))
        assert set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    for n in body:
        assert label[n] in got[300_000 + n]["labels"].split(","), body[n]
        assert {x["label"] for x in got[300_000 + n]["spans"]} == {label[n]}, body[n]
    for i, _, _ in longer:
        assert label[i - 400_000] in got[i]["labels"].split(",")


def segmentations(word, longest):
    if not word:
        yield []
    for k in range(1, min(longest, len(word)) + 1):
        for rest in segmentations(word[k:], longest):
            yield [word[:k], *rest]


def test_forward_sums_equal_enumerated_segmentations():
    """Scores and expected counts against sums over all ways to cut a word, unknown characters and long words included."""
    import math
    import random

    from tapelab.llm import langid

    rng = random.Random(4)
    pieces = tuple(sorted({"▁", "a", "b", "ab", "ba", "▁a", "▁ab", "aab", "bab", "abab", "▁bb"}))
    table, p = langid.table_of(pieces), np.array([[rng.random() / 9, rng.random() / 9] for _ in pieces])
    unknown = np.array([0.003, 0.001])
    words_ = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    got = langid.word_scores(words_, table, p, unknown)
    counts = [langid.expected_counts([w], np.ones(1), table, p[:, 0], unknown[0]) for w in words_]
    at = {x: i for i, x in enumerate(pieces)}
    for w, score, count in zip(words_, got, counts):
        total, used = np.zeros(2), np.zeros(len(pieces))
        for cut in segmentations("▁" + w, table.longest):
            prob = np.ones(2)
            for x in cut:
                prob = prob * (p[at[x]] if x in at else unknown if len(x) == 1 else 0.0)
            total += prob
            for x in cut:
                if x in at:
                    used[at[x]] += prob[0]
        assert score == pytest.approx(np.log(total)) and count == pytest.approx(used / total[0])
    # a word too long for plain products: as many pieces' characters as it has
    long = langid.expected_counts(["ab" * 3000], np.ones(1), table, p[:, 0], unknown[0])
    assert sum(n * len(x) for n, x in zip(long, pieces)) == pytest.approx(6001) and math.isfinite(langid.word_scores(["ab" * 3000], table, p, unknown)[0, 0])


def test_trees_are_walked_and_monotone():
    """Flattened traversal against a walk node by node; a monotone feature never raises a score, whatever the others are."""
    import random

    from tapelab.llm import gbdt

    rng = np.random.default_rng(6)
    x = rng.normal(size=(1500, 4)).round(2)
    y = ((x[:, 0] - x[:, 1] + rng.normal(size=1500) / 2 + np.sin(3 * x[:, 2])) > 0).astype(int)
    for monotone in (None, {1: -1, 0: 1}):
        model = gbdt.fit(x, y, monotone, trees=20, depth=4)
        got = model.predict(x[:200])
        for row, score in zip(x[:200], got):
            total = model.base
            for at in model.roots:
                while model.feature[at] >= 0:
                    at = model.right[at] if row[model.feature[at]] > model.threshold[at] else model.left[at]
                total += model.value[at]
            assert score == pytest.approx(1 / (1 + np.exp(-total)))
    r = random.Random(2)
    for _ in range(200):
        row = x[r.randrange(len(x))].copy()
        rows = np.repeat(row[None], 40, 0)
        rows[:, 1] = np.linspace(-4, 4, 40)
        assert (np.diff(model.predict(rows)) <= 1e-12).all()
        rows = np.repeat(row[None], 40, 0)
        rows[:, 0] = np.linspace(-4, 4, 40)
        assert (np.diff(model.predict(rows)) >= -1e-12).all()


def test_kept_is_the_verdict_of_the_rules(spark, docs):
    """The verdict, and the pipeline's two filters, against base counts and the models' scores of each text."""
    from tapelab.llm import gbdt, quality, textstats

    d = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rules, model = quality.rules_model(d, labels), quality.classifier(d, labels)
    assert isinstance(rules, gbdt.Trees)
    got = by_id(quality.apply_rules(d, rules))
    stats = {i: textstats.statistics(t) for i, t, _ in docs}
    fine = lambda i: stats[i][0][0] >= 50 and 100 * stats[i][0][4] <= 50 * stats[i][0][0]
    score = lambda m, i: float(m.predict(np.array([stats[i][1]]))[0])
    passed = {i for i in stats if fine(i) and score(rules, i) >= quality.REJECT_BELOW}
    assert {i for i, r in got.items() if r["kept"]} == passed
    assert {r["doc_id"] for r in quality.filter_rows(d, rules, quality.passes_rules).collect()} == passed
    assert {r["doc_id"] for r in quality.filter_rows(d, model, quality.passes_classifier).collect()} == {i for i in stats if score(model, i) >= quality.THRESHOLD}


def removed_by_windows(rows, size=35):
    """For each row, which words lie in a window that starts anywhere else too."""
    seen = Counter()
    for _, text in rows:
        w = words(text)
        seen.update(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
    out = []
    for _, text in rows:
        w = words(text)
        gone = {i + k for i in range(len(w) - size + 1) if seen[tuple(w[i : i + size])] > 1 for k in range(size)}
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def test_substrings_of_periodic_and_planted_texts(spark):
    """Few different words, so that windows overlap, repeat within a text and meet by halves; planted passages; and the stage's texts."""
    import random

    from tapelab.llm import substrings

    rng = random.Random(8)
    shared = [" ".join(f"p{k}w{rng.randint(0, 30)}" for _ in range(rng.randint(34, 70))) for k in range(6)]
    rows = []
    for n in range(160):
        kind = n % 4
        if kind == 0:
            t = " ".join(rng.choice("ab") for _ in range(rng.randint(0, 200)))
        elif kind == 1:
            unit = [rng.choice("abc") for _ in range(rng.randint(1, 9))]
            t = " ".join((unit * 60)[: rng.randint(30, 150)])
        elif kind == 2:
            t = " ".join([f"u{n}x{i}" for i in range(rng.randint(0, 60))] + [rng.choice(shared)] + [f"v{n}x{i}" for i in range(rng.randint(0, 60))])
        else:
            t = "\n".join(f"w{rng.randint(0, 10_000)}" for _ in range(rng.randint(0, 120)))
        rows.append((n, t))
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got, texts = by_id(substrings.removal_digests(d)), by_id(substrings.remove_repeats(d))
    for (i, text), (n, gone, kept) in zip(rows, removed_by_windows(rows)):
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept_sha256"]) == (n, gone, hashlib.sha256(kept.encode()).hexdigest())
        assert texts[i]["text"] == (kept if gone else text)
