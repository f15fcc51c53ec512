"""Every corpus operator on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names."""

import hashlib

import pytest

from tapelab.llm import bpe, fingerprints, jaccard, langid, licenses, packing, quality, substrings, warc
from tapelab.llm.common import scratch

LONG = " ".join(f"word{i % 977} and{i % 31}" for i in range(60_000))
TEXT = " ".join(f"alpha{i}" for i in range(60))
ROWS = [(1, None, "en"), (2, "", "en"), (3, "  \n\t ", None), (4, LONG, "de"), (5, TEXT, "en"), (5, TEXT, "en"), (6, TEXT, "fr"), (None, TEXT + " more", "en"), (7, "short text", "de"), (8, "0123 !!", "en"), (9, "é" * 5000, "fr")]
SCHEMA = "doc_id long, text string, lang string"


@pytest.fixture(scope="module")
def docs(spark):
    # columns that operators use inside must not clash
    d = spark.createDataFrame(ROWS, SCHEMA)
    return d.selectExpr("doc_id", "text", "lang", "'src' as source", "cast(length(text) as long) as n_chars", "1 as key", "2 as row", "3 as member", "4 as bucket", "5 as words").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def labels(spark, rows=((1, 0, 0), (4, 1, 0), (5, None, 0), (7, 0, 0))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def count(df):
    return len(df.collect())


def test_warc(spark, tmp_path):
    pages = spark.createDataFrame([(3, "u", "x" * 200, 0), (1, "u\r\nbad: x", "x" * 200, 0), (1, None, "x" * 200, 0), (None, "u", "x" * 200, 0), (2, "u", None, 0), (4, "u", "", 0), (5, "u", "short", 0), (6, "u", "short", 0), (7, "u", "y" * 20_000_000, 0)], "page_id long, url string, html string, digest int")
    at = scratch(spark, "warc")
    warc.write_warc(pages, at)
    got = {(r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.read_warc(spark, at).collect()}
    assert got == {(3, 200, "revisit", 1), (1, 200, "response", None), (None, 200, "revisit", 1), (2, 0, "response", None), (4, 0, "response", None), (5, 5, "response", None), (6, 5, "response", None), (7, 20_000_000, "response", None)}
    body = {r["page_id"]: r["payload"] for r in warc.read_warc(spark, at, with_payload=True).collect()}
    assert hashlib.sha256(body[7]).digest() == hashlib.sha256(b"y" * 20_000_000).digest()
    # each archive is gzip members, one a page and one that is empty; small archives hold the same pages
    import gzip
    from pathlib import Path

    small = scratch(spark, "warc")
    warc.write_warc(pages, small, archive_bytes=300)
    assert {(r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.read_warc(spark, small).collect()} == got
    for folder in (at, small):
        files = [f.read_bytes() for f in Path(folder).glob("part-*")]
        assert sum(gzip.decompress(f).count(b"WARC/1.1\r\n") for f in files) == 9 and all(f.endswith(warc.END_MARK) for f in files if f)
    none = scratch(spark, "warc")
    warc.write_warc(pages.limit(0), none)
    assert count(warc.read_warc(spark, none)) == 0


def test_warc_members_are_gzip_and_damage_is_found():
    import gzip

    m = warc.record(1, "http://a", b"body", hashlib.sha256(b"body").hexdigest(), 4, None, False, "2020-01-01T00:00:00Z")
    assert gzip.decompress(m).startswith(b"WARC/1.1\r\n") and gzip.decompress(warc.END_MARK) == b""
    assert len(list(warc.records(m + m + warc.END_MARK))) == 2
    with pytest.raises(ValueError):
        list(warc.records(m[:-20]))
    bad = gzip.compress(gzip.decompress(m).replace(b"body", b"bOdy"))
    with pytest.raises(ValueError):
        list(warc.records(bad))


def test_language_id(docs, empty):
    model = langid.fit(docs)
    got = {r["doc_id"]: r for r in langid.predict(docs, model).collect()}
    assert all(got[k]["lang_pred"] == "und" and got[k]["score"] == 0 for k in (1, 2, 3, 8))
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[None]["held_out"] is None
    assert count(langid.predict(empty, langid.fit(empty))) == 0
    assert {r["lang_pred"] for r in langid.predict(docs, langid.fit(empty)).collect()} == {"und"}


def test_quality(spark, docs, empty):
    for lab in (labels(spark), labels(spark).limit(0)):
        got = quality.classify(docs, quality.classifier(docs, lab)).collect()
        assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
        rules = quality.apply_rules(docs, quality.rules_model(docs, lab)).collect()
        assert all(r["base_failed"] and not r["kept"] for r in rules if r["n_words"] < 50)
    assert count(quality.classify(empty, quality.classifier(empty, labels(spark)))) == 0


def test_packing(docs, empty):
    check_packing(docs)
    assert count(packing.pack(empty)) == 0


def check_packing(docs):
    got = packing.pack(docs, with_ids=True).collect()
    seqs, by_doc = {}, {}
    for r in got:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by_doc.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
    for pieces in seqs.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at == 2048 or at & (at - 1) == 0
    for (_, total), pieces in by_doc.items():
        assert sum(p["length"] for p in pieces) % total == 0


def test_bpe(docs, empty):
    got = {r["doc_id"]: r for r in bpe.round_trip_digests(docs).collect()}
    texts = dict((a, b) for a, b, _ in ROWS)
    assert all(r["decoded_sha256"] == hashlib.sha256((texts[k] or "").encode()).hexdigest() for k, r in got.items())
    assert got[1]["n_tokens"] == 0
    back = {r["doc_id"]: r["text"].decode() for r in bpe.decode(bpe.encode(docs)).collect()}
    assert back == {k: v or "" for k, v in texts.items()}
    assert count(bpe.round_trip_digests(empty)) == 0


def test_substrings(docs, empty):
    got = {(r["doc_id"], r["n_words"], r["n_removed"]) for r in substrings.removal_digests(docs).collect()}
    assert {(1, 0, 0), (2, 0, 0), (3, 0, 0), (5, 60, 60), (6, 60, 60), (None, 61, 60), (7, 2, 0)} <= got
    assert substrings.remove_repeats(docs).columns == docs.columns
    kept = {r["doc_id"]: r["text"] for r in substrings.remove_repeats(docs).collect()}
    assert kept[1] is None and kept[3] == "  \n\t " and kept[None] == "more" and kept[5] == ""
    assert count(substrings.removal_digests(empty)) == 0


def test_fingerprints(docs, empty):
    got = fingerprints.fingerprint_edits(docs).collect()
    assert len(got) == len(ROWS) and all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    prints = {}
    for r in got:
        prints.setdefault(r["fingerprint"], set()).add(r["doc_id"])
    assert {5, 6} in prints.values() and {1, 2} in prints.values()
    assert count(fingerprints.fingerprint_edits(empty)) == 0


def test_edited_texts(spark):
    texts = {i: "".join(chr(97 + (i * 7 + j) % 26) for j in range(i * 3 % 11)) for i in range(25)}
    d = spark.createDataFrame([(i * 1000 - 5000, t) for i, t in texts.items()], "doc_id long, text string").repartition(5)
    ids = sorted((i * 1000 - 5000 for i in texts), reverse=True)
    by = {i * 1000 - 5000: t for i, t in texts.items()}
    want = {}
    for n, i in enumerate(ids):
        t, nxt = by[i], by[ids[(n + 1) % len(ids)]]
        h = len(t) // 2
        want[i] = hashlib.sha256((t[: len(t) - h] + nxt[:h]).encode()).hexdigest()
    old = fingerprints.with_next.__defaults__
    try:
        for per in (1000, 3, 1):
            fingerprints.with_next.__defaults__ = (per,)
            assert {r["doc_id"]: r["edited_sha256"] for r in fingerprints.fingerprint_edits(d).collect()} == want
    finally:
        fingerprints.with_next.__defaults__ = old


def test_jaccard(docs, empty):
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.components(docs).collect()), key=str)
    by = {(a, n): c for a, n, c in got}
    assert by[5, 56] == 5 and by[6, 56] == 5 and by[None, 57] == 5 and by[1, 0] == 1 and by[2, 0] == 2 and by[7, 1] == 7
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3, 4, 5, 7, 8, 9]
    assert count(jaccard.components(empty)) == 0


def test_licenses(spark, docs, empty):
    extra = [(20, "x Released under the MIT License. y MIT licence, mit license", "en"), (21, "Licensed under CC BY-NC 4.0.", "en"), (22, "GNU General Public License and Apache license", "en"), (23, "commit license", "en")]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(extra, SCHEMA)).collect()}
    assert (got[20]["n_base"], got[20]["first_word"], got[20]["last_word"], got[20]["base_labels"]) == (2, 4, 9, "mit")
    assert (got[21]["n_base"], got[21]["first_word"], got[21]["labels"], got[21]["score"]) == (0, None, "cc-by-nc", 1.0)
    assert (got[22]["base_labels"], got[22]["n_base"], got[23]["n_base"]) == ("apache,gpl", 2, 0)
    assert count(licenses.scan(docs)) == len(ROWS) and count(licenses.scan(empty)) == 0
    own = licenses.scan(spark.createDataFrame([(1, "see the ISC terms here", "en"), (2, "isc license terms", "en"), (3, "the one, the one; x", "en")], SCHEMA), phrases=(("isc terms", "isc"), ("the one", "one"), ("x", "x"))).collect()
    assert {r["doc_id"]: (r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in own} == {1: (1, 2, 2, "isc"), 2: (0, None, None, ""), 3: (3, 0, 4, "one,x")}


@pytest.mark.parametrize("per", [1000, 7, 1])
def test_edited_texts_of_null_and_repeated_ids(spark, per):
    """Hot ids and rows without id are dealt to several ranges, and every row still meets the one that follows it."""
    rows = [(None, f"no id {n} " * 3) for n in range(40)] + [(5, f"five {n} " * 4) for n in range(60)] + [(n * 3, f"text {n} of {n * 7}") for n in range(-20, 60)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    hashes = {tuple(r): r.h for r in d.selectExpr("doc_id", "text", "xxhash64(text) as h").collect()}
    texts = {(r["doc_id"], r["text"]): hashes[r["doc_id"], r["text"], r["h"]] for r in d.selectExpr("doc_id", "text", "xxhash64(text) as h").collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), texts[r]))
    got = {(r["doc_id"], r["text"]): r["next"]["text"] for r in fingerprints.with_next(d, "doc_id", ["text"], per).collect()}
    assert got == {r: order[(n + 1) % len(order)][1] for n, r in enumerate(order)}
