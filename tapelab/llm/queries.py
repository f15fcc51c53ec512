"""The registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tapelab.llm import bpe, collocations, fingerprints, htmltext, jaccard, langid, licenses, packing, quality, substrings, vectorcodes, warc
from tapelab.llm.common import scratch, table


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record per page, null html as an empty payload; ties of equal payloads go to the least page_id, repeats and null ids are records of their own; no pages, no rows."""
    at = scratch(spark, "warc")
    warc.write_warc(table(spark, sf_dir, "pages"), at)
    return warc.read_warc(spark, at).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document; null texts and texts without a letter are und with score 0, ties take the language that sorts first; no documents, no rows."""
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.fit(docs))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document; null and empty texts are scored by zero statistics, equal texts alike; without labels the score is a constant; no documents, no rows."""
    docs = table(spark, sf_dir, "documents")
    return quality.classify(docs, quality.classifier(docs, table(spark, sf_dir, "labels")))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document; null and empty texts fail the base rules, equal texts fare alike; no documents, no rows."""
    docs = table(spark, sf_dir, "documents")
    return quality.apply_rules(docs, quality.rules_model(docs, table(spark, sf_dir, "labels")))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every document; a null or empty text is the end id alone, repeats are packed each; no documents, no pieces."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document; a null text is empty, with no tokens; texts and words of any length are encoded whole; no documents, no rows."""
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document; null, empty and short texts lose nothing, repeats lose what they repeat; no documents, no rows."""
    return substrings.removal_digests(table(spark, sf_dir, "documents"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document; null texts are empty, rows without id come last, equal ids go by a hash of the text; no documents, no rows."""
    return fingerprints.fingerprint_edits(table(spark, sf_dir, "documents"))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document; texts without words are linked with nothing, repeats with each other; no documents, no rows."""
    return jaccard.components(table(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document; null and empty texts have no words and no labels; repeats are rows like any other; no documents, no rows."""
    return licenses.scan(table(spark, sf_dir, "documents")).drop("spans")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per vector without null and non-finite components; null labels are one label, ties of distances go to the lower entry; no vectors, no rows."""
    return vectorcodes.compress(table(spark, sf_dir, "embeddings")).drop("label")


def op12_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per page; null and empty pages have an empty text, broken markup is read as far as it goes, repeats fare alike; no pages, no rows."""
    pages = table(spark, sf_dir, "pages")
    return htmltext.extract_pages(pages, htmltext.fit(htmltext.sample_words(pages)))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's best phrases; null texts are empty, null languages are und, repeats count each; no documents, no rows."""
    return collocations.mine(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (op1_warc, op2_language_id, op3_quality_classifier, op4_quality_rules, op5_packing, op6_byte_bpe, op7_substring_dedup, op8_fingerprints, op9_ngram_jaccard, op10_license_scan, op11_vector_codes, op12_html_text, op13_collocations)
}


def _vector_codes_sql(rounds: int = vectorcodes.ROUNDS) -> str:
    """The rounds of op11 written out one after the other, with the assignment and the new entries of each."""
    assign = """
             d{r} AS (SELECT x.vec_id, x.part, c.entry, sum((x.v - c.v) * (x.v - c.v)) AS far FROM x JOIN c{r} c ON c.part = x.part AND c.pos = x.pos GROUP BY ALL),
             a{r} AS MATERIALIZED (SELECT vec_id, part, arg_min(entry, far * 256 + entry) AS entry, CAST(min(far) AS BIGINT) AS far FROM d{r} GROUP BY ALL),"""
    update = """
             s{r} AS (SELECT a.part, a.entry, x.pos, CAST(sum(x.v) AS BIGINT) AS s, count(*) AS n FROM x JOIN a{r} a ON a.vec_id = x.vec_id AND a.part = x.part GROUP BY ALL),
             c{n} AS MATERIALIZED (SELECT c.part, c.entry, c.pos, CASE WHEN s.n IS NULL THEN c.v ELSE (s.s - (s.s % s.n + s.n) % s.n) // s.n END AS v
                                   FROM c{r} c LEFT JOIN s{r} s ON s.part = c.part AND s.entry = c.entry AND s.pos = c.pos),"""
    steps = "".join(assign.format(r=r) + update.format(r=r, n=r + 1) for r in range(rounds)) + assign.format(r=rounds)
    return f"""
        WITH k AS (SELECT vec_id, label, len(embedding) // 4 AS w, embedding, row_number() OVER (ORDER BY vec_id) - 1 AS nth FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR isnan(e) OR isinf(e))) = 0),
             x AS MATERIALIZED (SELECT vec_id, nth, (i - 1) // w AS part, (i - 1) % w AS pos, CAST(floor(1024 * CAST(embedding[i] AS DOUBLE)) AS BIGINT) AS v FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM k)),
             c0 AS MATERIALIZED (SELECT part, nth AS entry, pos, v FROM x WHERE nth < 256),{steps}
             e AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(far) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id),
             h AS (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM c{rounds})
        SELECT k.vec_id, e.code, e.error, CAST(sum(e.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error, h.codebooks_sha256 FROM k JOIN e ON e.vec_id = k.vec_id CROSS JOIN h"""


ORACLES = {
    "op11_vector_codes": _vector_codes_sql(),
    "op13_collocations": r"""
        WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
             q AS (SELECT lang, row_number() OVER () AS id, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
             u AS (SELECT lang, id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM q),
             w AS MATERIALIZED (SELECT lang, word, word || ' ' || lead(word, 1) OVER o AS two, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o AS three,
                                       word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o || ' ' || lead(word, 3) OVER o AS four FROM u WINDOW o AS (PARTITION BY id ORDER BY pos)),
             n AS (SELECT lang, count(*) AS n FROM w GROUP BY lang),
             g AS (SELECT lang, 1 AS k, word AS phrase FROM w UNION ALL SELECT lang, 2, two FROM w UNION ALL SELECT lang, 3, three FROM w UNION ALL SELECT lang, 4, four FROM w),
             f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM g WHERE phrase IS NOT NULL GROUP BY ALL HAVING count(*) >= 30),
             c AS MATERIALIZED (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2),
             s AS (SELECT c.lang, c.k, c.phrase, c.a, x.cut, h.f AS l, t.f AS r, CAST((CAST(2000000 AS HUGEINT) * c.a) // (CAST(h.f AS HUGEINT) + t.f) AS BIGINT) AS score
                   FROM c, (SELECT unnest([1, 2, 3]) AS cut) x JOIN f h ON h.lang = c.lang AND h.phrase = array_to_string(c.w[1 : x.cut], ' ') JOIN f t ON t.lang = c.lang AND t.phrase = array_to_string(c.w[x.cut + 1 :], ' ') WHERE x.cut < c.k),
             b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
             i AS (SELECT lang, a, unnest([array_to_string(w[j : j + z - 1], ' ') FOR j IN generate_series(1, k - z + 1)]) AS phrase FROM c, (SELECT unnest([2, 3]) AS z) WHERE z < k),
             m AS (SELECT lang, phrase, max(a) AS longer FROM i GROUP BY ALL),
             o AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, encode(b.phrase)) AS rank
                   FROM b LEFT JOIN m ON m.lang = b.lang AND m.phrase = b.phrase WHERE longer IS NULL OR CAST(100 AS HUGEINT) * longer < CAST(80 AS HUGEINT) * a)
        SELECT o.lang, o.rank, o.phrase, o.a, o.l, o.r, n.n, o.score FROM o JOIN n ON n.lang = o.lang WHERE o.rank <= 2000""",
    "op1_warc": """
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
             f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest,
               CASE WHEN first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN first_id <> page_id THEN first_id END AS refers_to
        FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest""",
    "op7_substring_dedup": r"""
        WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
             win AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 34], ' ')) AS h FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 34)) AS i FROM d WHERE len(w) >= 35)),
             dup AS (SELECT doc_id, i FROM win WHERE h IN (SELECT h FROM win GROUP BY h HAVING count(*) > 1)),
             gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 34)) AS j FROM dup),
             lost AS (SELECT doc_id, list(j) AS js, count(*) AS n FROM gone GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
               sha256(array_to_string(CASE WHEN n IS NULL THEN w ELSE [w[k] FOR k IN generate_series(1, len(w)) IF NOT list_contains(js, k)] END, ' ')) AS kept_sha256
        FROM d LEFT JOIN lost ON d.doc_id = lost.doc_id""",
    "op9_ngram_jaccard": r"""
        WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
             s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN [array_to_string(w[i : i + 4], ' ') FOR i IN generate_series(1, len(w) - 4)] WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS h FROM d),
             n AS (SELECT d.doc_id, count(h) AS n FROM d LEFT JOIN s ON d.doc_id = s.doc_id GROUP BY d.doc_id),
             c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
             l AS MATERIALIZED (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
             r AS (SELECT doc_id, doc_id AS root FROM d UNION SELECT l.y, r.root FROM r JOIN l ON l.x = r.doc_id)
        SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, min(r.root) AS component_id FROM n JOIN r ON r.doc_id = n.doc_id GROUP BY n.doc_id, n.n""",
}
