"""Jobs over tables of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def vocabulary(docs: DataFrame) -> DataFrame:
    """word, n, docs: lower-case ASCII words, their uses and the texts that hold them; counted per text first."""
    w = docs.select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), 1)).alias("word"))
    return w.groupBy("word", "doc_id").agg(F.count(F.lit(1)).alias("c")).groupBy("word").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("docs"))


def discover_people(docs: DataFrame) -> DataFrame:
    """person, n: lines of two to four capitalised words that recur, or whose next line has a comma."""
    lines = docs.select(F.split("text", "\n").alias("lines")).select(F.posexplode(F.transform("lines", lambda x, i: F.struct(x.alias("line"), F.get("lines", i + 1).alias("following")))).alias("i", "x"))
    hits = lines.select("x.*").filter(F.col("line").rlike(r"^[A-Z][a-z]+( [A-Z][a-z]+){1,3}\.?$"))
    g = hits.groupBy(F.col("line").alias("person")).agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.coalesce(F.col("following"), F.lit("")).contains(",")).alias("title"))
    return g.filter("n >= 2 or title").drop("title")


#: How a fiscal quarter is written in a head, which two groups are (quarter, year), and what makes a mention forward-looking.
QUARTER_PATTERNS = (
    (r"\b(first|second|third|fourth)\s+quarter\s+(?:and\s+(?:full\s+)?(?:fiscal\s+)?(?:year\s+)?)?(?:of\s+)?(?:fiscal\s+(?:year\s+)?)?(?:fy\s*)?'?(20\d\d|\d\d)\b", 1, 2),
    (r"\bQ([1-4])\s*(?:fy|fiscal(?:\s+year)?)?\s*'?(20\d\d|\d\d)\b", 1, 2),
    (r"\bfiscal\s+(?:year\s+)?(20\d\d)\s+(first|second|third|fourth)\s+quarter\b", 2, 1),
)
FORWARD_LOOKING, FORWARD_CHARS, HEAD_CHARS = "expect|outlook|guidance|guide|forecast|project|anticipat|target|for the upcoming", 45, 1500


def _places(text: Column, pattern: str) -> Column:
    """(at, hit) of all matches of a pattern: places follow from the lengths of what lies between them."""
    gaps = F.transform(F.split(text, pattern, -1), F.char_length)
    hits = F.regexp_extract_all(text, F.lit(pattern), 0)
    start = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<at:int,hit:string>>").alias("found"))

    def step(acc: Column, x: Column) -> Column:
        at = (acc["end"] + x["gap"]).cast("int")
        return F.struct((at + F.char_length(x["hit"])).cast("int").alias("end"), F.concat(acc["found"], F.array(F.struct(at.alias("at"), x["hit"].alias("hit")))).alias("found"))

    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
    return F.aggregate(pairs, start, step)["found"]


def quarter_from_text(docs: DataFrame, col: str) -> DataFrame:
    """``quarter``: the fiscal quarter that a text's head names, YYYYQn; null if it names none.

    Three ways of writing it are looked for together. Mentions with a forward-looking word in the characters before rank last; of the others the first wins.
    """
    head = F.left(F.col(col), F.lit(HEAD_CHARS))

    def mentions(i: int, pattern: str, q: int, y: int) -> Column:
        def one(m: Column) -> Column:
            before = F.substring(F.col("__head"), F.greatest(m["at"] - FORWARD_CHARS, F.lit(0)) + 1, F.least(m["at"], F.lit(FORWARD_CHARS)))
            return F.struct(before.rlike("(?i)" + FORWARD_LOOKING).alias("later"), m["at"].alias("at"), F.lit(i).alias("kind"), F.lower(F.regexp_extract(m["hit"], pattern, q)).alias("q"), F.regexp_extract(m["hit"], pattern, y).cast("int").alias("y"))

        return F.transform(_places(F.col("__head"), pattern), one)

    every = [mentions(i, "(?i)" + pattern, q, y) for i, (pattern, q, y) in enumerate(QUARTER_PATTERNS)]
    best = docs.withColumn("__head", head).withColumn("__best", F.array_min(F.concat(*every)))
    n = F.col("__best.q")
    n = F.when(n == "first", 1).when(n == "second", 2).when(n == "third", 3).when(n == "fourth", 4).otherwise(n.try_cast("int"))
    year = F.col("__best.y") + F.when(F.col("__best.y") < 100, 2000).otherwise(0)
    return best.withColumn("quarter", F.concat(year.cast("string"), F.lit("Q"), n.cast("string"))).drop("__head", "__best")


def clean_html(c: Column) -> Column:
    """A fragment without tags, its common entities decoded, blanks collapsed."""
    c = F.regexp_replace(c, r"<[^>]+>", "")
    for entity, text in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(text))
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def speaker_turns(pages: DataFrame, keys: list[str], html: str, panel: str, block: str, speaker: str, title: str, sentence: str, carry: bool = False) -> DataFrame:
    """keys, nth, speaker, title, sentences (an array) of a page's blocks, in page order from 1.

    ``panel`` is the text at which the blocks begin (a page without it has none), ``block`` the pattern that starts one; the other patterns have what they look for as
    group 1. Blocks without a sentence are dropped; so are those without a speaker, or else, with ``carry``, they go on with the last one.
    """
    at = F.instr(F.col(html), panel)
    inside = F.when(at > 0, F.substring(F.col(html), at, F.char_length(html)))
    blocks = pages.select(*keys, F.posexplode(F.split(inside, block, -1)).alias("nth", "block")).filter("nth > 0")
    first = lambda p: F.nullif(clean_html(F.regexp_extract("block", "(?s)" + p, 1)), F.lit(""))
    said = F.filter(F.transform(F.regexp_extract_all("block", F.lit("(?s)" + sentence), 1), clean_html), lambda x: x != "")
    turns = blocks.select(*keys, "nth", first(speaker).alias("speaker"), first(title).alias("title"), said.alias("sentences"))
    if carry:
        w = Window.partitionBy(*keys).orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
        who = F.last(F.when(F.col("speaker").isNotNull(), F.struct("speaker", "title")), ignorenulls=True).over(w)
        turns = turns.withColumn("who", who).select(*keys, "nth", "who.speaker", "who.title", "sentences")
    return turns.filter(F.col("speaker").isNotNull() & (F.size("sentences") > 0))


def relative_years(text: Column, year: Column) -> Column:
    """Four-digit years (1900 to 2099) rewritten as Y+n or Y-n."""
    parts = F.regexp_extract_all(text, F.lit(r"(\d+|\D+)"), 1)

    def one(p: Column) -> Column:
        n = p.cast("int") - year
        return F.when(p.rlike(r"^(19|20)\d\d$"), F.concat(F.lit("Y"), F.when(n >= 0, "+").otherwise("-"), F.abs(n).cast("string"))).otherwise(p)

    return F.array_join(F.transform(parts, one), "")


def verify_quotes(quotes: DataFrame, docs: DataFrame, share: float = 0.6, k: int = 5) -> DataFrame:
    """item_id, doc_id, share: texts that hold at least ``share`` of a quote's word k-grams, by a join on gram hashes. A document's grams
    count once; the quotes' grams all. Quotes of fewer words, two at least, must stand in a text whole: they meet it on their first two
    words. Quotes of one word, or of none, are never held."""
    words = lambda df, key: df.select(key, F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]+)"), 1).alias("w"))
    # no slice is ever of a negative length, whatever Spark evaluates first
    starts = lambda n: F.slice("w", F.lit(1), F.greatest(F.size("w") - (n - 1), F.lit(0)))
    grams = lambda n: F.transform(starts(n), lambda x, i: F.xxhash64(x, *(F.get("w", i + j) for j in range(1, n))))
    q_words, d_words = words(quotes, "item_id"), words(docs, "doc_id")
    q = q_words.select("item_id", grams(k).alias("g")).select("item_id", F.size("g").alias("n"), F.explode("g").alias("gram"))
    d = d_words.select("doc_id", F.explode(F.array_distinct(grams(k))).alias("gram"))
    long = q.join(d, "gram").groupBy("item_id", "doc_id").agg((F.count(F.lit(1)) / F.max("n")).alias("s")).filter(F.col("s") >= share)

    rest = lambda i: F.slice("w", i + 3, F.lit(k - 3))
    short = q_words.filter((F.size("w") >= 2) & (F.size("w") < k)).select("item_id", F.xxhash64(F.get("w", F.lit(0)), F.get("w", F.lit(1))).alias("gram"), rest(F.lit(0)).alias("more"))
    pairs = d_words.select("doc_id", F.explode(F.array_distinct(F.transform(starts(2), lambda x, i: F.struct(F.xxhash64(x, F.get("w", i + 1)).alias("gram"), rest(i).alias("after"))))).alias("p")).select("doc_id", "p.*")
    whole = short.join(pairs, "gram").filter(F.slice("after", F.lit(1), F.size("more")) == F.col("more")).select("item_id", "doc_id", F.lit(1.0).alias("s")).distinct()
    return long.unionByName(whole).select("item_id", "doc_id", F.round("s", 6).alias("share"))
