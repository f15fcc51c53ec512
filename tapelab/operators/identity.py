"""Names in texts: who speaks, what a company's names are, texts without them, and guesses that hold them.

Names belong to a key (a company). Alias tables come from tables: a company's own names and its programs', the people
who speak in its texts, and their bare names unless those are ordinary words there.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of a key's aliases that stand beside each of its texts; a key with more has several such parts.
MAX_ALIAS_BYTES = 16 << 10

_SPEAKER = r"^[A-Z][a-zA-Z.'-]+( [A-Z][a-zA-Z.'-]+){1,3}$"
_WORD = r"\b([a-z][a-z'-]*)\b"
_TERM = r"\b([A-Z][A-Za-z0-9]*(?:-[A-Za-z0-9]+)*)\b"
_YEAR = re.compile(r"\b(?:19|20)\d{2}\b")
_ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")

#: Capitalised words that name nobody.
STOP_TERMS = (
    "january february march april may june july august september october november december monday tuesday wednesday thursday friday us u.s uk eu ceo cfo coo cto gaap non-gaap eps yoy qoq sec ebitda fcf ir ai ml it q1 q2 q3 q4 fy operator "
    "person company program thanks thank okay ok yes no hi hello good great well sure right so and but the our we you i"
).split()


def people(docs: DataFrame, key: str, order: str) -> DataFrame:
    """key, person, n, number: speakers of a key's texts, numbered by where they first stand.

    A speaker is a line of two to four capitalised words that doesn't end with a stop, and that recurs or has a line with a comma after it. Null texts have none.
    """
    lines = docs.select(key, order, F.split("text", "\n").alias("lines"))
    lines = lines.select(key, order, F.posexplode(F.transform("lines", lambda x, i: F.struct(x.alias("line"), F.get("lines", i + 1).alias("following")))).alias("i", "x"))
    hits = lines.select(key, order, "i", "x.*").filter(F.col("line").rlike(_SPEAKER) & ~F.endswith("line", F.lit(".")))
    g = hits.groupBy(key, F.col("line").alias("person")).agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.coalesce("following", F.lit("")).contains(",")).alias("titled"), F.min(F.struct(order, "i")).alias("first"))
    g = g.filter("n >= 2 or titled")
    return g.select(key, "person", "n", F.row_number().over(Window.partitionBy(key).orderBy("first", "person")).alias("number"))


def ordinary_words(docs: DataFrame, key: str) -> DataFrame:
    """key, word: words that stand in lower case somewhere in a key's texts."""
    return docs.select(key, F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(_WORD), 1))).alias("word")).distinct()


def alias_table(config: DataFrame, speakers: DataFrame, ordinary: DataFrame, key: str) -> DataFrame:
    """key, alias (lower case), placeholder, chars. ``config`` has key, program (0: the company itself), nth, alias.

    A program's alias that doesn't end with s has a plural too. Speakers go by their whole names, and by first and last name unless that is an ordinary word.
    Of equal aliases the first placeholder wins: the company's, then its programs', people, bare names.
    """
    own = config.select(key, "alias", F.when(F.col("program") == 0, F.lit("Company A")).otherwise(F.concat(F.lit("Program "), F.col("program").cast("string"))).alias("placeholder"), F.struct(F.when(F.col("program") == 0, 0).otherwise(1).alias("kind"), F.col("program").cast("int").alias("a"), F.col("nth").cast("int").alias("b"), F.lit(0).alias("c")).alias("rank"))
    plural = own.filter((F.col("rank.kind") == 1) & ~F.endswith(F.lower("alias"), F.lit("s"))).select(key, F.concat("alias", F.lit("s")).alias("alias"), "placeholder", F.struct(F.col("rank.kind").alias("kind"), F.col("rank.a").alias("a"), F.col("rank.b").alias("b"), F.lit(1).alias("c")).alias("rank"))
    place = F.concat(F.lit("Person "), F.col("number").cast("string")).alias("placeholder")
    whole = speakers.select(key, F.col("person").alias("alias"), place, F.struct(F.lit(2).alias("kind"), F.col("number").cast("int").alias("a"), F.lit(0).alias("b"), F.lit(0).alias("c")).alias("rank"))
    parts = F.split("person", " ")
    bare = speakers.select(key, "number", F.posexplode(F.array(F.element_at(parts, 1), F.element_at(parts, -1))).alias("b", "alias"))
    bare = bare.select(key, "alias", place, F.struct(F.lit(3).alias("kind"), F.col("number").cast("int").alias("a"), F.col("b"), F.lit(0).alias("c")).alias("rank"), F.lower("alias").alias("word")).join(by_merge(ordinary), [key, "word"], "left_anti").drop("word")
    every = own.unionByName(plural).unionByName(whole).unionByName(bare).filter(F.col("alias") != "")
    return every.groupBy(key, F.lower("alias").alias("alias")).agg(F.min_by("placeholder", "rank").alias("placeholder")).select(key, "alias", "placeholder", F.char_length("alias").cast("long").alias("chars"))


def lowered(text: str) -> str:
    """Lower case, letter for letter: as long as the text."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def automaton(aliases: list[tuple[object, str, str]]) -> ahocorasick.Automaton:
    """A trie with failure links of all aliases; each end of one has its length and what it stands for, by key."""
    values: dict[str, dict] = {}
    for key, alias, placeholder in aliases:
        values.setdefault(alias, {})[key] = placeholder
    out = ahocorasick.Automaton()
    for alias, by_key in values.items():
        out.add_word(alias, (len(alias), by_key))
    if values:
        out.make_automaton()
    return out


def matches(found: ahocorasick.Automaton, key: object, text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, placeholder) of all aliases of ``key`` in a text that ASCII letters and digits neither precede nor follow; they may overlap."""
    if not len(found):
        return
    for last, (n, by_key) in found.iter(lowered(text)):
        start, end = last + 1 - n, last + 1
        if key in by_key and (start == 0 or text[start - 1] not in _ALNUM) and (end == len(text) or text[end] not in _ALNUM):
            yield start, end, by_key[key]


def replaced(text: str, spans, year: int | None) -> str:
    """The text with spans replaced from left to right, the longest at a place first; what lies between has its years told relative to ``year``."""
    longest: dict[int, tuple[int, str]] = {}
    for start, end, placeholder in spans:
        if end > longest.get(start, (0, ""))[0]:
            longest[start] = end, placeholder

    def relative(piece: str) -> str:
        return piece if year is None else _YEAR.sub(lambda m: f"Y{int(m[0]) - year:+d}", piece)

    out, at = [], 0
    for start in sorted(longest):
        if start >= at:
            end, placeholder = longest[start]
            out += [relative(text[at:start]), placeholder]
            at = end
    return "".join([*out, relative(text[at:])])


def _map_rows(df: DataFrame, one, schema) -> DataFrame:
    """``one(values of a row)`` for each row, in Arrow batches; it gives a list of values of ``schema``, or several."""

    def run(batches):
        for b in batches:
            rows = [r for row in zip(*(c.to_pylist() for c in b.columns)) for r in one(*row)] if b.num_rows else []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(map(list, zip(*rows)), types)], names)

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    types, names = arrow.types, arrow.names
    return df.mapInArrow(run, schema)


def deidentify(docs: DataFrame, aliases: DataFrame, key: str, year: Column | None = None, max_bytes: int = MAX_ALIAS_BYTES) -> DataFrame:
    """``docs`` with their aliases (key, alias, placeholder) replaced in ``text``, whatever their case, and years told relative to ``year``.

    One pass from left to right, the longest alias first, so that placeholders are never read again. Null texts stay null; a null key has no aliases. A text meets
    its own key's aliases only, as an array beside it. A key with more than ``max_bytes`` of them has several arrays: each finds its places, and a text's places
    meet again by its hash; the replacement is the same.
    """
    from pyspark.sql.types import StringType, StructField, StructType

    size = F.octet_length("alias") + F.octet_length("placeholder") + 64
    a = aliases.select(F.col(key).alias("__k"), "alias", "placeholder").filter(F.col("__k").isNotNull())
    parts = a.groupBy("__k").agg(F.ceil(F.sum(size) / max_bytes).alias("__parts")).filter("__parts > 1")
    listed = lambda t, *by: t.groupBy(*by).agg(F.collect_list(F.struct("alias", "placeholder")).alias("__aliases"))
    names = docs.columns
    rows = docs.withColumns({"__year": (F.lit(None) if year is None else year).cast("int"), "__key": F.col(key)})
    at, year_at, last = names.index("text"), len(names), len(names) + 2
    schema = StructType([StructField(f.name, StringType() if f.name == "text" else f.dataType) for f in docs.schema])

    def replace_all(spans_of):
        def run(batches):
            for b in batches:
                spans = spans_of()
                texts, years = b.column(at).to_pylist(), b.column(year_at).to_pylist()
                out = [None if t is None else replaced(t, spans(b, i, t), y) for i, (t, y) in enumerate(zip(texts, years))]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if i == at else b.column(i) for i in range(len(names))], names)

        return run

    def own_spans():
        """Places of the aliases beside a text; texts of a key come one after the other, so it is seldom that another automaton is built."""
        now: list = [None, None]

        def spans(b, i, text):
            k, table = b.column(last - 1)[i].as_py(), b.column(last)
            if k is None or not table[i].is_valid:
                return ()
            if now[0] != k:
                now[:] = k, automaton([(k, x["alias"], x["placeholder"]) for x in table[i].as_py()])
            return matches(now[1], k, text)

        return spans

    small = a if parts.isEmpty() else a.join(parts, "__k", "left_anti")
    # with a hash among its keys the join has exchanges of its own, apart from the lists', so that Spark can split a key of many texts
    same = (F.xxhash64("__key") == F.xxhash64("__k")) & (F.col("__key") == F.col("__k"))
    joined = rows.join(by_merge(listed(small, "__k")), same, "left").select(*rows.columns, "__aliases")
    if small is a:
        return joined.mapInArrow(replace_all(own_spans), schema)

    ids = {"__a": F.xxhash64("__key", "text"), "__b": F.xxhash64("text", "__key", F.lit(1))}
    pieces = listed(a.join(parts, "__k").withColumn("__part", F.pmod(F.xxhash64("alias"), "__parts")), "__k", "__part")
    large = rows.join(parts.select("__k"), F.col("__key") == F.col("__k"), "left_semi")

    def find(batches):
        now: list = [None, None]
        for b in batches:
            hits, table = [], b.column(5)
            for i, (x, y, k, t, part) in enumerate(zip(*(b.column(c).to_pylist() for c in range(5)))):
                if now[0] != (k, part):
                    now[:] = (k, part), automaton([(k, r["alias"], r["placeholder"]) for r in table[i].as_py()])
                hits += [(x, y, s, e, p) for s, e, p in matches(now[1], k, t)]
            cols = list(zip(*hits)) if hits else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string()))], ["__a", "__b", "s", "e", "p"])

    texts = large.filter(F.col("text").isNotNull()).select(*(c.alias(n) for n, c in ids.items()), "__key", "text").distinct()
    found = texts.join(by_merge(pieces), same).select("__a", "__b", "__key", "text", "__part", "__aliases").mapInArrow(find, "__a long, __b long, s int, e int, p string")
    found = found.groupBy("__a", "__b").agg(F.collect_list(F.struct("s", "e", "p")).alias("__spans"))  # no more than a text has places
    met = large.withColumns(ids).join(found, ["__a", "__b"], "left").select(*rows.columns, "__spans")
    rest = joined.join(parts.select("__k"), F.col("__key") == F.col("__k"), "left_anti")

    def found_spans():
        return lambda b, i, text: [(x["s"], x["e"], x["p"]) for x in b.column(last)[i].as_py() or ()]

    return rest.mapInArrow(replace_all(own_spans), schema).unionAll(met.mapInArrow(replace_all(found_spans), schema))


def _tokens(c: str) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), 1)


def recognition(guesses: DataFrame, aliases: DataFrame, key: str) -> DataFrame:
    """key, n, recognised: how many guesses a key has, and the share that hold one of its aliases as whole words.

    A guess meets the aliases on windows of its words, of the lengths that aliases have; null guesses hold none.
    """
    names = aliases.select(F.col(key), F.array_join(_tokens("alias"), " ").alias("window"), F.size(_tokens("alias")).alias("words")).filter("words > 0").select(key, "window", "words").distinct()
    longest = names.agg(F.max("words")).first()[0] or 0
    numbered = guesses.select(key, F.monotonically_increasing_id().alias("row"), "guess")
    w = numbered.select(key, "row", F.coalesce(_tokens("guess"), F.array().cast("array<string>")).alias("w"))
    sizes = F.array(*map(F.lit, range(1, longest + 1))) if longest else F.array().cast("array<int>")
    windows = F.array_distinct(F.flatten(F.transform(sizes, lambda n: F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.size("w"), F.lit(1))), lambda i: i + n - 1 <= F.size("w")), lambda i: F.array_join(F.slice("w", i, n), " ")))))
    # the row's number stays within one plan: windows carry it through the join and are summed by it
    exploded = w.select(key, "row", F.explode_outer(windows).alias("window"))
    hit = exploded.join(names.select(key, "window", F.lit(1).alias("hit")), [key, "window"], "left")
    per = hit.groupBy(key, "row").agg(F.max(F.coalesce("hit", F.lit(0))).alias("hit"))
    return per.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("hit"), 6).alias("recognised"))


def candidate_terms(docs: DataFrame, speakers: DataFrame, ordinary: DataFrame, config: DataFrame, key: str, least: int = 5, least_docs: int = 3, top: int = 60) -> DataFrame:
    """key, term, n, docs: capitalised terms that may tell who a key is; its ``top`` by uses, then by name.

    Left out are stop words, words that stand in lower case too, and the words of people's and the company's own names.
    """
    numbered = docs.select(key, F.monotonically_increasing_id().alias("row"), "text")  # before rows are spread
    per = numbered.select(key, "row", F.explode(F.regexp_extract_all("text", F.lit(_TERM), 1)).alias("term")).groupBy(key, "row", "term").agg(F.count(F.lit(1)).alias("c"))
    terms = per.groupBy(key, "term").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("docs")).filter((F.col("n") >= least) & (F.col("docs") >= least_docs) & (F.char_length("term") >= 2) & ~F.col("term").rlike("^[0-9]+$"))
    terms = terms.withColumn("word", F.lower("term")).filter(~F.col("word").isin(STOP_TERMS))
    named = speakers.select(key, F.explode(F.split(F.lower("person"), " ")).alias("word")).unionByName(config.filter("program = 0").select(key, F.explode(_tokens("alias")).alias("word"))).distinct()
    left = terms.join(by_merge(ordinary), [key, "word"], "left_anti").join(by_merge(named), [key, "word"], "left_anti")
    nth = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "term"))
    return left.withColumn("nth", nth).filter(F.col("nth") <= top).select(key, "term", "n", "docs")


def lower_vocabulary(texts: DataFrame, keys: list[str], col: str = "text") -> DataFrame:
    """keys, word: the words of texts in lower case, each once a key."""
    return texts.select(*keys, F.explode(F.array_distinct(F.regexp_extract_all(F.lower(col), F.lit("([a-z][a-z'-]*)"), 1))).alias("word")).distinct()


def by_merge(words: DataFrame) -> DataFrame:
    """``words`` (or texts) for a join by sorting: they are many times what Spark takes their size to be, so it would broadcast them."""
    return words.hint("merge")


def vocabulary_difference(words: DataFrame, known: DataFrame, on: list[str]) -> DataFrame:
    """The rows of ``words`` whose columns ``on`` no row of ``known`` has."""
    return words.join(by_merge(known.select(*on).distinct()), on, "left_anti")


def novel_terms(outputs: DataFrame, sources: DataFrame, prompts: DataFrame, others: DataFrame, key: str, call: list[str]) -> DataFrame:
    """call, term: capitalised terms of a call's ``outputs`` with a part (of three letters or more, not a number) that is in none of three vocabularies: its own source's, the
    prompts', and the lower-case words of other keys' sources; nor in lower case in the output itself.

    A word of others' sources is known to a key if any other key has it: words are counted by how many keys have them, so no pair of keys meets.
    """
    terms = outputs.select(*call, F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(_TERM), 1))).alias("term"))
    parts = terms.select(*call, "term", F.explode(F.split("term", "-")).alias("part")).filter((F.char_length("part") >= 3) & ~F.col("part").rlike("^[0-9]+$")).select(*call, "term", F.lower("part").alias("word"))
    left = vocabulary_difference(parts, lower_vocabulary(sources, call), [*call, "word"])
    left = vocabulary_difference(left, lower_vocabulary(prompts, []), ["word"])
    left = vocabulary_difference(left, outputs.select(*call, F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(_WORD), 1))).alias("word")), [*call, "word"])
    shared = ordinary_words(others, key).groupBy("word").agg(F.min(key).alias("least"), F.max(key).alias("most"))
    known = left.join(by_merge(shared), "word", "left").filter(F.col("least").isNull() | ((F.col("least") == F.col(key)) & (F.col("most") == F.col(key))))
    return known.select(*call, "term").distinct()
