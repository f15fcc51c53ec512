"""License scans by diagonal voting, in DataFrame functions alone.

All rolling k-grams of words are hashed and joined with the positions of the same k-grams in a table of license
templates. A match at word ``i`` of a document and ``j`` of a template votes for the diagonal ``i - j``; votes are added
up per diagonal, neighbouring diagonals (a few words put in or left out) are merged, and a merged span is a license
when enough of the template's k-grams lie on it and no other license's template covers the place better. Documents are read and cut into words once: of the
k-grams, those that a template has and one per document go on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapelab.llm.common import ascii_lower, let

K = 4
#: Diagonals at most so many words apart are one span.
GAP = 3
#: Least share of a template's k-grams on a span: short notices must be nearly whole.
LEAST_SHORT, LEAST_LONG, SHORT = 0.7, 0.5, 16
#: What separates words: ASCII characters that are no digit and no letter. Fixed by the contract.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases of the base scan. Fixed by the contract.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Notices and characteristic passages of public licenses, by label.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("mit", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see http://www.gnu.org/licenses/"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("lgpl", "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("cc0", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("boost", "Distributed under the Boost Software License, Version 1.0. See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt"),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("mpl", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("proprietary", "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means"),
)


def words(text: Column) -> Column:
    """The lower-case words of a text; null has none."""
    return F.filter(F.split(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), SEPARATORS), lambda w: w != "")


def gram_hashes(ws: Column, k: int = K) -> Column:
    """Hashes of the k-grams of an array of words, in order; none where there are fewer words."""
    n = F.greatest(F.size(ws) - (k - 1), F.lit(0))
    return F.transform(F.slice(ws, F.lit(1), n), lambda w, i: F.xxhash64(w, *(F.get(ws, i + j) for j in range(1, k))))


def template_table(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    """label, body: the templates, as a table."""
    return spark.createDataFrame(list(templates), "label string, body string")


def template_grams(templates: DataFrame, k: int = K) -> DataFrame:
    """template, label, n_grams, gram, template_at of templates (label, body): a row per word of their texts."""
    t = templates.select(F.xxhash64("label", "body").alias("template"), "label", gram_hashes(words(F.col("body")), k).alias("grams")).distinct()
    return t.select("template", "label", F.size("grams").alias("n_grams"), F.posexplode("grams").alias("template_at", "gram"))


def _starts(ws: Column, phrase: str) -> Column:
    """Positions at which the words of ``phrase`` follow each other."""
    first, *rest = phrase.split()

    def here(i: Column) -> Column:
        hit = F.get(ws, i) == first
        for j, w in enumerate(rest, 1):
            hit = hit & F.coalesce(F.get(ws, i + j) == w, F.lit(False))
        return hit

    return F.filter(F.sequence(F.lit(0), F.greatest(F.size(ws) - len(rest) - 1, F.lit(0))), lambda i: F.coalesce(here(i), F.lit(False)))


def scan(docs: DataFrame, templates: DataFrame | None = None, phrases=PHRASES, k: int = K, gap: int = GAP) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans; one row per row of ``docs``.

    ``labels`` are the base labels and those of verified spans (``spans``: label, first_word, last_word, coverage); ``score`` is the largest coverage of
    a span, 1 where a base phrase stands, else 0. Null and empty texts have no words, no labels and score 0. Rows that
    repeat, null ids and ids of several texts are rows like any other; an empty table gives no rows. ``templates``: a table
    (label, body); TEMPLATES by default, which is small enough to broadcast.
    """
    table = template_grams(template_table(docs.sparkSession), k)
    table = F.broadcast(table) if templates is None else template_grams(templates, k)
    text = F.col("text").cast("string")
    low = ascii_lower(F.coalesce(text, F.lit("")))
    empty = F.array().cast("array<int>")

    def found(ws: Column) -> Column:
        # texts without a phrase's longest word (the last of these) needn't be gone through for it
        at = (F.when(low.contains(max(reversed(p.split()), key=len)), _starts(ws, p)).otherwise(empty).alias(f"at{i}") for i, (p, _) in enumerate(phrases))
        return F.struct(F.size(ws).cast("long").alias("n_words"), gram_hashes(ws, k).alias("grams"), *at)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), let(words(text), found).alias("found"))
    places = F.concat(*(F.col(f"found.at{i}") for i in range(len(phrases))))
    base_labels = F.array_compact(F.array(*(F.when(F.size(f"found.at{i}") > 0, F.lit(label)) for i, (_, label) in enumerate(phrases))))
    base = F.struct("doc_id", "found.n_words", F.size(places).cast("long").alias("n_base"), F.array_min(places).cast("long").alias("first_word"), F.array_max(places).cast("long").alias("last_word"), base_labels.alias("base_labels"))
    rows = rows.select(F.monotonically_increasing_id().alias("row"), base.alias("base"), F.col("found.grams").alias("grams"))  # numbered before they are spread
    grams = rows.select("row", "base", F.posexplode_outer("grams").alias("at", "gram"))
    votes = grams.join(table, "gram", "left").filter("template is not null or at is null or at = 0").drop("gram").repartition("row")
    # all that follows is by row, which is dealt out once
    diagonals = votes.groupBy("row", "template", "label", "n_grams", (F.col("at") - F.col("template_at")).alias("diagonal")).agg(
        F.first("base").alias("base"), F.collect_set("template_at").alias("hit"), F.min("at").alias("first_word"), F.max("at").alias("last_at")
    )
    # repeats of a template lie on diagonals far apart, unless they overlap in the text
    w = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = diagonals.withColumn("new", (F.col("diagonal") - F.lag("diagonal").over(w) > gap).cast("int"))
    merged = apart.withColumn("span", F.sum(F.coalesce("new", F.lit(0))).over(w)).groupBy("row", "template", "label", "n_grams", "span").agg(
        F.first("base").alias("base"), F.size(F.array_distinct(F.flatten(F.collect_list("hit")))).alias("hits"), F.min("first_word").alias("first_word"), (F.max("last_at") + k - 1).alias("last_word")
    )
    coverage = F.least(F.col("hits") / F.col("n_grams"), F.lit(1.0))
    # the words between the first and the last vote must be about as many as the template's
    whole = F.col("last_word") - F.col("first_word") + 1 <= 2 * (F.col("n_grams") + k)
    enough = F.col("template").isNotNull() & whole & (coverage >= F.when(F.col("n_grams") <= SHORT, LEAST_SHORT).otherwise(LEAST_LONG))
    span = F.struct("label", "first_word", "last_word", coverage.alias("coverage"))
    out = merged.groupBy("row").agg(F.first("base").alias("base"), F.array_sort(F.collect_list(F.when(enough, span))).alias("all"))
    better = lambda s, t: (t["label"] != s["label"]) & (t["coverage"] > s["coverage"]) & (t["first_word"] <= s["last_word"]) & (t["last_word"] >= s["first_word"])
    out = out.select("base.*", F.filter("all", lambda s: ~F.exists("all", lambda t: better(s, t))).alias("spans"))
    joined = lambda c: F.concat_ws(",", F.array_sort(F.array_distinct(c)))
    score = F.greatest(F.when(F.col("n_base") > 0, 1.0).otherwise(0.0), F.coalesce(F.array_max(F.transform("spans", lambda s: s["coverage"])), F.lit(0.0)))
    all_labels = F.concat("base_labels", F.transform("spans", lambda s: s["label"]))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", joined(F.col("base_labels")).alias("base_labels"), joined(all_labels).alias("labels"), score.alias("score"), "spans")
