"""License scan in DataFrame functions alone: MinHash bands over overlapping windows.

A text is a sequence of words (runs of letters and digits in lower case) and of the hashes of
its five-word shingles. For a template of m shingles the text is seen in windows of
stride max(1, m // 2) that overlap so that any stretch of 1.25 m shingles lies in one of them. A
band is one minimum over the window's shingles (each hash XORed with the band's constant); a
window and a template meet where a band's minima agree. The number of bands is set by
`bands_for` so that a window that holds `similarity` of a template meets it with probability
`sure` (0.9999) at the least favourable place. What meets is verified exactly: the share of the
template's shingles, as text, that the window holds must reach `similarity`.

A band can only agree in a window that holds the very shingle which is the template's minimum
there, so minima are worked out for the windows around such shingles alone; the other windows
can't meet any template. A long text is first cut into segments that overlap by the longest
window, so that what is carried along with a shingle is a segment, however long the text is.

The templates are a parameter, one-line notices and whole texts alike. They are broadcast: over
MAX_TEMPLATES of them, over MAX_BYTES of text in all, or one of under five words is refused with
an error.

Nulls, empty texts and texts of under five words match nothing. Rows that repeat an id and a
text give one row for each template. Other columns of the input play no part, whatever their
names. An empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.llm.common import plain

WORDS = 5
MAX_TEMPLATES, MAX_BYTES = 10_000, 16 << 20
#: Shingles of a text's segments.
SEGMENT = 4096

#: Usual notices, of one line or whole.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Apache-2.0-notice": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "BSD-2-Clause-whole": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
        "in the documentation and/or other materials provided with the distribution. "
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, "
        "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
        "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
        "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
        "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
        "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "GPL-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    "MIT-whole": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
        "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
}


def word_array(text: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), " ")


def shingle(words: Column, at: Column) -> Column:
    return F.xxhash64(*[F.get(words, at + k) for k in range(WORDS)])


def shingle_texts(words: Column, first: Column, last: Column) -> Column:
    """The shingles at first..last as text; none if last is below first."""
    return F.when(last >= first, F.transform(F.sequence(first, last), lambda i: F.concat_ws(" ", *[F.get(words, i + k) for k in range(WORDS)]))).otherwise(F.array().cast("array<string>"))


def geometry(m: int) -> tuple[int, int]:
    """Stride and length of the windows for a template of m shingles."""
    stride = max(1, m // 2)
    return stride, stride + math.ceil(1.25 * m) - 1


def bands_for(m: int, similarity: float, sure: float = 0.9999) -> int:
    """Bands with which a window that holds `similarity` of m shingles meets surely enough."""
    held = math.ceil(similarity * m)
    jaccard = held / (geometry(m)[1] + m - held)
    return 1 if jaccard >= 1 else math.ceil(math.log(1 - sure) / math.log(1 - jaccard))


def constant(band: int) -> int:
    """A signed 64-bit constant for each band (splitmix64)."""
    z = (band + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF
    z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
    z = (z ^ z >> 27) * 0x94D049BB133111EB & 0xFFFFFFFFFFFFFFFF
    z ^= z >> 31
    return z - (1 << 64) if z >> 63 else z


def anchors_of(spark: SparkSession, templates: dict[str, str], similarity: float) -> tuple[list, list]:
    """The bands of the templates, (at, license, c, low, stride, length), and (license, texts)."""
    if len(templates) > MAX_TEMPLATES or sum(map(len, templates.values())) > MAX_BYTES:
        raise ValueError(f"over {MAX_TEMPLATES} templates, or over {MAX_BYTES} characters of them")
    given = spark.createDataFrame(sorted(templates.items()), "license string, text string").withColumn("w", word_array(F.col("text")))
    size = F.size("w")
    hashes = F.when(size >= WORDS, F.transform(F.sequence(F.lit(0), size - WORDS), lambda i: shingle(F.col("w"), i)))
    hashed = given.select("license", "w", size.alias("n"), hashes.alias("h")).collect()  # the parameter's rows
    if short := [r["license"] for r in hashed if r["n"] < WORDS]:
        raise ValueError(f"templates of under {WORDS} words: {short}")
    bands, texts = [], []
    for r in hashed:
        texts.append((r["license"], sorted({" ".join(r["w"][k : k + WORDS]) for k in range(len(r["h"]))})))
        stride, length = geometry(len(r["h"]))
        for band in range(bands_for(len(r["h"]), similarity)):
            c = constant(band)
            low, at = min((h ^ c, h) for h in r["h"])
            bands.append((at, r["license"], c, low, stride, length))
    return bands, texts


def segments(w: Column, last: Column, reach: int, size: int) -> Column:
    """(base, home, part): the words for the shingles home..home + size - 1 and `reach` on each side."""

    def one(home: Column) -> Column:
        base = F.greatest(F.lit(0), home - reach)
        return F.struct(base.alias("base"), home.alias("home"), F.slice(w, base + 1, home - base + (size + reach + WORDS)).alias("part"))

    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last, F.lit(size)), one))


def scan(docs: DataFrame, templates: dict[str, str] | DataFrame = TEMPLATES, similarity: float = 0.8, segment: int = SEGMENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, license, containment, first_word, windows): a row for each template a text holds.

    templates: texts by name, or a table (license, text).
    """
    spark = docs.sparkSession
    if isinstance(templates, DataFrame):
        templates = {r["license"]: r["text"] for r in templates.limit(MAX_TEMPLATES + 1).collect()}
    anchors, own = anchors_of(spark, templates, similarity)
    bands = spark.createDataFrame(anchors, "at bigint, license string, c bigint, low bigint, stride int, length int")
    texts = spark.createDataFrame(own, "license string, texts array<string>")
    known = sorted({a[0] for a in anchors})
    reach = max((a[5] for a in anchors), default=0)

    words = word_array(F.col("text"))
    rows = plain(docs, doc_id=id_col, text=text_col).select("doc_id", F.xxhash64("text").alias("of"), words.alias("w"))
    last = F.size("w") - WORDS
    cut = rows.select("doc_id", "of", last.alias("last"), F.explode(segments(F.col("w"), last, reach, segment)).alias("s")).select("doc_id", "of", "last", "s.*")
    w, low = F.col("part"), F.col("home") - F.col("base")
    high = F.least(low + (segment - 1), F.size("part") - WORDS)
    # explode_outer, so that the search isn't repeated in a filter on its size.
    hits = F.filter(F.sequence(low, high), lambda i: shingle(w, i).isin(known)) if known else F.array().cast("array<int>")
    found = cut.select("doc_id", "of", "last", "base", "part", F.explode_outer(hits).alias("p")).where("p is not null")
    met = found.withColumn("at", shingle(w, F.col("p"))).join(F.broadcast(bands), "at").withColumn("i", F.col("p") + F.col("base"))
    first_window = F.greatest(F.lit(0), F.ceil((F.col("i") - F.col("length") + 1) / F.col("stride")).cast("int"))
    window = F.explode(F.sequence(first_window, F.floor(F.col("i") / F.col("stride")).cast("int")))
    seen = met.withColumn("window", window).withColumn("first", F.col("window") * F.col("stride") - F.col("base"))
    end = F.least(F.col("first") + F.col("length") - 1, F.col("last") - F.col("base"))
    minimum = F.array_min(F.transform(F.sequence(F.col("first"), end), lambda i: shingle(w, i).bitwiseXOR(F.col("c"))))
    agreed = seen.where(minimum == F.col("low")).withColumn("have", shingle_texts(w, F.col("first"), end)).join(F.broadcast(texts), "license")
    # The share of the template in the window, and the first word that belongs to it.
    share = F.size(F.array_intersect("texts", "have")) / F.size("texts")
    place = F.col("base") + F.col("first") + F.array_position(F.transform("have", lambda s: F.array_contains("texts", s)), True).cast("int") - 1
    held = agreed.select("doc_id", "of", "license", share.alias("containment"), "window", place.alias("place")).where(F.col("containment") >= similarity)
    return held.groupBy("doc_id", "of", "license").agg(F.max("containment").alias("containment"), F.min("place").alias("first_word"), F.count_distinct("window").alias("windows")).drop("of")
