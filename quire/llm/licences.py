"""Licence scan: sparse TF-IDF cosine of texts to licence templates, then nearest-ancestor directory inheritance.

Units are the lines of every text, two and three neighbouring lines joined (a wrapped notice), its paragraphs (a header
block, or a licence's text below its title) and the whole text of licence files. A unit can reach the
threshold for a template only if it holds one of the template's rare terms: by Cauchy-Schwarz the terms it shares must
carry threshold**2 of the template's mass, which its most frequent terms alone don't. That prefix filter drops nearly all texts before any unit is made, and
nearly all units before any term is exploded, and loses none. Term frequencies over all documents give the weights; a term outside the templates weighs as one that
no document has. Only DataFrame functions are used, and only the templates (a parameter) ever travel as literals.

A unit speaks for a template if it shares two terms with it at least and their cosine reaches the threshold; a file has
the licence of its best unit (ties: the smaller licence name). A file that speaks
for its directory gives it that licence (several: highest score, then smallest path). Any other file takes the licence
of its nearest ancestor directory that has one.

Defined results: null and empty texts have no licence of their own; very long texts are scanned whole; a null path has
none and inherits none; in the query a null path part counts as "_"; repeated rows are scanned as rows of one path; an
empty table gives an empty result; other columns pass through, but those named licence, score, how or licence_dir give
way to the results.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm._common import materialize, table

#: Short notices, titles and notices or permission texts of common licences, one or more for each licence.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD style license that can be found in the LICENSE file"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3"),
    ("MIT", "Released under the MIT License"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("proprietary", "All rights reserved"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International Public License"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("ISC", "ISC License"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("MIT", "The MIT License"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
     "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT "
     "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code "
     "must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions "
     "and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used "
     "to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS "
     "OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
     "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, "
     "DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY "
     "OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 "
     "of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
     "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this "
     "program. If not, see https://www.gnu.org/licenses/."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice "
     "appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO "
     "EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF "
     "CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, "
     "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished "
     "to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS "
     "PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT "
     "SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
     "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
)
THRESHOLD = 0.8
SPLIT = r"[^a-z0-9]+"
LINE_END, PARAGRAPH_END = r"\r\n|\n|\r", r"(\r\n|\n|\r)[ \t]*(\r\n|\n|\r)"
#: Names of licence files.
FILE_NAME = r"(?i)/(licen[cs]e|copying|notice|unlicense)[^/]*\z"


def terms(text: str) -> list[str]:
    return [w for w in re.split(SPLIT, text.lower()) if w]


def words_of(text: Column) -> Column:
    return F.split(F.lower(text), SPLIT)


def document_frequencies(texts: DataFrame, vocabulary: list[str]) -> tuple[int, dict[str, int]]:
    """Number of texts, and of texts with each template term (one count a term reaches the driver)."""
    present = F.array_intersect(words_of(F.coalesce("text", F.lit(""))), F.array(*map(F.lit, vocabulary)))
    rows = texts.select(F.explode(F.concat(present, F.array(F.lit("")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()
    found = {r["term"]: r["n"] for r in rows}
    return found.pop("", 0), found


def weigh(total: int, df: dict[str, int], templates=TEMPLATES) -> tuple[dict[str, float], list[tuple[int, str, float]]]:
    """Smoothed inverse document frequencies of the template terms, and the normed template vectors as (template number, term, weight)."""
    idf = {t: math.log((1 + total) / (1 + df.get(t, 0))) + 1 for _, text in templates for t in terms(text)}
    vectors = []
    for no, (_, text) in enumerate(templates):
        own = terms(text)
        raw = {t: own.count(t) * idf[t] for t in own}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        vectors += [(no, t, v / norm) for t, v in sorted(raw.items())]
    return idf, vectors


def needed_terms(vectors: list[tuple[int, str, float]], threshold: float, df: dict[str, int]) -> list[str]:
    """Terms of which a unit must hold one: all of a template but its most frequent ones, as many as carry under threshold**2 of its mass."""
    out: set[str] = set()
    for no in {n for n, _, _ in vectors}:
        left = 0.0
        for _, w, t in sorted((-df.get(t, 0), w, t) for n, t, w in vectors if n == no):
            if left + w * w < threshold**2 - 1e-9:
                left += w * w
            else:
                out.add(t)
    return sorted(out)


def units_of(path: Column, text: Column) -> Column:
    """What is compared with the templates: lines, two and three lines joined, paragraphs, and a licence file's whole text."""
    lines = F.split(text, LINE_END)
    none = F.array().cast("array<string>")
    joined = lambda k: F.when(F.size(lines) >= k, F.transform(F.sequence(F.lit(1), F.size(lines) - (k - 1)), lambda i: F.array_join(F.slice(lines, i, F.lit(k)), " "))).otherwise(none)
    whole = F.when(path.rlike(FILE_NAME), F.array(text)).otherwise(none)
    return F.array_distinct(F.concat(lines, joined(2), joined(3), F.split(text, PARAGRAPH_END), whole))


def scan(files: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """path, licence, score: best template of each path whose best unit reaches the threshold."""
    spark = files.sparkSession
    total, df = document_frequencies(files, sorted({t for _, text in templates for t in terms(text)}))
    idf, vectors = weigh(total, df, templates)
    needed = F.array(*map(F.lit, needed_terms(vectors, threshold, df)))
    texts = files.select("path", F.coalesce("text", F.lit("")).alias("text")).where(F.arrays_overlap(words_of(F.col("text")), needed))
    units = texts.select("path", F.explode(units_of(F.coalesce("path", F.lit("")), F.col("text"))).alias("unit")).where(F.arrays_overlap(words_of(F.col("unit")), needed))
    # equal units are scored once, however many texts have them; from here on a unit is 96 bits of hash, not its text
    units = materialize(units.select("path", F.xxhash64("unit").alias("u"), F.hash("unit").alias("u2"), "unit"), "licence-units")
    tf = units.groupBy("u", "u2").agg(F.min("unit").alias("unit")).select("u", "u2", F.explode(words_of(F.col("unit"))).alias("term")).where("term <> ''").groupBy("u", "u2", "term").agg(F.count(F.lit(1)).alias("tf"))
    weights = spark.createDataFrame([(t, float(idf[t]), no, templates[no][0], float(w)) for no, t, w in vectors], "t string, idf double, no int, licence string, w double")
    per_term = weights.groupBy("t").agg(F.first("idf").alias("idf"), F.collect_list(F.struct("no", "licence", "w")).alias("in"))
    unknown = math.log(1 + total) + 1
    joined = tf.join(F.broadcast(per_term), F.col("term") == F.col("t"), "left").select("u", "u2", (F.col("tf") * F.coalesce("idf", F.lit(unknown))).alias("x"), "in")
    norms = joined.groupBy("u", "u2").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    dots = joined.select("u", "u2", "x", F.explode("in").alias("i")).groupBy("u", "u2", F.col("i.no").alias("no"), F.col("i.licence").alias("licence")).agg(F.sum(F.col("x") * F.col("i.w")).alias("dot"), F.count(F.lit(1)).alias("shared")).where("shared > 1")
    scored = dots.join(norms, ["u", "u2"]).select("u", "u2", "licence", F.round(F.col("dot") / F.col("norm"), 6).alias("score")).where(F.col("score") >= threshold)
    best = scored.groupBy("u", "u2").agg(F.min(F.struct((-F.col("score")).alias("s"), "licence")).alias("b"))
    of_path = units.select("path", "u", "u2").join(best, ["u", "u2"]).groupBy("path").agg(F.min("b").alias("b"))
    return of_path.select("path", F.col("b.licence").alias("licence"), (-F.col("b.s")).alias("score"))


def directory(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*\z", "")


def inherit(found: DataFrame, files: DataFrame) -> DataFrame:
    """path, licence, score, how ('own', 'inherited', 'none'), licence_dir and rest of every row of ``files`` (path, speaks, rest)."""
    own = files.join(found, "path", "left")
    speaking = own.where(F.col("speaks") & F.col("licence").isNotNull()).groupBy(directory(F.col("path")).alias("dir")).agg(F.min(F.struct((-F.col("score")).alias("s"), "path", "licence")).alias("b"))
    speaking = speaking.select(F.col("dir").alias("licence_dir"), F.col("b.licence").alias("dir_licence"))
    dirs = files.select(directory(F.col("path")).alias("dir")).distinct()
    parts = F.split("dir", "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    climbed = dirs.where("dir is not null").select("dir", F.explode(ancestors).alias("licence_dir")).join(speaking, "licence_dir")
    nearest = climbed.groupBy("dir").agg(F.max(F.struct(F.length("licence_dir").alias("n"), "licence_dir", "dir_licence")).alias("a"))
    nearest = materialize(nearest, "licence-directories")  # so that a large directory's files can be split in the join
    joined = own.withColumn("dir", directory(F.col("path"))).join(nearest, "dir", "left")
    how = F.when(F.col("licence").isNotNull(), "own").when(F.col("a").isNotNull(), "inherited").otherwise("none")
    return joined.select("rest", "path", F.coalesce("licence", F.col("a.dir_licence")).alias("licence"), "score", how.alias("how"), F.when(F.col("licence").isNull(), F.col("a.licence_dir")).alias("licence_dir"))


def licence_scan(files: DataFrame, speaks: Column | None = None, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """The whole scan of ``files`` (path, text, ...); ``speaks`` says which rows speak for their directory (default: by name)."""
    speaks = F.col("path").rlike(FILE_NAME) if speaks is None else speaks
    made = ("path", "licence", "score", "how", "licence_dir")
    rest = [c for c in files.columns if c.lower() not in (*made, "text")]
    packed = F.struct(*[F.col(f"`{c}`").alias(f"r{i}") for i, c in enumerate(rest)], F.lit(0).alias("_"))  # no name of theirs can clash
    found = materialize(scan(files.select("path", "text"), templates, threshold), "licences")
    out = inherit(found, files.select("path", F.coalesce(speaks, F.lit(False)).alias("speaks"), packed.alias("rest")))
    return out.select(*[F.col(f"rest.r{i}").alias(c) for i, c in enumerate(rest)], *made)


def op1_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files; one with a notice in any unit speaks for its directory.

    Most files are /source/lang/<hundreds of doc_id>/<doc_id>; the first 20 of every hundred sit in /source/lang, those of
    every fifth hundred in /source, so that directories inherit from any of their ancestors. Ids that end in 4 are
    licence files by name (LICENSE.<doc_id>), whose whole text is a unit.
    """
    docs = table(spark, sf_dir, "documents")
    part = lambda c: F.concat(F.lit("/"), F.coalesce(c.cast("string"), F.lit("_")))
    i = F.col("doc_id")
    lang = F.when(i % 500 < 20, "").otherwise(part(F.col("lang")))
    hundreds = F.when(i % 100 < 20, "").otherwise(part(F.floor(i / 100)))
    name = F.when(i % 10 == 4, F.concat(F.lit("/LICENSE."), i.cast("string"))).otherwise(part(i))
    path = F.concat(part(F.col("source")), lang, hundreds, name)
    out = licence_scan(docs.select("doc_id", path.alias("path"), "text"), F.lit(True))
    return out.select("doc_id", "path", "licence", "score", "how", "licence_dir")
