"""Operator 1: licence notices in documents, by MinHash bands over text windows and exact containment.

Templates (TEMPLATES: notices, SPDX lines and whole licence texts) are sets of five-word shingles (the whole sequence where
they are shorter); words are runs of letters and digits, lower-cased. A template of up to `WHOLE` words is one window; a
longer one is a row of windows of `WINDOW` words that share four words with the next, so that each shingle lies in one of
them. Over the texts slide windows of each such length; a window's MinHash values, in `BANDS` bands of two, retrieve the
template windows that agree in a band, and the exact share of shingles decides: a short template is there if its window
contains `share` (0.8) of it. Of a long one with 0.8 of its shingles some window keeps `part` (0.75); the stretch about the
place that follows for the template is then held against all of the template's shingles, of which it must contain `share`.
A window with 0.75 of an equally long one has a Jaccard similarity of 0.6 or more, so a band of the 16 agrees with odds of
0.999 (0.9999 at 0.8); equal windows always agree.

Anchors keep windows few. For each template window words are chosen whose shingles are more than a text's window may lack;
one that contains enough must hold one of them. So only windows around anchors are hashed, which loses nothing, and as
windows are short whatever the licence's length, an anchor costs at most `WHOLE` of them.

DataFrame functions only. The templates' table is a constant, so broadcasting it is bounded. Documents with an anchor are
written once, as words; the exchanges are those of the matches. A very common notice only makes more rows.

Null and empty texts match nothing; rows with equal ids are merged per licence, null ids too; of several places the one
with the highest containment, then the first, is given; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import collections
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import ship, stash

# fixed values: wordings by which licences are commonly granted
NOTICES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-or-later", "it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0-or-later", "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("all-rights-reserved", "All rights reserved."),
)
# fixed values: licence identifiers as source files name them in a line
SPDX = ("MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "MPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-or-later", "AGPL-3.0-only", "CC0-1.0", "Unlicense", "Zlib", "EPL-2.0")

# fixed values: licence texts and the notices of longer licences, without their copyright lines
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. ",
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. ",
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
)
TEXTS = (
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    ("BSD-2-Clause", _BSD[0] + _BSD[2]),
    ("BSD-3-Clause", "".join(_BSD)),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    ),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    (
        "GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. "
        "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    ),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. "
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. "
        "We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
    ),
)
TEMPLATES = (*NOTICES, *((name, f"SPDX-License-Identifier: {name}") for name in SPDX), *TEXTS)
SHINGLE, BANDS, ROWS = 5, 16, 2
SHARE, PART = 0.8, 0.75
#: Words of the longest template that is one window, and of the windows of longer ones.
WHOLE, WINDOW = 48, 24


def settled(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once a row: the optimizer would copy it into every use, also inside lambdas."""
    return df.withColumn(name, F.explode(F.array(value)))


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda w: w != "")


def _words(text: str) -> list[str]:
    return [w for w in re.split(r"[\W_]+", text.lower()) if w]


def windows_of(given: tuple = TEMPLATES, share: float = SHARE) -> list[tuple[int, int | None, list[str], float]]:
    """(template, the window's first word there or None for a whole template, its words, the share to be found)."""
    out: list[tuple[int, int | None, list[str], float]] = []
    for i, (_, text) in enumerate(given):
        words = _words(text)
        if len(words) <= WHOLE:
            out.append((i, None, words, share))
        else:
            out += [(i, at, words[at : at + WINDOW], PART) for at in range(0, len(words) - WINDOW + 1, WINDOW - SHINGLE + 1)]
    return out


def anchors(words: list[str], share: float, common: dict[str, int]) -> list[str]:
    """Words that over (1 - share) of the window's shingles hold one of; longer ones of few windows first."""
    n = min(SHINGLE, len(words))
    left = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}
    spare, found = share * len(left), []
    for w in sorted(set(words), key=lambda w: (len(w) < 6, common[w], -len(w), w)):
        if len(left) < spare:
            break
        if any(w in s for s in left):
            found.append(w)
            left = {s for s in left if w not in s}
    return found


def shingles_of(words: Column) -> Column:
    whole = F.array(F.array_join(words, " "))
    cut = F.transform(F.sequence(F.lit(1), F.size(words) - F.lit(SHINGLE - 1)), lambda i: F.array_join(F.slice(words, i, SHINGLE), " "))
    return F.array_distinct(F.when(F.size(words) >= SHINGLE, cut).otherwise(whole))


def hashes_of(shingles: Column) -> Column:
    return F.transform(shingles, lambda s: F.xxhash64(s))


def bands_of(hashes: Column) -> Column:
    """Keys of the bands of MinHash values: the k-th value is the least of the hashes, hashed again with k."""

    def least_of(k: int) -> Column:
        return F.array_min(F.transform(hashes, lambda h: F.xxhash64(F.lit(k), h)))

    least = [least_of(k) for k in range(BANDS * ROWS)]
    return F.array(*[F.xxhash64(F.lit(b), *least[b * ROWS : (b + 1) * ROWS]) for b in range(BANDS)])


def template_windows(spark: SparkSession, given: tuple = TEMPLATES, share: float = SHARE) -> DataFrame:
    """template, license_id, at, m (words), least, wanted (shingles), bands: a constant table."""
    rows = [(i, given[i][0], at, words, least) for i, at, words, least in windows_of(given, share)]
    table = spark.createDataFrame(rows, "template int, license_id string, at int, w array<string>, least double")
    table = settled(table, "wanted", shingles_of(F.col("w")))
    table = settled(table, "hashes", hashes_of(F.col("wanted")))
    return table.select("template", "license_id", "at", F.size("w").alias("m"), "least", "wanted", bands_of(F.col("hashes")).alias("bands"))


def long_templates(spark: SparkSession, given: tuple = TEMPLATES) -> DataFrame:
    """template, license_id, words, slack (by which places are rounded and stretches widened), whole (shingles)."""
    rows = [(i, name, words, slack_of(len(words))) for i, (name, text) in enumerate(given) if len(words := _words(text)) > WHOLE]
    return spark.createDataFrame(rows, "template int, license_id string, w array<string>, slack int").select("template", "license_id", F.size("w").alias("words"), "slack", shingles_of(F.col("w")).alias("whole"))


def slack_of(words: int) -> int:
    return max(8, words // 8)


def _starts(m: int, words: list[str]) -> Column:
    """Where windows of m words begin that hold one of the words, from the columns w (words) and hit (anchors' places)."""
    last = F.size("w") - F.lit(m - 1)  # the last window's first word
    near = F.filter(F.col("hit"), lambda i: F.element_at("w", i).isin(words) & (last >= 1))
    runs = F.transform(near, lambda i: F.sequence(F.greatest(F.least(i, last) - F.lit(m - 1), F.lit(1)), F.least(i, last)))
    return F.transform(F.array_distinct(F.flatten(runs)), lambda i: F.struct(F.lit(m).alias("m"), i.alias("first")))


def license_matches(docs: DataFrame, given: tuple = TEMPLATES, share: float = SHARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, license_id, containment, first_word (of the window or stretch), n_words (its length): a row per document and licence."""
    spark = docs.sparkSession
    ship(spark)
    every_window, common, by_length = windows_of(given, share), collections.Counter(), {}
    for _, _, words, _ in every_window:
        common.update(set(words))
    for _, _, words, least in every_window:
        by_length.setdefault(len(words), set()).update(anchors(words, least, common))
    every = sorted(set().union(*by_length.values()))
    gate = "(?<![\\p{L}\\p{N}])(" + "|".join(re.escape(a) for a in every) + ")(?![\\p{L}\\p{N}])"
    # a cheap look at the text before it is cut into words: an anchor must be in it somewhere
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.lower("text").rlike(gate))
    rows = settled(rows, "w", words_of(F.col("text"))).select("id", "w")
    hits = settled(rows, "hit", F.filter(F.transform(F.col("w"), lambda w, i: F.when(w.isin(every), i + 1)), lambda i: i.isNotNull())).where(F.size("hit") > 0)
    hits = stash(hits.withColumn("row", F.monotonically_increasing_id()), "license-rows")
    starts = F.array(*[_starts(m, sorted(words)) for m, words in sorted(by_length.items())])
    windows = hits.withColumn("here", F.explode(F.flatten(starts))).select("id", "row", "w", F.col("here.m").alias("m"), F.col("here.first").alias("first"))
    windows = settled(windows, "win", F.slice("w", F.col("first"), F.col("m"))).select("id", "row", "m", "first", "win")
    windows = settled(windows, "shingles", shingles_of(F.col("win"))).select("id", "row", "m", "first", "shingles")
    windows = settled(windows, "hashes", hashes_of(F.col("shingles"))).withColumn("band", F.explode(bands_of(F.col("hashes")))).select("id", "row", "m", "first", "shingles", "band")
    wanted = F.broadcast(template_windows(spark, given, share).withColumn("band", F.explode("bands")).drop("bands"))
    # the band's index is part of its hash, so equal keys are equal bands
    met = windows.join(wanted, ["m", "band"]).withColumn("containment", F.size(F.array_intersect("shingles", "wanted")) / F.size("wanted"))
    kept = stash(met.where(F.col("containment") >= F.col("least")).select("id", "row", "template", "license_id", "at", "m", "first", "containment"), "license-windows")
    short = kept.where("at is null").select("id", "license_id", "containment", "first", "m")
    # places of long templates, rounded; each stretch is held against the whole template
    long = F.broadcast(long_templates(spark, given))
    places = kept.where("at is not null").select("row", "template", "first", "at").join(long, "template").select("row", "template", F.floor((F.col("first") - 1 - F.col("at")) / F.col("slack")).cast("int").alias("q")).distinct()
    near = places.join(hits.select("id", "row", "w"), "row").join(long, "template")
    begin = F.greatest((F.col("q") - 1) * F.col("slack") + 1, F.lit(1))
    near = near.withColumn("first", begin).withColumn("m", F.least(F.size("w"), (F.col("q") + 2) * F.col("slack") + F.col("words")) - begin + 1)
    near = settled(near, "shingles", shingles_of(F.slice("w", F.col("first"), F.col("m")))).withColumn("containment", F.size(F.array_intersect("shingles", "whole")) / F.size("whole"))
    every_match = short.union(near.where(F.col("containment") >= share).select("id", "license_id", "containment", "first", "m"))
    best = every_match.groupBy("id", "license_id").agg(F.max(F.struct("containment", (-F.col("first")).alias("first"), "m")).alias("b"))
    return best.select(F.col("id").alias(id_col), "license_id", F.col("b.containment").alias("containment"), (-F.col("b.first") - 1).alias("first_word"), F.col("b.m").alias("n_words"))
