"""Licence scans: Dice coefficient over word bigrams against templates, with DataFrame functions only.

A text is lower-cased, everything but letters and digits becomes a space, and
its set of word bigrams is compared to each template's. The scanned units of a
document are the whole text and each of its lines. With |A| and |B| bigrams the
coefficient is at most 2 min(|A|, |B|) / (|A| + |B|), so a template is compared
only to units whose size lies within [|B| t / (2 - t), |B| (2 - t) / t].

Asked for, passages of the whole text are compared as well: runs of words, over
line breaks, that begin and end with a bigram of the template. A passage that
reaches the threshold shares at least |B| t / (2 - t) bigrams with the template,
so only documents with so many are looked at more closely.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import let, text_of

# fixed values: licence texts and notices, as their licensors publish them
TEMPLATES = {
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "BSD-3-Clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "Unlicense": 'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "BSL-1.0": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.',
    "LGPL": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    "CC0-1.0 (notice)": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "CC-BY-SA-4.0 (notice)": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "MIT (notice)": "Released under the MIT License.",
    "Apache-2.0 (notice)": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0 (notice)": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0 (notice)": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0 (notice)": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "BSD-3-Clause (notice)": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "MPL-2.0 (notice)": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
# the same text without its third condition
TEMPLATES["BSD-2-Clause"] = re.sub(r" 3\. Neither.*?permission\.", "", TEMPLATES["BSD-3-Clause"])


def load_templates(spark: SparkSession, folder: str) -> dict[str, str]:
    """Templates from a folder of text files, one licence each under the file's name: full texts that are not kept here."""
    rows = spark.read.text(folder, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name"), "value").collect()
    return {r.name.removesuffix(".txt"): r.value for r in sorted(rows, key=lambda r: r.name)}


def bigrams_of(text: str) -> list[str]:
    """The distinct word bigrams of a template, in order; a single word stands for itself."""
    w = re.sub(r"[^\w]|_", " ", text.lower()).split()
    return list(dict.fromkeys(map(" ".join, zip(w, w[1:], strict=False)))) if len(w) > 1 else w


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _bigrams(words: Column) -> Column:
    pairs = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.concat_ws(" ", F.get(w, i - 1), F.get(w, i)))
    return let(words, lambda w: F.when(F.size(w) < 2, w).otherwise(F.array_distinct(pairs(w))))


def _matches(bigrams: Column, templates: dict[str, list[str]], least: float) -> Column:
    """Structs (dice, license, n_common) of the templates that a unit's bigrams reach, null for the others."""

    def one(a: Column, name: str, own: list[str]) -> Column:
        low, high = math.ceil(len(own) * least / (2 - least)), math.floor(len(own) * (2 - least) / least)
        total = F.size(a) + len(own)
        reached = lambda n: F.when(2.0 * n >= least * total, F.struct((2.0 * n / total).alias("dice"), F.lit(name).alias("license")))
        return F.when(F.size(a).between(low, high), let(F.size(F.array_intersect(a, F.array(*map(F.lit, own)))), reached))

    def scored(a: Column) -> Column:
        return F.array_max(F.array(*(one(a, name, own) for name, own in templates.items())))

    return let(bigrams, scored)


def _pairs(words: Column) -> Column:
    """The word bigrams in order, repeated ones too; a single word stands for itself."""
    pairs = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.concat_ws(" ", F.get(w, i - 1), F.get(w, i)))
    return let(words, lambda w: F.when(F.size(w) < 2, w).otherwise(pairs(w)))


def _before(pairs: Column) -> Column:
    """For each place the nearest place before with the same bigram, -1 if there is none: by sorting, in n log n steps."""
    order = F.array_sort(F.transform(pairs, lambda x, i: F.struct(F.xxhash64(x).alias("h"), i.alias("i"))))
    same = lambda o, x, k: F.when((k > 0) & (F.get(o, k - 1)["h"] == x["h"]), F.get(o, k - 1)["i"]).otherwise(-1)
    back = lambda o: F.array_sort(F.transform(o, lambda x, k: F.struct(x["i"].alias("i"), same(o, x, k).alias("b"))))
    return F.transform(let(order, back), lambda x: x["b"])


def _passages(pairs: Column, templates: dict[str, str], least: float) -> Column:
    """Structs (dice, license): for each template its best passage, if that reaches it and no better one overlaps it.

    A passage holds no more repeats for its size than the template does. From a
    start, one pass over the places up to the greatest length counts what is
    new; a start is passed over, by one look at the list of hits, if so few hits
    lie within that length that it cannot beat the best passage so far.
    """
    own = {k: bigrams_of(v) for k, v in templates.items()}
    every = list(dict.fromkeys(b for v in own.values() for b in v))

    def one(p: Column, places: Column, common: Column, before: Column, name: str) -> Column:
        b = own[name]
        low, n_words = math.ceil(len(b) * least / (2 - least)), len(re.sub(r"[^\w]|_", " ", templates[name]).split())
        span = math.ceil(len(b) * (2 - least) / least * max(1, n_words - 1) / len(b))
        kind = "struct<dice:double,license:string,start:int,end:int>"
        none = F.struct(F.lit(0.0).alias("dice"), F.lit(name).alias("license"), F.lit(-1).alias("start"), F.lit(-1).alias("end"))
        # hits that a passage must hold to be better than a dice
        need = lambda dice: F.greatest(F.lit(low), F.floor(dice * len(b) / (2 - dice) + 1e-9).cast("int") + 1)

        def grown(mine: Column, start: Column) -> Column:
            """The best passage from a start: new bigrams and new hits counted place by place."""
            zero = F.struct(F.lit(0).alias("a"), F.lit(0).alias("n"), none.alias("best"))

            def step(s: Column, i: Column) -> Column:
                new, hit = (F.get(before, i) < start).cast("int"), F.get(mine, i)

                def judged(x: Column) -> Column:
                    dice = 2.0 * x["n"] / (x["a"] + len(b))
                    made = F.struct(dice.alias("dice"), F.lit(name).alias("license"), start.alias("start"), i.alias("end"))
                    return F.struct(x["a"].alias("a"), x["n"].alias("n"), F.when(hit & (2.0 * x["n"] >= least * (x["a"] + len(b))) & (dice >= s["best"]["dice"]), made).otherwise(s["best"]).cast(kind).alias("best"))

                return let(F.struct((s["a"] + new).alias("a"), (s["n"] + F.when(hit, new).otherwise(0)).alias("n")), judged)

            return F.aggregate(F.sequence(start, F.least(F.size(p), start + span) - 1), zero.cast(f"struct<a:int,n:int,best:{kind}>"), step, lambda s: s["best"])

        def best(at: Column, mine: Column) -> Column:
            def step(s: Column, k: Column) -> Column:
                start = F.get(at, k)
                worth = (s["dice"] < 1) & (F.get(at, k + need(s["dice"]) - 1) - start < span)
                return F.when(worth, let(grown(mine, start), lambda g: F.when(g["dice"] > s["dice"], g).otherwise(s))).otherwise(s)

            return F.aggregate(F.sequence(F.lit(0), F.size(at) - low), none.cast(kind), step, lambda s: F.when(s["start"] >= 0, s))

        hits = F.filter(places, lambda i: F.get(p, i).isin(*b))
        return F.when(F.size(F.array_intersect(common, F.array(*map(F.lit, b)))) >= low, let(hits, lambda at: let(F.transform(p, lambda x: x.isin(*b)), lambda mine: best(at, mine))))

    def found(p: Column) -> Column:
        """The places are looked at only where some template's bigrams are many enough for a passage."""
        enough = lambda c: reduce(lambda x, y: x | y, (F.size(F.array_intersect(c, F.array(*map(F.lit, b)))) >= math.ceil(len(b) * least / (2 - least)) for b in own.values()))
        places = F.filter(F.transform(p, lambda x, i: F.when(x.isin(*every), i)), lambda i: i.isNotNull())
        each = lambda c, at, x: F.filter(F.array(*(one(p, at, c, x, name) for name in own)), lambda m: m.isNotNull())
        return let(F.array_intersect(p, F.array(*map(F.lit, every))), lambda c: F.when(F.size(c) >= shortest, F.when(enough(c), let(places, lambda at: let(_before(p), lambda x: each(c, at, x))))))

    shortest = min(math.ceil(len(v) * least / (2 - least)) for v in own.values())
    better = lambda o, m: ((o["dice"] > m["dice"]) | ((o["dice"] == m["dice"]) & (o["license"] > m["license"]))) & (o["start"] <= m["end"]) & (m["start"] <= o["end"])
    alone = lambda f: F.transform(F.filter(f, lambda m: ~F.exists(f, lambda o: better(o, m))), lambda m: F.struct(m["dice"], m["license"]))
    return F.coalesce(let(found(pairs), alone), F.array().cast("array<struct<dice:double,license:string>>"))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, least: float = 0.8, passages: bool = False) -> DataFrame:
    """One row per input row: ``doc_id, license, dice, n_units, whole_text``.

    ``license`` is the template with the highest coefficient of at least
    ``least`` over the document's units (ties: the name that sorts last), null
    if none reaches it, and then ``dice`` is 0. ``n_units`` counts the units
    that reach a template and ``whole_text`` says whether the whole text does.
    With ``passages``, the best passage of each template that is not the licence
    of a unit, and that no better passage overlaps, is one more unit.
    Null ids stay null. Null and empty texts have no words and match nothing; a
    text without a line break is one unit. Repeated rows give repeated rows, an empty table an
    empty result; other columns are ignored.
    """
    own = {k: bigrams_of(v) for k, v in (TEMPLATES if templates is None else templates).items()}
    own = {k: v for k, v in own.items() if v}
    text = text_of(docs, text_col)
    kind = "struct<dice:double,license:string>"
    none = F.lit(None).cast(kind)
    best = lambda unit: _matches(_bigrams(_words(unit)), own, least) if own else none
    # n bigrams take at least 2 n characters
    shortest = min((math.ceil(len(v) * least / (2 - least)) for v in own.values()), default=1)
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(x) >= 2 * shortest)
    by_line = let(lines, lambda x: F.when(F.size(x) == 0, F.array().cast(f"array<{kind}>")).otherwise(F.filter(F.transform(x, best), lambda m: m.isNotNull())))
    kinds = f"array<{kind}>"
    if own and passages:
        kept = {k: v for k, v in (TEMPLATES if templates is None else templates).items() if k in own}
        both = lambda p: F.struct(_matches(F.array_distinct(p), own, least).alias("all"), _passages(p, kept, least).alias("passages"))
        whole = let(_pairs(_words(text)), both)
    else:
        whole = F.struct(best(text).alias("all"), F.array().cast(kinds).alias("passages"))
    d = docs.select(docs[id_col].cast("bigint").alias("doc_id"), whole.alias("_whole"), F.when(F.instr(text, "\n") > 0, by_line).otherwise(F.array().cast(f"array<{kind}>")).alias("_lines"))
    d = d.select("doc_id", F.col("_whole.all").alias("_all"), "_lines", F.col("_whole.passages").alias("_found"))
    if passages:
        more = F.filter("_found", lambda m: ~F.exists(F.concat("_lines", F.array("_all")), lambda u: F.coalesce(u["license"] == m["license"], F.lit(False))))
        d = d.withColumn("_lines", F.concat("_lines", F.when(F.size("_found") > 0, more).otherwise(F.col("_found"))))
    top = F.array_max(F.concat("_lines", F.array("_all")))
    d = d.select("doc_id", top.alias("_top"), (F.size("_lines") + F.col("_all").isNotNull().cast("int")).alias("n_units"), F.col("_all").isNotNull().alias("whole_text"))
    return d.select("doc_id", F.col("_top.license").alias("license"), F.coalesce("_top.dice", F.lit(0.0)).alias("dice"), F.col("n_units").cast("bigint").alias("n_units"), "whole_text")
