"""Licence scan: a sparse n-gram logistic regression over paragraphs, confirmed by comparison with templates. DataFrame functions on the main path."""

from __future__ import annotations

import json
import math
import random
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Usual short notices and paragraphs of public licence texts, by family. (c) lines and names are left out.
NOTICES: dict[str, tuple[str, ...]] = {
    "apache": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Licensed under the Apache License, Version 2.0.",
        "Released under Apache 2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "SPDX-License-Identifier: Apache-2.0",
        "Apache License Version 2.0, January 2004",
    ),
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "SPDX-License-Identifier: MIT",
        "The MIT License (MIT)",
    ),
    "gpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
        "This work is licensed under the GNU General Public License, version 3.",
        "Code under GPL-3.0 or later",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "SPDX-License-Identifier: GPL-2.0-only",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    ),
    "lgpl": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
        "Licensed under the LGPL, version 2.1 or later.",
        "Licensed under the LGPL, version 3.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    ),
    "agpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
        "Licensed under the AGPL, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
        "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
        "Licensed under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "SPDX-License-Identifier: BSD-2-Clause",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
        "Released under the ISC License.",
        "SPDX-License-Identifier: ISC",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "MPL-2.0",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "epl": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
        "Licensed under the Eclipse Public License, version 2.0.",
        "SPDX-License-Identifier: EPL-2.0",
    ),
    "cc-by": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ),
    "cc-by-sa": (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ),
    "cc-by-nc": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ),
    "public-domain": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "This work is dedicated to the public domain under CC0 1.0.",
        "Dedicated under CC0 1.0",
        "SPDX-License-Identifier: CC0-1.0",
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "Released under the Unlicense License.",
        "SPDX-License-Identifier: Unlicense",
    ),
}
# Licence texts of no family above, and sentences with licence words that name no licence. They calibrate the unknown class.
OTHERS = (
    "All rights reserved.",
    "Copyright of the author.",
    "The driver was asked to show a driving licence and gave his name.",
    "The permission of the owner is required to enter the garden.",
    "The public was free to use the source of water under certain conditions.",
    "A license plate was found along with this work.",
    "The warranty of the machine covers any kind of copy.",
    "She was granted a licence to sell in the public market.",
    "Version 2 of the program was released in January.",
    "The general agreed to the terms in writing.",
    "You may not use this room without permission.",
    "Copyright of the photograph belongs to the museum.",
    "The work is the property of the foundation.",
    "Released under the Foo License.",
    "Licensed under the Bar Public License, version 1.0.",
    "This project is licensed under the terms of our commercial license.",
    "Released under the WTFPL.",
    "Licensed under the Artistic License 2.0.",
    "Licensed under the European Union Public Licence.",
    "SPDX-License-Identifier: LicenseRef-Proprietary",
    "SPDX-License-Identifier: Zlib",
    "SPDX-License-Identifier: Artistic-2.0",
    "Distributed under the Boost Software License, Version 1.0.",
    "This software is provided as is without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely.",
    "This software is licensed, not sold. You may not reverse engineer, decompile or disassemble the software.",
    "Use of this file is governed by the license agreement between you and the vendor.",
)
# Licences of no family above that training never sees; the share of them taken for a family sets the least probability.
HELD_OUT = (
    "Licensed under the Common Development and Distribution License, version 1.1.",
    "Licensed under the Open Software License, version 3.0.",
    "SPDX-License-Identifier: OFL-1.1",
    "SPDX-License-Identifier: PostgreSQL",
    "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
    "MIT-like Foo License",
    "Released under the Academic Free License.",
    "Licensed under the Microsoft Public License.",
    "This work is licensed under the Open Data Commons Attribution License.",
    "Licensed under the Python Software Foundation License.",
    "Licensed for internal use only under the terms of the master agreement.",
    "Released under the Beerware License.",
)
#: A paragraph of unknown class counts as a licence of unknown family if it has one of these.
TRIGGER = r"(?i)licen[sc]|copyright|warrant|permission|permitted|redistribut|public domain|spdx|\bgnu\b|\bcc[ -]?by|creative commons"
_WORD = "[^a-z0-9]+"
#: Names that tell families apart: a template with some of them confirms only a paragraph with the same ones.
_NAMES = ("apache", "mit", "bsd", "isc", "gnu", "gpl", "lgpl", "agpl", "lesser", "affero", "mozilla", "mpl", "eclipse", "epl", "cc0", "commons", "sharealike", "sa", "noncommercial", "nc", "unlicense")
# Words of all prose; an n-gram of these alone carries no weight.
_COMMON = frozenset("a an and any are as at be by for from have if in is it its not of on or that the these this to was which will with you your".split())
#: Weights under this are not kept, so that the score is sparse.
LEAST_WEIGHT = 0.25


def _words(text: str) -> list[str]:
    return [w for w in re.split(_WORD, text.lower()) if w]


def _grams(words: list[str]) -> list[str]:
    """Words and word pairs, each once, in order."""
    return list(dict.fromkeys([*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))]))


def _soft(z: list[float]) -> list[float]:
    e = [math.exp(x - max(z)) for x in z]
    return [x / sum(e) for x in e]


class Model:
    """Weights of each n-gram by class (families, then unknown), biases, temperature, least probability of a family."""

    def __init__(self, weight: dict[str, list[float]], bias: list[float], heat: float, sure: float):
        self.weight, self.bias, self.heat, self.sure = weight, bias, heat, sure
        self.names = [*NOTICES, "unknown"]

    def probabilities(self, words: list[str]) -> list[float]:
        """Of each class; n-grams without weights count for nothing."""
        return self.of_grams(_grams(words))

    def of_grams(self, grams: list[str]) -> list[float]:
        own = [self.weight[g] for g in grams if g in self.weight]
        n = math.sqrt(max(1, len(own)))
        return _soft([(b + sum(w[k] for w in own) / n) / self.heat for k, b in enumerate(self.bias)])


def train(seed: int = 5, copies: int = 16, epochs: int = 16, rate: float = 0.6, l2: float = 1e-3) -> Model:
    """Fits the classes to the notices, with words dropped, strange words added and cut at their ends, and to the texts of no family.

    Every fourth example stays out of the fit and sets the temperature, so that probabilities are calibrated. The least probability of a family is
    the least one in steps of 0.05, from 0.5 on, at which under one in ten of the held-out licences of other families counts as one of ours.
    """
    rng = random.Random(seed)
    noise = [rng.choice("bcdfglmnprst") + rng.choice("aeiou") + rng.choice(["n", "r", "st", "nd", "l"]) for _ in range(300)]
    rows: list[tuple[list[str], int]] = []
    for k, texts in enumerate([*NOTICES.values(), OTHERS]):
        for text in texts:
            words = _words(text)
            for c in range(copies):
                own = [w for w in words if c == 0 or len(words) < 5 or rng.random() > 0.08]
                if c % 4 == 3 and len(own) > 24:  # a part of a wrapped notice
                    lo = rng.randint(0, len(own) - 16)
                    own = own[lo : lo + rng.randint(12, 40)]
                at = rng.choice([0, len(own)])
                rows.append((_grams(own[:at] + rng.sample(noise, rng.randint(0, 6) if c else 0) + own[at:]), k))
    rows += [(_grams(rng.sample(noise, rng.randint(3, 30))), len(NOTICES)) for _ in range(12 * copies)]
    known = {g for texts in NOTICES.values() for t in texts for g in _grams(_words(t)) if not _COMMON.issuperset(g.split(" "))}
    rows = [([g for g in own if g in known], k) for own, k in rows]
    count = len(NOTICES) + 1
    weight = {g: [0.0] * count for g in sorted(known)}
    bias = [0.0] * (count - 1) + [1.0]
    fit, held = [r for i, r in enumerate(rows) if i % 4], rows[::4]
    for epoch in range(epochs):
        rng.shuffle(fit)
        step = rate / (1 + epoch / 6)
        for own, y in fit:
            n = math.sqrt(max(1, len(own)))
            vectors = [weight[x] for x in own]
            for k, p in enumerate(_soft([b + sum(v[k] for v in vectors) / n for k, b in enumerate(bias)])):
                g = step * (p - (k == y))
                bias[k] -= 0.1 * g
                if abs(g) > 1e-4:
                    for v in vectors:
                        v[k] -= g / n + step * l2 * v[k]
    weight = {g: w for g, w in weight.items() if max(map(abs, w)) >= LEAST_WEIGHT}
    out = Model(weight, bias, 1.0, 0.5)
    best = []
    for heat in (0.5, 0.7, 1.0, 1.4, 2.0):
        out.heat = heat
        best.append((sum(-math.log(max(1e-12, out.of_grams(own)[y])) for own, y in held), heat))
    out.heat = min(best)[1]
    wrong = sorted(max(out.probabilities(_words(t))[:-1]) for t in HELD_OUT)
    out.sure = next((s / 100 for s in range(50, 96, 5) if sum(p >= s / 100 for p in wrong) < len(wrong) / 10), 0.95)
    return out


_MODEL: list[Model] = []


def model() -> Model:
    if not _MODEL:
        _MODEL.append(train())
    return _MODEL[0]


def _grams_of(words: Column) -> Column:
    pairs = F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.concat_ws(" ", F.element_at(words, i), F.element_at(words, i + 1)))
    return F.array_distinct(F.concat(words, F.when(F.size(words) > 1, pairs).otherwise(F.array().cast("array<string>"))))


#: The least share of a template's words that a confirmed paragraph has, or of the paragraph's words that the template has.
CONFIRM = 0.75


def paragraphs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, key, at, words, trigger): the paragraphs with a weighted word of the model or a trigger word; at is the paragraph's number in its document.

    A paragraph is a block of lines up to an empty line; so that a notice which stands on a line of its own is no part of the prose around it, every line of
    a block of lines that end in a full stop is one. Others have the score of no n-gram at all, which is unknown, and no licence word: they count for nothing.
    """
    vocabulary = sorted({w for g in model().weight for w in g.split(" ")} - _COMMON)
    read = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    blocks = F.split(F.regexp_replace("text", r"(?<=[.:!?\"])[ \t\r]*\n", "\n\n"), r"\n[ \t\r]*\n\s*")
    each = F.transform(blocks, lambda p: F.struct(p.rlike(TRIGGER).alias("trigger"), F.filter(F.split(F.lower(p), _WORD), lambda w: w != "").alias("words")))
    lines = read.select("id", F.xxhash64("text").alias("key"), F.posexplode(each).alias("at", "p")).select("id", "key", "at", "p.words", "p.trigger")
    return lines.where(F.col("trigger") | F.exists("words", lambda w: w.isin(vocabulary))).distinct()


def _inline(spark: SparkSession, rows: list[dict], ddl: str) -> DataFrame:
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{ddl}>>")))


def classify(lines: DataFrame, sure: float | None = None, confirm: float = CONFIRM) -> DataFrame:
    """(id, key, at, trigger, family, probability, overlap): the most likely class of each paragraph, of equally likely ones the last in name.

    It is unknown unless its probability is `sure` or more (the model's own least probability by default) and a template of the family confirms it: the two share
    `confirm` of the template's words, or of the paragraph's where that is the shorter, and the family names among the template's words are the paragraph's.
    """
    m = model()
    spark = lines.sparkSession
    sure = m.sure if sure is None else sure
    known = _inline(spark, [{"gram": g, "w": w} for g, w in m.weight.items()], "gram:string,w:array<double>")
    hits = F.filter(_grams_of(F.col("words")), lambda g: g.isin(sorted(m.weight)))
    each = lines.select("id", "key", "at", F.explode_outer(hits).alias("gram")).join(F.broadcast(known), "gram", "left")
    totals = each.groupBy("id", "key", "at").agg(F.greatest(F.count("w"), F.lit(1)).alias("n"), *(F.coalesce(F.sum(F.col("w")[k]), F.lit(0.0)).alias(f"s{k}") for k in range(len(m.names))))
    z = [(F.lit(m.bias[k]) + F.col(f"s{k}") / F.sqrt("n")) / m.heat for k in range(len(m.names))]
    top = F.greatest(*z)
    classes = F.array(*(F.struct(F.exp(x - top).alias("e"), F.lit(name).alias("family")) for x, name in zip(z, m.names)))
    scored = totals.select("id", "key", "at", F.array_max(classes).alias("best"), F.aggregate(classes, F.lit(0.0), lambda acc, c: acc + c["e"]).alias("all"))
    scored = scored.select("id", "key", "at", F.col("best.family").alias("guess"), (F.col("best.e") / F.col("all")).alias("probability"))
    notices = _inline(spark, [{"guess": k, "t": sorted(set(_words(t)))} for k, texts in NOTICES.items() for t in texts], "guess:string,t:array<string>")
    notices = notices.groupBy("guess").agg(F.collect_list("t").alias("templates"))
    both = scored.join(lines, scored["id"].eqNullSafe(lines["id"]) & (scored["key"] == lines["key"]) & (scored["at"] == lines["at"])).select(scored["id"], scored["key"], scored["at"], "trigger", "guess", "probability", F.array_distinct("words").alias("words"))
    both = both.join(F.broadcast(notices), "guess", "left")
    names = F.array(*map(F.lit, _NAMES))
    same = F.filter("templates", lambda t: F.size(F.array_except(F.array_intersect(t, names), F.col("words"))) == 0)
    overlap = F.array_max(F.transform(same, lambda t: F.size(F.array_intersect(t, F.col("words"))) / F.least(F.size(t), F.size(F.col("words")))))
    both = both.withColumn("overlap", F.coalesce(overlap, F.lit(0.0)))
    good = (F.col("guess") != "unknown") & (F.col("probability") >= sure) & (F.col("overlap") >= confirm)
    return both.select("id", "key", "at", "trigger", F.when(good, F.col("guess")).otherwise(F.lit("unknown")).alias("family"), "probability", "overlap")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, families (sorted, comma-joined; empty without a licence), n_licence and n_unknown (paragraphs with a
    confirmed family, and with licence words but none), probability (the most certain family's, null without one).

    Null and empty texts have none. Rows with equal ids and texts get equal results and stay separate; a null id stays null.
    Other columns are ignored; an empty table gives no rows. The n-gram and template tables have the size of the fixed notices, so their broadcasts do not grow.
    """
    found = classify(paragraphs(docs, id_col, text_col))
    hit = F.col("family") != "unknown"
    per = found.groupBy("id", "key").agg(
        F.array_join(F.array_sort(F.collect_set(F.when(hit, F.col("family")))), ",").alias("families"),
        F.count_if(hit).alias("n_licence"),
        F.count_if(~hit & F.col("trigger")).alias("n_unknown"),
        F.max(F.when(hit, F.round("probability", 6))).alias("probability"),
    )
    per = per.select(F.col("id").alias("found_id"), F.col("key").alias("found_key"), "families", "n_licence", "n_unknown", "probability")
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("key"))
    out = rows.join(per, rows["id"].eqNullSafe(F.col("found_id")) & (rows["key"] == F.col("found_key")), "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("families", F.lit("")).alias("families"), F.coalesce("n_licence", F.lit(0)).alias("n_licence"), F.coalesce("n_unknown", F.lit(0)).alias("n_unknown"), "probability")
