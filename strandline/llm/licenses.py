"""Licence notices in texts, found by a trained paragraph classifier.

A text's paragraphs are split at blank lines, so wrapped lines belong together. A paragraph that
holds an anchor, one of the words without which no line or so of the training texts of licences does, is cut
into its word n-grams; those that the model knows mark stretches, which end where several words
in a row say nothing. Each stretch is classified.

The classifier is a multinomial logistic regression on sparse word n-grams, trained here on the
paragraphs of licence texts and on notices, whole and in parts, into licence families, an unknown
licence, and no licence. Probabilities are calibrated by a temperature on texts that training has
not seen, and what is a licence but no family's with enough confidence is unknown. A family is
confirmed when enough of the n-grams of one of its paragraphs stand in the stretch.

The scan uses only DataFrame functions. Weights are whole thousandths, so sums are exact.
"""

from __future__ import annotations

import functools
import re

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import text_or_empty

#: Notices by which the families are known.
NOTICES: dict[str, tuple[str, ...]] = {
    "mit": (
        "Released under the MIT License.", "Licensed under the MIT license.", "This project is licensed under the terms of the MIT license.", "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Released under the Apache 2.0 license.", "SPDX-License-Identifier: Apache-2.0"),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "Released under the GPL v3.", "Licensed under the GNU GPL version 2 or later.", "SPDX-License-Identifier: GPL-3.0-or-later"),
    "lgpl": ("Licensed under the GNU Lesser General Public License, version 2.1.", "Released under the LGPL.", "SPDX-License-Identifier: LGPL-2.1-only"),
    "agpl": ("Licensed under the GNU Affero General Public License, version 3.", "Released under the AGPL v3.", "SPDX-License-Identifier: AGPL-3.0-only"),
    "bsd": (
        "Released under the BSD 3-Clause License.", "Licensed under the BSD license.", "SPDX-License-Identifier: BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    "mpl-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0"),
    "cc-by": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under the Creative Commons Attribution license."),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Text is available under the Creative Commons Attribution-ShareAlike License."),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC-SA 4.0."),
    "cc0": ("Released under CC0 1.0.", "To the extent possible under law, the author has waived all copyright under CC0 1.0 Universal.", "Dedicated to the public domain under the Creative Commons CC0 license."),
    "isc": ("Released under the ISC License.", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted.", "SPDX-License-Identifier: ISC"),
    "proprietary": ("All rights reserved.", "All rights reserved. Unauthorized copying of this file is strictly prohibited.", "This software is proprietary and confidential and may not be licensed without permission.", "Copyright, all rights reserved."),
    "unknown": (
        "Licensed under the Example Community License, version 1.", "Released under the terms of the Acme Open License.", "This work is licensed under the Northwind Data License.", "Licensed under our own license.",
        "This file is distributed under a custom license.", "Use is governed by the license agreement.", "SPDX-License-Identifier: LicenseRef-Custom", "See the LICENSE file for the license terms.", "Released under the Contoso Source License 2.0.", "Licensed under the Eclipse Public License.", "Licensed under the European Union Public License, version 1.2."),
    "none": (
        "He lost his driver license near the station.", "The license plate of the car was blue.", "They granted permission to enter the building.", "She may not use this road in winter.", "Copyright is a topic of this course.",
        "The public domain of mathematics is large.", "The apache tribe lived in the mountains.", "mit freundlichen und der die das.", "He works at mit in boston.", "The mozilla browser opened the page.", "An artistic license was taken in the film.",
        "The warranty of the car ended.", "The gpl meeting was at noon.", "The bsd conference starts on Monday.", "The committee granted a fishing license to the village.", "We reserved all rooms of the hotel.", "isc and cc were letters on the wall."),
}
#: The paragraphs of licence texts.
_WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_GNU = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {} for more details.",
    "You should have received a copy of the GNU {} along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "GNU {}, Version 3, 29 June 2007. Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.")
TEXTS: dict[str, tuple[str, ...]] = {
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", _WARRANTY),
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
        "Grant of Patent License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable patent license to make, have made, use, offer to sell, sell, import, and otherwise transfer the Work"),
    "gpl": tuple(x.format("General Public License") for x in _GNU),
    "lgpl": tuple(x.replace("program", "library").format("Lesser General Public License") for x in _GNU),
    "agpl": tuple(x.format("Affero General Public License") for x in _GNU),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "This Source Code Form is \"Incompatible With Secondary Licenses\", as defined by the Mozilla Public License, v. 2.0."),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    "cc-by": ("This work is licensed under the Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA.",),
    "cc-by-sa": ("This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-sa/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA.",),
    "cc-by-nc": ("This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-nc/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA.",),
    "cc0": ("To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work. You should have received a copy of the CC0 legalcode along with this work. If not, see http://creativecommons.org/publicdomain/zero/1.0/.",),
    "unknown": (
        "Permission is granted to anyone to use this material under the terms of the community agreement that comes with it, as long as its name is kept.",
        "This data set is made available under the terms of use of the institute. Copies may be made for teaching only. All other uses need a license of the institute.",
        "The contents of this archive are licensed to members of the society under its own terms, which are found in the file LICENSE.txt."),
}
#: Short identifiers of families.
IDENTIFIERS = {
    "mit": ("MIT",), "apache-2.0": ("Apache-2.0",), "gpl": ("GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "GPL-3.0"), "lgpl": ("LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later"),
    "agpl": ("AGPL-3.0-only", "AGPL-3.0-or-later"), "bsd": ("BSD-2-Clause", "BSD-3-Clause"), "mpl-2.0": ("MPL-2.0",), "cc-by": ("CC-BY-4.0",), "cc-by-sa": ("CC-BY-SA-4.0",), "cc-by-nc": ("CC-BY-NC-4.0", "CC-BY-NC-SA-4.0"), "cc0": ("CC0-1.0",), "isc": ("ISC",),
    "unknown": ("LicenseRef-Custom", "EPL-2.0", "EUPL-1.2"),
}
#: Texts on which probabilities are calibrated; none is part of a training text.
CALIBRATION: dict[str, tuple[str, ...]] = {
    "mit": ("The code in this repository may be used under the MIT license.", "MIT License. Copyright (c) 2019 The Authors."),
    "apache-2.0": ("This library is made available under version 2.0 of the Apache License.", "Distributed under the Apache 2.0 license, see LICENSE."),
    "gpl": ("You may copy this under the GNU General Public License version 2.", "Published under the GPLv3, a copy of which is enclosed. GPL-3.0-only"),
    "lgpl": ("The library may be linked under the GNU Lesser General Public License.", "Its licence is the LGPL, version 3."),
    "agpl": ("The server is covered by the GNU Affero General Public License.", "It is offered under the AGPL only."),
    "bsd": ("This is distributed under the BSD 2-Clause License.", "Source code is under a BSD license; redistributions of source code must retain this notice."),
    "mpl-2.0": ("The files are covered by the Mozilla Public License 2.0.",), "cc-by": ("The figures are available under Creative Commons Attribution 4.0.",), "cc-by-sa": ("Articles are released under the Creative Commons Attribution-ShareAlike 3.0 license.",),
    "cc-by-nc": ("Photographs may be shared under Creative Commons Attribution-NonCommercial terms.",), "cc0": ("The table was released into the public domain under CC0.",), "isc": ("The tool is available under the ISC license.",),
    "proprietary": ("Copyright 2020 The Company. All rights reserved.", "Proprietary and confidential. Unauthorized copying is prohibited."),
    "unknown": ("Released under the Fabrikam Shared License 3.", "The text is licensed under terms that the publisher sets.", "Use of the data requires a license agreement."),
    "none": ("The hunter showed his fishing license to the ranger.", "A copy of the letter was sent to the software department.", "Her work in the public domain of the city won her many friends.", "The following conditions are met by most of the rivers.", "They went home without any warranty card for the fridge.",
             "The driver had no licence with him when the car was stopped.", "Er kam mit dem Zug und ging mit seiner Mutter nach Hause.", "The general opened the public library in the spring.", "The names of the copyright lawyers were in the paper.", "The author is known for his short stories about the sea."),
}
CLASSES = tuple(NOTICES)
FAMILIES = tuple(c for c in CLASSES if c not in ("unknown", "none"))
#: Words that name a licence by themselves.
NAMING = frozenset("licensed license licenses licence gpl lgpl agpl apache mozilla bsd isc mpl cc0 cc creative commons affero gnu proprietary confidential unauthorized reserved mit".split())
#: N-grams of these words alone say nothing.
STOP = frozenset("a an and any are as at be been but by can for from had has have he her his if in is it its may no not of on one or other our out she so that the their them they this to under up use used was we were which who will with you your "
                 "der die das und mit von zu den ein eine ist im in auf de la le les et un une des est en que el los las y con por para del s t v 1 2 3 4 0".split())
WORD = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
BLANK = r"\n[ \t\r\x0b\x0c]*\n"
UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words in a row that say nothing end a stretch.
GAP = 8
SCALE = 1000
#: Least probability of a confirmed family, of an unconfirmed one, and of no licence; share of a paragraph's n-grams that confirms.
CONFIDENT, ALONE, NONE, CONFIRMED = 0.6, 0.9, 0.3, 0.7


def words(text: str) -> list[str]:
    return re.findall(WORD, text.lower())


def grams(w: list[str]) -> list[str]:
    return [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def _says(gram: str) -> bool:
    return not all(x in STOP for x in gram.split())


def _told(w: list[str]) -> set[str]:
    return set(filter(_says, grams(w)))


class Model:
    """Weights (whole thousandths) per n-gram and class, biases, temperature, paragraphs' n-grams, anchors."""

    def __init__(self, seed: int = 4, rounds: int = 700, most: int = 2600):
        rng = np.random.RandomState(seed)
        sources = [(y, words(x)) for y, c in enumerate(CLASSES) for x in (*NOTICES[c], *TEXTS.get(c, ()), *(f"SPDX-License-Identifier: {i}" for i in IDENTIFIERS.get(c, ())), *IDENTIFIERS.get(c, ()))]

        def part(w: list[str]) -> list[str]:
            """A stretch of some lines of a text, with a word lost here and there."""
            n = len(w)
            k = n if n < 8 else rng.randint(min(n, 7), n + 1) if rng.rand() < 0.5 else rng.randint(min(n, 7), min(n, 24) + 1)
            at = rng.randint(n - k + 1)
            return [x for x in w[at : at + k] if n < 8 or rng.rand() > 0.03]

        rows = [(_told(part(w) if k else w), y) for y, w in sources for k in range(60 if len(w) >= 24 else 25 if len(w) >= 8 else 12)]
        # single words of licences among others are no licence, but for those that name one
        common = sorted({x for ts in TEXTS.values() for t in ts for x in words(t) if x.isalpha()} - STOP - NAMING)
        other = sorted({x for t in NOTICES["none"] for x in words(t)} - NAMING)
        for _ in range(1200):
            w = [other[i] for i in rng.randint(len(other), size=8)]
            for i in rng.randint(len(common), size=rng.randint(1, 4)):
                w.insert(rng.randint(len(w) + 1), common[i])
            rows.append((_told(w), CLASSES.index("none")))
        rows = [(g, y) for g, y in rows if g]
        seen: dict[str, int] = {}
        for g, _ in rows:
            for x in g:
                seen[x] = seen.get(x, 0) + 1
        # the longest n-grams of long texts repeat each other: the most frequent ones stay
        self.grams = sorted(sorted((x for x, n in seen.items() if n >= 4), key=lambda x: (-seen[x] / len(x.split()), x))[:most])
        at = {x: i for i, x in enumerate(self.grams)}

        def matrix(part):
            m = np.zeros((len(part), len(at)), np.float32)
            for i, (g, _) in enumerate(part):
                m[i, [at[x] for x in g if x in at]] = 1
            return m, np.array([y for _, y in part])

        x, y = matrix(rows)
        hx, hy = matrix([(_told(words(t)), CLASSES.index(c)) for c, ts in CALIBRATION.items() for t in ts])
        hot = np.eye(len(CLASSES), dtype=np.float32)[y]
        often = (len(y) / (len(CLASSES) * np.bincount(y, minlength=len(CLASSES)))) ** 0.5
        w, b = np.zeros((len(at), len(CLASSES)), np.float32), np.zeros(len(CLASSES), np.float32)
        none = CLASSES.index("none")
        squares = np.full_like(w, 1e-3)
        for _ in range(rounds):
            z = x @ w + b
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            g = (hot - p) * often[y][:, None].astype(np.float32) / len(x)
            step = x.T @ g
            squares += step * step
            rate = 0.1 / np.sqrt(squares)
            w += rate * step
            w = np.sign(w) * np.maximum(np.abs(w) - 2e-5 * rate, 0)  # sparse
            b += 2.0 * g.sum(0)
        b[none] = max(b[none], b.max() + 1.0)  # without any n-gram: none
        self.weights = np.rint(w * SCALE).astype(int)
        self.biases = np.rint(b * SCALE).astype(int)
        self.held = hx @ w + b, hy

        def loss(t):
            z = self.held[0] / t
            z = z - z.max(1, keepdims=True)
            return -(z[np.arange(len(hy)), hy] - np.log(np.exp(z).sum(1))).mean()

        self.temperature = float(min((0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0, 1.2, 1.4, 1.7, 2.0, 2.5, 3.0, 4.0), key=loss))
        self.templates = [(f, _told(words(n))) for f in FAMILIES for n in (*NOTICES[f], *TEXTS.get(f, ()))]
        # anchors: few words of which every line or so of a licence holds one, rare ones elsewhere preferred
        other = [set(words(t)) for t in NOTICES["none"]]
        left = [set(x for x in w[i : i + 14] if x not in STOP) for y, w in sources if y != none for i in range(0, max(1, len(w) - 6), 14)]
        left = [ws for ws in left if ws]
        self.anchors: list[str] = sorted(NAMING - {"mit", "cc"})
        left = [ws for ws in left if not ws & NAMING - {"mit", "cc"}]
        while left:
            count: dict[str, int] = {}
            for ws in left:
                for x in ws:
                    count[x] = count.get(x, 0) + 1
            best = min(count, key=lambda x: (-count[x] / (1 + sum(x in o for o in other)) ** 0.5, x))
            self.anchors.append(best)
            left = [ws for ws in left if best not in ws]

    def cue(self, before: str = "(?<![a-z0-9])", after: str = "(?![a-z0-9])") -> str:
        return before + "(?:" + "|".join(x.replace(".", "[.]") for x in sorted(self.anchors)) + ")" + after

    def table(self) -> list[tuple[str, list[int], list[int]]]:
        """n-gram, weight by class, 1 by template that holds it."""
        at = {x: i for i, x in enumerate(self.grams)}
        every = sorted({x for x, i in at.items() if self.weights[i].any()}.union(*(g for _, g in self.templates)))
        zero = [0] * len(CLASSES)
        return [(x, self.weights[at[x]].tolist() if x in at else zero, [int(x in g) for _, g in self.templates]) for x in every]


@functools.cache
def model() -> Model:
    return Model()


def _judged(sums: DataFrame, m: Model) -> DataFrame:
    """Sums over a paragraph's n-grams -> family, probability, containment, confirmed."""
    z = F.array(*[(F.col(f"c{i}") + F.lit(int(b))) / F.lit(SCALE * m.temperature) for i, b in enumerate(m.biases)])
    step = sums.select("doc_id", F.col("paragraph").cast("long").alias("paragraph"), "first_word", "last_word", z.alias("z"), "held")
    step = step.withColumn("top", F.array_max("z")).withColumn("best", F.array_position("z", F.col("top")).cast("int"))
    step = step.withColumn("p", 1 / F.aggregate("z", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top"))))
    step = step.withColumn("nothing", F.col("p") * F.exp(F.element_at("z", CLASSES.index("none") + 1) - F.col("top")))
    # the paragraph of the family that is best held; unknown and none have none
    of_class = F.array(*[F.array(*[F.lit(i) for i, (f, _) in enumerate(m.templates) if f == c]).cast("array<int>") for c in CLASSES])
    sizes = F.array(*[F.lit(len(g)) for _, g in m.templates])
    share = F.transform(F.element_at(of_class, F.col("best")), lambda t: F.size(F.filter("held", lambda x: x == t)) / F.element_at(sizes, t + 1))
    step = step.withColumn("own", F.coalesce(F.array_max(share), F.lit(0.0))).withColumn("name", F.element_at(F.array(*[F.lit(c) for c in CLASSES]), F.col("best")))
    known = F.col("name").isin(*FAMILIES)
    sure = (F.col("p") >= ALONE) | (F.col("p") >= CONFIDENT) & (F.col("own") >= CONFIRMED)
    step = step.withColumn("family", F.when(known & sure, F.col("name")).when(F.col("nothing") >= NONE, "none").otherwise("unknown"))
    return step.select("doc_id", "paragraph", "first_word", "last_word", "family", F.round("p", 6).alias("probability"), F.round("own", 6).alias("containment"),
                       (F.col("family").isin(*FAMILIES) & (F.col("own") >= CONFIRMED)).alias("confirmed"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per licence stretch: doc_id, paragraph (from 0, split at blank lines), first_word and last_word (of its known
    n-grams, from 0 in the paragraph), family, probability, containment, confirmed.

    Families are those of NOTICES and ``unknown``. Nulls: a null text has no paragraph; a null id stays
    null. Repeated rows, also of null ids, give as many results. Ties go to the class listed first. Empty
    tables give empty tables. Paragraphs are whole, however long.
    """
    m = model()
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.translate(text_or_empty(text_col), UPPER, SMALL).alias("t")).filter(F.col("t").rlike(m.cue()))
    parts = base.select("doc_id", "row", F.posexplode(F.split("t", BLANK)).alias("paragraph", "p")).filter(F.col("p").rlike(m.cue()))
    parts = parts.select("doc_id", "row", "paragraph", F.regexp_extract_all("p", F.lit(WORD), F.lit(0)).alias("w"))
    n = F.size("w")

    def joined(k):
        parts = [F.slice("w", i + 1, F.greatest(n - k + 1, F.lit(0))) for i in range(k)]
        out = parts[0]
        for p in parts[1:]:
            out = F.zip_with(out, p, lambda a, b: F.concat_ws(" ", a, b))
        return F.transform(out, lambda g, i: F.struct(i.alias("pos"), g.alias("gram")))

    each = parts.select("doc_id", "row", "paragraph", F.explode(F.concat(joined(1), joined(2), joined(3))).alias("x")).select("doc_id", "row", "paragraph", "x.pos", "x.gram")
    rows = [(g, *ws, [i for i, x in enumerate(ts) if x]) for g, ws, ts in m.table()]
    cols = [f"c{i}" for i in range(len(CLASSES))]
    # as many rows as the licence texts have n-grams
    table = spark.createDataFrame(rows, "gram string, " + ", ".join(f"{c} int" for c in cols) + ", templates array<int>")
    hits = each.join(F.broadcast(table.select("gram")), "gram")
    # stretches of known n-grams; a window holds the hits of one paragraph
    along = Window.partitionBy("row", "paragraph").orderBy("pos")
    hits = hits.withColumn("new", (F.col("pos") - F.lag("pos", 1, -(GAP + 1)).over(along) > GAP).cast("int"))
    hits = hits.withColumn("stretch", F.sum("new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    keys = ["doc_id", "row", "paragraph", "stretch"]
    distinct = hits.groupBy(*keys, "gram").agg(F.min("pos").alias("a"), F.max("pos").alias("b"))
    sums = distinct.join(F.broadcast(table), "gram").groupBy(*keys).agg(*[F.sum(c).alias(c) for c in cols], F.flatten(F.collect_list("templates")).alias("held"), F.min("a").alias("first_word"), F.max("b").alias("last_word"))
    return _judged(sums, m).filter("family <> 'none'")


def stretches(paragraph: str) -> list[tuple[int, int, set[str]]]:
    """Of a paragraph, in plain Python: first and last place, and known n-grams of each stretch."""
    known = {g for g, *_ in model().table()}
    w = words(paragraph)
    hits = sorted((i, " ".join(w[i : i + k])) for k in (1, 2, 3) for i in range(len(w) - k + 1) if " ".join(w[i : i + k]) in known)
    out: list[tuple[int, int, set[str]]] = []
    for i, g in hits:
        if not out or i - out[-1][1] > GAP:
            out.append((i, i, {g}))
        else:
            out[-1] = (out[-1][0], i, out[-1][2] | {g})
    return out


def judge(text: str) -> list[tuple[int, int, int, str, float, float, bool]]:
    """The rows of one text, in plain Python: paragraph, first and last word, family, probability, containment, confirmed."""
    m = model()
    low = text.translate(str.maketrans(UPPER, SMALL))
    at = {x: i for i, x in enumerate(m.grams)}
    out = []
    for k, p in enumerate(re.split(BLANK, low)):
        if not re.search(m.cue(), p):
            continue
        for a, b, found in stretches(p):
            s = m.biases + sum((m.weights[at[g]] for g in found if g in at), np.zeros(len(CLASSES), int))
            z = s / (SCALE * m.temperature)
            q = np.exp(z - z.max())
            q /= q.sum()
            i = int(q.argmax())
            name = CLASSES[i]
            own = max((len(found & g) / len(g) for f, g in m.templates if f == name), default=0.0)
            sure = q[i] >= ALONE or q[i] >= CONFIDENT and own >= CONFIRMED
            family = name if name in FAMILIES and sure else "none" if q[CLASSES.index("none")] >= NONE else "unknown"
            if family != "none":
                out.append((k, a, b, family, round(float(q[i]), 6), round(own, 6), family in FAMILIES and own >= CONFIRMED))
    return out


def oracle() -> str:
    """The scan in SQL, with the trained weights as a table of values."""
    m = model()
    cols = [f"c{i}" for i in range(len(CLASSES))] + [f"t{i}" for i in range(len(m.templates))]
    values = ", ".join("('" + g + "', " + ", ".join(map(str, [*ws, *ts])) + ")" for g, ws, ts in m.table())
    z = ", ".join(f"(sum(c{i}) + {int(b)}) / ({SCALE} * {m.temperature})::DOUBLE" for i, b in enumerate(m.biases))
    held = ", ".join("greatest(0.0::DOUBLE" + "".join(f", sum(t{i}) / {len(g)}::DOUBLE" for i, (f, g) in enumerate(m.templates) if f == c) + ")" for c in CLASSES)
    names = ", ".join(f"'{c}'" for c in CLASSES)
    known = ", ".join(f"'{c}'" for c in FAMILIES)
    cue = m.cue("(^|[^a-z0-9])", "($|[^a-z0-9])")
    return f"""
        WITH v(gram, {", ".join(cols)}) AS (VALUES {values}),
        p AS (SELECT doc_id, row_number() OVER () AS rid, string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{SMALL}'), '{BLANK}') AS ls FROM documents),
        l AS (SELECT doc_id, rid, unnest(range(0, len(ls))) AS paragraph, unnest(ls) AS line FROM p),
        w AS (SELECT doc_id, rid, paragraph, regexp_extract_all(line, '{WORD}') AS w FROM l WHERE regexp_matches(line, '{cue}')),
        g AS (SELECT doc_id, rid, paragraph, unnest(range(0, len(w))) AS pos, unnest(w) AS gram FROM w
              UNION ALL SELECT doc_id, rid, paragraph, unnest(range(0, len(w) - 1)) AS pos, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i+1])) AS gram FROM w
              UNION ALL SELECT doc_id, rid, paragraph, unnest(range(0, len(w) - 2)) AS pos, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2])) AS gram FROM w),
        h AS (SELECT doc_id, rid, paragraph, pos, gram, CASE WHEN pos - lag(pos, 1, -{GAP + 1}) OVER (PARTITION BY rid, paragraph ORDER BY pos) > {GAP} THEN 1 ELSE 0 END AS fresh FROM g WHERE gram IN (SELECT gram FROM v)),
        i AS (SELECT doc_id, rid, paragraph, pos, gram, sum(fresh) OVER (PARTITION BY rid, paragraph ORDER BY pos RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stretch FROM h),
        d AS (SELECT doc_id, rid, paragraph, stretch, gram, min(pos) AS a, max(pos) AS b FROM i GROUP BY ALL),
        s AS (SELECT doc_id, rid, paragraph, stretch, [{z}] AS z, [{held}] AS held, min(a) AS first_word, max(b) AS last_word FROM d JOIN v USING (gram) GROUP BY doc_id, rid, paragraph, stretch),
        b AS (SELECT doc_id, paragraph, first_word, last_word, z, held, list_position(z, list_max(z)) AS best, 1 / list_sum(list_transform(z, lambda x: exp(x - list_max(z)))) AS p, exp(z[{CLASSES.index('none') + 1}] - list_max(z)) AS nothing FROM s),
        n AS (SELECT doc_id, paragraph, first_word, last_word, p, p * nothing AS nothing, held[best] AS own, [{names}][best] AS name FROM b),
        f AS (SELECT *, CASE WHEN name IN ({known}) AND (p >= {ALONE} OR (p >= {CONFIDENT} AND own >= {CONFIRMED})) THEN name WHEN nothing >= {NONE} THEN 'none' ELSE 'unknown' END AS family FROM n)
        SELECT doc_id, CAST(paragraph AS BIGINT) AS paragraph, CAST(first_word AS INTEGER) AS first_word, CAST(last_word AS INTEGER) AS last_word, family, round(p, 6) AS probability, round(own, 6) AS containment,
               family IN ({known}) AND own >= {CONFIRMED} AS confirmed FROM f WHERE family <> 'none'"""
