r"""Operator 5 (DataFrame functions only): licence texts by Dice coefficient over word bigrams.

A text is cut into lines, and lines into sentences; a segment is normalised (lower case, runs of characters that are
neither letters nor digits become one blank). The Dice coefficient 2 |A & B| / (|A| + |B|) of the sets of word bigrams
of a segment and a licence template is reported when it reaches THRESHOLD.

What segments cut apart is found by windows of words, which run across lines and sentences: windows of up to (2 - t) / t
times a template's length are scored against the templates, where they cross an end of a segment, and against NOTICES,
whole notices of several lines, wherever they are. All windows that can reach the threshold are scored: a best window
begins and ends with a bigram of the template, and has at least t / (2 - t) of the template's. A whole notice names the
licence before any template does. ORACLE_SQL states the part by segments only, without either bound.

Two bounds prune, and lose nothing. Size: Dice t needs |A| / |B| between t / (2 - t) and (2 - t) / t, so a template is
a candidate only for segments of fitting size. Keys: at most 1 - t / (2 - t) of a template's bigrams can be missing from
a segment that reaches t, so words that touch more of its bigrams than that cannot all be absent; texts and segments
without any key word are passed over.

Edge cases: null and empty texts and texts without a hit have no row; of equal coefficients the first template in
order is the licence; rows with the same doc_id are reported each; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm.common import narrow

THRESHOLD = 0.8
#: Notices that licences ask for, by SPDX identifier.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
)
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
    "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
)
_MIT_REST = (
    " The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    " THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
    "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_REST = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_GNU = (
    "{0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1} as published by the Free Software Foundation, "
    "either version 3 of the License, or (at your option) any later version."
)
_GNU_REST = (
    " {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
    "See the GNU {1} for more details. You should have received a copy of the GNU {1} along with {2}. If not, see <https://www.gnu.org/licenses/>."
)
_GPL, _LGPL = ("This program", "General Public License", "this program"), ("This library", "Lesser General Public License", "this library")
_APACHE = (
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
    "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
    "See the License for the specific language governing permissions and limitations under the License."
)
#: Whole notices of several lines or sentences, and their first sentences where these are longer than a template.
NOTICES = (
    ("MIT", _MIT), ("MIT", _MIT + _MIT_REST), ("BSD-3-Clause", _BSD + _BSD_NAMES + _BSD_REST), ("BSD-2-Clause", _BSD + _BSD_REST),
    ("GPL-3.0", _GNU.format(*_GPL)), ("GPL-3.0", (_GNU + _GNU_REST).format(*_GPL)), ("LGPL-3.0", _GNU.format(*_LGPL)), ("LGPL-3.0", (_GNU + _GNU_REST).format(*_LGPL)),
    ("Apache-2.0", _APACHE), ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
)
RUN = r"[^\p{L}\p{N}]+"


def words_of(text: str) -> list[str]:
    return [w for w in re.split(r"[\W_]+", text.lower()) if w]


def bigrams_of(text: str) -> list[str]:
    w = words_of(text)
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:])})


def key_words(templates, threshold: float) -> list[str]:
    """Words of which a segment at the threshold has at least one, whichever template it resembles."""
    uses = Counter(w for _, t in templates for w in set(words_of(t)))
    keys: set[str] = set()
    for _, t in templates:
        grams = bigrams_of(t)
        may_miss = int(len(grams) * (1 - threshold / (2 - threshold)) + 1e-9)
        touched = {g for g in grams if keys & set(g.split())}
        # rarer-looking words first: long words that other templates use too
        for w in sorted(set(words_of(t)), key=lambda w: (-("licens" in w), len(w) < 7, -uses[w], w)):
            if len(touched) > may_miss:
                break
            keys.add(w)
            touched |= {g for g in grams if w in g.split()}
    return sorted(keys)


def best_window(text: str, threshold: float, across: bool):
    """Largest Dice coefficient of a template and a window of bigrams g (of words of segments p); null if none can reach
    threshold. across: only windows that cross an end of a segment."""
    own = bigrams_of(text)
    m, need = len(own), int(-(-len(own) * threshold / (2 - threshold) // 1))
    limit = int((len(words_of(text)) - 1) * (2 - threshold) / threshold)
    a = "array(" + ", ".join(f"'{x}'" for x in own) + ")"
    part = "slice(g, i + 1, j - i + 1)"
    crosses = " and p[i] <> p[j + 1]" if across else ""
    ends = f"filter(slice(h, r + {need}, {max(1, limit - need + 1)}), j -> j - i < {limit}{crosses})"
    dice = f"transform({ends}, j -> 2.0D * size(array_intersect({part}, {a})) / (size(array_distinct({part})) + {m}))"
    places = f"filter(transform(g, (x, i) -> if(array_contains({a}, x), i, null)), i -> i is not null)"
    return F.expr(f"if(size(array_intersect(g, {a})) >= {need}, transform(array({places}), h -> array_max(flatten(transform(h, (i, r) -> {dice}))))[0], null)")


def licences(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD, notices=NOTICES) -> DataFrame:
    """doc_id, license_id, dice, hits: for each row of docs with a hit, its best licence and how many segments hit any
    template (0 when the licence is only found across segments)."""
    keys = [key_words(x, threshold) for x in (templates, notices)]
    some, any_ = (rf"(?iu)(?<![\p{{L}}\p{{N}}])(?:{'|'.join(sorted(set(k)))})(?![\p{{L}}\p{{N}}])" for k in (keys[0], keys[0] + keys[1]))
    t = narrow(docs, "doc_id", "text").where(F.col("text").rlike(any_)).select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.split("text", r"\n+|(?<=[.!?;])\s+").alias("s"))
    # a row for each segment and one for the whole text
    each = t.select("doc_id", "row", F.explode(F.expr("concat(transform(s, x -> struct(false as whole, array(x) as s)), array(struct(true as whole, s as s)))")).alias("e")).select("doc_id", "row", "e.whole", "e.s")
    each = each.where(F.col("whole") | F.element_at("s", 1).rlike(some))
    w = each.select("doc_id", "row", "whole", F.transform("s", lambda x: F.filter(F.split(F.trim(F.regexp_replace(F.lower(x), RUN, " ")), " "), lambda y: y != "")).alias("w"))
    w = w.select("doc_id", "row", "whole", F.flatten("w").alias("w"), F.when(F.col("whole"), F.flatten(F.transform("w", lambda x, k: F.array_repeat(k, F.size(x))))).alias("p"))
    grams = F.expr("transform(sequence(1, size(w) - 1), i -> concat(get(w, i - 1), ' ', get(w, i)))")
    g = w.where(F.size("w") > 1).select("doc_id", "row", "whole", "p", grams.alias("g"))
    g = g.select("doc_id", "row", "whole", "p", F.when(F.col("whole"), F.col("g")).otherwise(F.array_distinct("g")).alias("g")).withColumn("n", F.size("g"))
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    scores, windows = [], []
    for k, (_, text) in enumerate((*templates, *notices)):
        notice = k >= len(templates)
        score = lambda dice: F.struct(F.lit(int(notice)).alias("notice"), F.coalesce(F.when(dice >= threshold, dice), F.lit(0.0)).alias("dice"), F.lit(-k).alias("k"))  # noqa: B023, E731
        windows.append(score(best_window(text, threshold, across=not notice)))
        if not notice:
            own = bigrams_of(text)
            fits = F.col("n").between(int(-(-len(own) * low // 1)), int(len(own) * high))
            both = F.size(F.array_intersect("g", F.array(*[F.lit(x) for x in own])))
            scores.append(score(F.when(fits, F.lit(2.0) * both / (F.col("n") + F.lit(len(own))))))
    best = lambda x: F.array_max(F.filter(F.array(*x), lambda b: b.dice > 0))
    b = F.when(F.col("whole"), best(windows)).otherwise(best(scores))
    # no filter by b before the aggregate: pushed down, it would repeat the expressions below it for each template
    scored = g.select("doc_id", "row", "whole", b.alias("b"))
    names = F.array(*[F.lit(i) for i, _ in (*templates, *notices)])
    found = scored.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.max("b").alias("b"), F.count(F.when(~F.col("whole") & F.col("b").isNotNull(), 1)).alias("hits")).where("b is not null")
    return found.select("doc_id", F.element_at(names, 1 - F.col("b.k")).alias("license_id"), F.round("b.dice", 9).alias("dice"), "hits")


def _sql() -> str:
    rows = ", ".join(f"({k}, '{i}', {[g for g in bigrams_of(t)]})" for k, (i, t) in enumerate(TEMPLATES))
    return rf"""
WITH tpl(k, license_id, b) AS (VALUES {rows}),
d AS (SELECT doc_id, row_number() OVER () AS row, text FROM documents),
s AS (SELECT doc_id, row, trim(regexp_replace(lower(x), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) AS x
  FROM (SELECT doc_id, row, unnest(string_split_regex(regexp_replace(text, '([.!?;])\s+', '\1' || chr(10), 'g'), '\n+')) AS x FROM d)),
w AS (SELECT doc_id, row, string_split(x, ' ') AS w FROM s WHERE x LIKE '% %'),
g AS (SELECT doc_id, row, list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS g FROM w),
h AS (SELECT doc_id, row, max({{'dice': dice, 'k': -k}}) AS best FROM (
  SELECT doc_id, row, g, k, 2.0::DOUBLE * len(list_intersect(g, b)) / (len(g) + len(b)) AS dice FROM g, tpl) WHERE dice >= {THRESHOLD} GROUP BY doc_id, row, g)
SELECT doc_id, license_id, round(m.dice, 9) AS dice, hits FROM (SELECT doc_id, row, max(best) AS m, count(*) AS hits FROM h GROUP BY doc_id, row) JOIN tpl ON k = -m.k
"""


ORACLE_SQL = _sql()
