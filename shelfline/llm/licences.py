"""Licence scan, with DataFrame functions only.

Texts are normalised to words and compared to licence templates by the Dice coefficient over word bigrams.  A
licence may stand anywhere: what is compared are runs of words that start and end with a bigram of the
template.  Sizes bound the coefficient: 2 * min / (a + b) is its largest possible value, so a template is a
candidate only where the text shares enough of its bigrams, and its runs are bounded in length.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfline.llm.common import text_of

THRESHOLD = 0.8
MOST_TEMPLATE_BYTES = 4 << 20

# Public licence notices and licence texts.
_DISCLAIMER = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, '
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
    "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_REDISTRIBUTION = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
    "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
    "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
    "distribution. "
)
_APACHE = (
    "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND "
    'DISTRIBUTION 1. Definitions. "License" shall mean the terms and conditions for use, reproduction, and distribution as '
    'defined by Sections 1 through 9 of this document. "Licensor" shall mean the copyright owner or entity authorized by the '
    'copyright owner that is granting the License. "Legal Entity" shall mean the union of the acting entity and all other '
    "entities that control, are controlled by, or are under common control with that entity. For the purposes of this "
    'definition, "control" means (i) the power, direct or indirect, to cause the direction or management of such entity, '
    "whether by contract or otherwise, or (ii) ownership of fifty percent (50%) or more of the outstanding shares, or (iii) "
    'beneficial ownership of such entity. "You" (or "Your") shall mean an individual or Legal Entity exercising permissions '
    'granted by this License. "Source" form shall mean the preferred form for making modifications, including but not limited '
    'to software source code, documentation source, and configuration files. "Object" form shall mean any form resulting from '
    "mechanical transformation or translation of a Source form, including but not limited to compiled object code, generated "
    'documentation, and conversions to other media types. "Work" shall mean the work of authorship, whether in Source or '
    "Object form, made available under the License, as indicated by a copyright notice that is included in or attached to the "
    'work (an example is provided in the Appendix below). "Derivative Works" shall mean any work, whether in Source or Object '
    "form, that is based on (or derived from) the Work and for which the editorial revisions, annotations, elaborations, or "
    "other modifications represent, as a whole, an original work of authorship. For the purposes of this License, Derivative "
    "Works shall not include works that remain separable from, or merely link (or bind by name) to the interfaces of, the "
    'Work and Derivative Works thereof. "Contribution" shall mean any work of authorship, including the original version of '
    "the Work and any modifications or additions to that Work or Derivative Works thereof, that is intentionally submitted to "
    "Licensor for inclusion in the Work by the copyright owner or by an individual or Legal Entity authorized to submit on "
    'behalf of the copyright owner. For the purposes of this definition, "submitted" means any form of electronic, verbal, or '
    "written communication sent to the Licensor or its representatives, including but not limited to communication on "
    "electronic mailing lists, source code control systems, and issue tracking systems that are managed by, or on behalf of, "
    "the Licensor for the purpose of discussing and improving the Work, but excluding communication that is conspicuously "
    'marked or otherwise designated in writing by the copyright owner as "Not a Contribution." "Contributor" shall mean '
    "Licensor and any individual or Legal Entity on behalf of whom a Contribution has been received by Licensor and "
    "subsequently incorporated within the Work. 2. Grant of Copyright License. Subject to the terms and conditions of this "
    "License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, "
    "irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, "
    "and distribute the Work and such Derivative Works in Source or Object form. 3. Grant of Patent License. Subject to the "
    "terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, "
    "no-charge, royalty-free, irrevocable (except as stated in this section) patent license to make, have made, use, offer to "
    "sell, sell, import, and otherwise transfer the Work, where such license applies only to those patent claims licensable "
    "by such Contributor that are necessarily infringed by their Contribution(s) alone or by combination of their "
    "Contribution(s) with the Work to which such Contribution(s) was submitted. If You institute patent litigation against "
    "any entity (including a cross-claim or counterclaim in a lawsuit) alleging that the Work or a Contribution incorporated "
    "within the Work constitutes direct or contributory patent infringement, then any patent licenses granted to You under "
    "this License for that Work shall terminate as of the date such litigation is filed. 4. Redistribution. You may reproduce "
    "and distribute copies of the Work or Derivative Works thereof in any medium, with or without modifications, and in "
    "Source or Object form, provided that You meet the following conditions: (a) You must give any other recipients of the "
    "Work or Derivative Works a copy of this License; and (b) You must cause any modified files to carry prominent notices "
    "stating that You changed the files; and (c) You must retain, in the Source form of any Derivative Works that You "
    "distribute, all copyright, patent, trademark, and attribution notices from the Source form of the Work, excluding those "
    "notices that do not pertain to any part of the Derivative Works; and (d) If the Work includes a \"NOTICE\" text file as "
    "part of its distribution, then any Derivative Works that You distribute must include a readable copy of the attribution "
    "notices contained within such NOTICE file, excluding those notices that do not pertain to any part of the Derivative "
    "Works, in at least one of the following places: within a NOTICE text file distributed as part of the Derivative Works; "
    "within the Source form or documentation, if provided along with the Derivative Works; or, within a display generated by "
    "the Derivative Works, if and wherever such third-party notices normally appear. The contents of the NOTICE file are for "
    "informational purposes only and do not modify the License. You may add Your own attribution notices within Derivative "
    "Works that You distribute, alongside or as an addendum to the NOTICE text from the Work, provided that such additional "
    "attribution notices cannot be construed as modifying the License. You may add Your own copyright statement to Your "
    "modifications and may provide additional or different license terms and conditions for use, reproduction, or "
    "distribution of Your modifications, or for any such Derivative Works as a whole, provided Your use, reproduction, and "
    "distribution of the Work otherwise complies with the conditions stated in this License. 5. Submission of Contributions. "
    "Unless You explicitly state otherwise, any Contribution intentionally submitted for inclusion in the Work by You to the "
    "Licensor shall be under the terms and conditions of this License, without any additional terms or conditions. "
    "Notwithstanding the above, nothing herein shall supersede or modify the terms of any separate license agreement you may "
    "have executed with Licensor regarding such Contributions. 6. Trademarks. This License does not grant permission to use "
    "the trade names, trademarks, service marks, or product names of the Licensor, except as required for reasonable and "
    "customary use in describing the origin of the Work and reproducing the content of the NOTICE file. 7. Disclaimer of "
    "Warranty. Unless required by applicable law or agreed to in writing, Licensor provides the Work (and each Contributor "
    'provides its Contributions) on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or '
    "implied, including, without limitation, any warranties or conditions of TITLE, NON-INFRINGEMENT, MERCHANTABILITY, or "
    "FITNESS FOR A PARTICULAR PURPOSE. You are solely responsible for determining the appropriateness of using or "
    "redistributing the Work and assume any risks associated with Your exercise of permissions under this License. 8. "
    "Limitation of Liability. In no event and under no legal theory, whether in tort (including negligence), contract, or "
    "otherwise, unless required by applicable law (such as deliberate and grossly negligent acts) or agreed to in writing, "
    "shall any Contributor be liable to You for damages, including any direct, indirect, special, incidental, or "
    "consequential damages of any character arising as a result of this License or out of the use or inability to use the "
    "Work (including but not limited to damages for loss of goodwill, work stoppage, computer failure or malfunction, or any "
    "and all other commercial damages or losses), even if such Contributor has been advised of the possibility of such "
    "damages. 9. Accepting Warranty or Additional Liability. While redistributing the Work or Derivative Works thereof, You "
    "may choose to offer, and charge a fee for, acceptance of support, warranty, indemnity, or other liability obligations "
    "and/or rights consistent with this License. However, in accepting such obligations, You may act only on Your own behalf "
    "and on Your sole responsibility, not on behalf of any other Contributor, and only if You agree to indemnify, defend, and "
    "hold each Contributor harmless for any liability incurred by, or claims asserted against, such Contributor by reason of "
    "your accepting any such warranty or additional liability. END OF TERMS AND CONDITIONS"
)
TEMPLATES: dict[str, str] = {
    "MIT notice": "Released under the MIT License.",
    "MIT licensed": "Licensed under the MIT License.",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the '
        "specific language governing permissions and limitations under the License."
    ),
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0 notice": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0 notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0 notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "GPL-3.0 header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without "
        "even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public "
        "License for more details."
    ),
    "MPL-2.0 notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "BSD-3-Clause notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC-BY-4.0 notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0 notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0 sentence": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC0-1.0 notice": "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    "Unlicense notice": "This is free and unencumbered software released into the public domain.",
    "Apache-2.0": _APACHE,
    "BSD-2-Clause": _REDISTRIBUTION + _DISCLAIMER,
    "BSD-3-Clause": (
        _REDISTRIBUTION
        + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission. "
        + _DISCLAIMER
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
        "liable for any damages arising from the use of this software. Permission is granted to anyone to use this software "
        "for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the "
        "following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote "
        "the original software. If you use this software in a product, an acknowledgment in the product documentation would "
        "be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be "
        "misrepresented as being the original software. 3. This notice may not be removed or altered from any source "
        "distribution."
    ),
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        'Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT '
        "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT "
        "SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION "
        "OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
        "DEALINGS IN THE SOFTWARE."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE "
        'IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED '
        "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
        "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER "
        "IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
        "PERFORMANCE OF THIS SOFTWARE."
    ),
}


def template_bigrams(text: str) -> list[str]:
    """Bigrams of a template, normalised like the texts."""
    words = re.sub("[^A-Za-z0-9]+", " ", text).lower().split()
    return [f"{a} {b}" for a, b in zip(words, words[1:])]


def size_bounds(n: int, threshold: float) -> tuple[int, int]:
    """Numbers of bigrams that can reach ``threshold`` against ``n``: 2 min / (a + b) >= threshold."""
    low, high = n * threshold / (2 - threshold), n * (2 - threshold) / threshold
    return max(1, math.ceil(low - 1e-9)), math.floor(high + 1e-9)


def template_rows(templates: Mapping[str, str], threshold: float) -> list[tuple[str, int, int, int, str, int]]:
    """``licence, size, low, high, gram, times``: a row for each bigram of each template."""
    rows = []
    for name, text in sorted(templates.items()):
        grams = template_bigrams(text)
        low, high = size_bounds(len(grams), threshold)
        rows += [(name, len(grams), low, high, g, times) for g, times in Counter(grams).items()]
    if sum(len(row[4]) for row in rows) > MOST_TEMPLATE_BYTES:
        raise ValueError("the templates travel with every task: pass fewer or shorter ones")
    return rows


def normalised(text: Column) -> Column:
    """The words of a text: runs of ASCII letters and digits in lower case, one blank between them."""
    return F.trim(F.lower(F.regexp_replace(text, "[^A-Za-z0-9]+", " ")))


def shared_bigrams(documents: DataFrame, known: DataFrame) -> DataFrame:
    """``row, doc_id, licence, size, low, high, hits``: for each text and template, the bigrams that both have.

    A hit has its ``pos`` and ``prev``, the place of the occurrence ``times`` before it (-1: none), where the template
    has the bigram ``times`` times.  In a run from ``s`` on, the hits with ``prev < s`` are those that a comparison
    of multisets counts.  Texts that cannot reach the threshold with a template, by size, are left out.
    """
    # the number only tells rows apart inside one job
    rows = documents.select(F.monotonically_increasing_id().alias("row"), documents["doc_id"].alias("doc_id"), F.split(normalised(text_of(documents)), " ").alias("w"))
    pairs = F.posexplode(F.arrays_zip(F.col("w"), F.slice("w", 2, F.size("w")).alias("v"))).alias("pos", "p")
    grams = rows.where(F.size("w") > 1).select("row", "doc_id", pairs).where("p.v is not null")
    met = grams.select("row", "doc_id", "pos", F.xxhash64("p.w", "p.v").alias("gram")).join(F.broadcast(known), "gram")
    key = ["row", "doc_id", "licence", "size", "low", "high"]
    per = met.groupBy(*key, "gram", "times").agg(F.array_sort(F.collect_list("pos")).alias("at"))
    earlier = lambda t: F.when(t >= F.col("times"), F.get("at", t - F.col("times"))).otherwise(-1)
    hits = F.transform("at", lambda p, t: F.struct(p.alias("pos"), earlier(t).alias("prev")))
    per = per.select(*key, F.least(F.size("at"), "times").alias("common"), hits.alias("hits"))
    whole = per.groupBy(*key).agg(F.sum("common").alias("common"), F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits"))
    return whole.where(F.col("common") >= F.col("low")).drop("common")


def _best_ends(threshold: float) -> Column:
    """``start, end, common, dice`` of the best run (ties: the shorter) from each hit on that reaches the threshold."""

    def from_hit(hit: Column, i: Column) -> Column:
        nothing = F.struct(F.lit(0).alias("n"), F.lit(-1).alias("end"), F.lit(0).alias("common"), F.lit(0.0).alias("dice"))

        def grow(acc: Column, h: Column) -> Column:
            n = acc["n"] + (h["prev"] < hit["pos"]).cast("int")
            size = h["pos"] - hit["pos"] + 1
            dice = n * 2.0 / (size + F.col("size"))
            better = (dice > acc["dice"]) & size.between(F.col("low"), F.col("high"))
            return F.struct(
                n.alias("n"),
                F.when(better, h["pos"]).otherwise(acc["end"]).alias("end"),
                F.when(better, n).otherwise(acc["common"]).alias("common"),
                F.when(better, dice).otherwise(acc["dice"]).alias("dice"),
            )

        # no run has more hits than bigrams
        best = F.aggregate(F.slice("hits", i + 1, F.col("high")), nothing, grow)
        return F.struct(hit["pos"].alias("start"), best["end"].alias("end"), best["common"].alias("common"), best["dice"].alias("dice"))

    return F.filter(F.transform("hits", from_hit), lambda r: r["dice"] >= F.lit(threshold))


def _apart(runs: Column) -> Column:
    """The first of the runs, and each later one that shares no word with one taken before it."""
    none = F.slice(runs, 1, 0)

    def take(chosen: Column, run: Column) -> Column:
        meets = F.exists(chosen, lambda c: (c["end"] + 1 >= run["start"]) & (run["end"] + 1 >= c["start"]))
        return F.when(meets, chosen).otherwise(F.concat(chosen, F.array(run)))

    return F.aggregate(runs, none, take)


def scan_licences(documents: DataFrame, templates: Mapping[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, licence, first_word, n_words, dice``: a row for each run of words that matches a template.

    Words are runs of ASCII letters and digits, counted from 0 over the whole text; a run may cross lines, comment
    signs and paragraphs.  From each bigram of a template on, the run with the largest Dice coefficient counts; of
    runs of one template that share words the one with the larger coefficient stays, of those of several the one
    with more common bigrams, then the larger coefficient, then the name that sorts first, then the earlier.
    Bigrams are compared as multisets.  Null and empty texts and those of fewer than two words match nothing;
    repeated rows are scanned each; other columns are ignored; a text of any length is compared whole.
    Templates without two words match nothing; the templates are broadcast and their size is checked.  Only
    bigrams that a template holds are ever shuffled.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold lies in (0, 1]")
    rows = template_rows(TEMPLATES if templates is None else templates, threshold)
    words = [(name, size, low, high, *gram.split(" "), times) for name, size, low, high, gram, times in rows]
    known = documents.sparkSession.createDataFrame(words, "licence string, size int, low int, high int, w string, v string, times int")
    known = known.select("licence", "size", "low", "high", "times", F.xxhash64("w", "v").alias("gram"))
    found = shared_bigrams(documents, known).select("row", "doc_id", "licence", _best_ends(threshold).alias("runs")).where(F.size("runs") > 0)
    by_dice = F.array_sort(F.transform("runs", lambda r: F.struct((-r["dice"]).alias("order"), r["start"].alias("start"), r["end"].alias("end"), r["common"].alias("common"))))
    own = found.select("row", "doc_id", "licence", F.explode(_apart(by_dice)).alias("r"))
    by_common = F.struct((-F.col("r.common")).alias("common"), F.col("r.order").alias("order"), F.col("licence").alias("licence"), F.col("r.start").alias("start"), F.col("r.end").alias("end"))
    # at most a run for each licence and place of a text
    best = own.groupBy("row", "doc_id").agg(F.array_sort(F.collect_list(by_common)).alias("runs"))
    out = best.select("doc_id", F.explode(_apart(F.col("runs"))).alias("r"))
    start, end = F.col("r.start").cast("long"), F.col("r.end").cast("long")
    return out.select("doc_id", "r.licence", start.alias("first_word"), (end - start + 2).alias("n_words"), (-F.col("r.order")).alias("dice"))


def oracle(templates: Mapping[str, str] | None = None, threshold: float = THRESHOLD) -> str:
    """The SQL twin: every start against every end, and the choice as a fold over sorted lists."""
    rows = template_rows(TEMPLATES if templates is None else templates, threshold)
    values = ", ".join(f"('{n}', {size}, {low}, {high}, '{gram}', {times})" for n, size, low, high, gram, times in rows)

    def apart(runs: str) -> str:
        meets = "list_filter(chosen, lambda c: c['end'] + 1 >= run[1]['start'] and run[1]['end'] + 1 >= c['start'])"
        return f"list_reduce(list_transform({runs}, lambda r: [r]), lambda chosen, run: case when len({meets}) > 0 then chosen else list_concat(chosen, run) end)"

    return rf"""
with t(licence, size, low, high, gram, times) as (values {values}),
d as (
  select row_number() over () as r, doc_id, string_split(trim(lower(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9]+', ' ', 'g'))), ' ') as w from documents
), g as (select r, doc_id, w, unnest(range(1, len(w))) as i from d),
h as (
  select r, doc_id, i - 1 as pos, t.*, row_number() over (partition by r, licence, gram order by i) as nth
  from g join t on t.gram = w[i] || ' ' || w[i + 1]
), k as (
  select h.*, coalesce(b.pos, -1) as prev from h left join h as b on b.r = h.r and b.licence = h.licence and b.gram = h.gram and b.nth = h.nth - h.times
), enough as (select r, licence from k group by r, licence, low having count(*) filter (nth <= times) >= low),
pairs as (
  select s.r, s.doc_id, s.licence, s.pos as start, e.pos as stop, e.pos - s.pos + 1 as n, s.size, s.low, s.high,
         sum((e.prev < s.pos)::int) over (partition by s.r, s.licence, s.pos order by e.pos) as common
  from k as s join enough on enough.r = s.r and enough.licence = s.licence
  join k as e on e.r = s.r and e.licence = s.licence and e.pos between s.pos and s.pos + s.high - 1
), best as (
  select r, doc_id, licence, start, arg_min({{'order': -(common * 2.0::double / (n + size)), 'start': start, 'end': stop, 'common': common::int}},
                                            (-(common * 2.0::double / (n + size)), stop)) as run
  from pairs where n between low and high group by r, doc_id, licence, start
), own as (
  select r, doc_id, licence, unnest({apart("list_sort(list(run))")}) as run from best where -run['order'] >= {threshold} group by r, doc_id, licence
), final as (
  select doc_id, unnest({apart("list_sort(list({'common': -run['common'], 'order': run['order'], 'licence': licence, 'start': run['start'], 'end': run['end']}))")}) as run
  from own group by r, doc_id
)
select doc_id, run['licence'] as licence, run['start']::bigint as first_word, (run['end'] - run['start'] + 2)::bigint as n_words, -run['order'] as dice from final
"""
