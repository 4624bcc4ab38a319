"""Licences of files by TF-IDF cosine to templates, inherited from the nearest directory that has one. Native: DataFrame
functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import sized, stored, table

# Titles, opening passages, headers and notices of public licences. SPDX tags follow from their names.
_GNU_VERBATIM = "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
_GNU_HEADER = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
    " This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {} for more details."
    " You should have received a copy of the GNU {} along with this program. If not, see <https://www.gnu.org/licenses/>."
)
_BSD_START = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
    " 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
    " 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD_NAMES = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = (
    " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."
    " IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)"
    " HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)


def _gnu(name: str, version: int) -> tuple[str, ...]:
    """The header as a whole, and its first paragraph."""
    whole = _GNU_HEADER.format(name, version, name, name)
    return whole, whole.partition(" This program is distributed")[0]


TEMPLATES: dict[str, tuple[str, ...]] = {
    "AGPL-3.0": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
        f"GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> {_GNU_VERBATIM} Preamble The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software.",
        *_gnu("Affero General Public License", 3),
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. \"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
        " Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    "BSD-2-Clause": ("BSD 2-Clause License", _BSD_START + _BSD_END, _BSD_START),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD 3-Clause License.",
        "BSD 3-Clause License",
        _BSD_START + _BSD_NAMES + _BSD_END,
        _BSD_START + _BSD_NAMES,
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0, the Creative Commons Attribution License.", "Creative Commons Attribution 4.0 International Public License"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "Creative Commons Attribution-NonCommercial 4.0 International Public License"),
    "CC0-1.0": ("To the extent possible under law, all rights are waived and the work is dedicated to the public domain under CC0 1.0.", "Creative Commons Legal Code CC0 1.0 Universal"),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA"
        " Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. Preamble The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users.",
        *_gnu("General Public License", 2),
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        f"GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> {_GNU_VERBATIM} Preamble The GNU General Public License is a free, copyleft license for software and other kinds of works."
        " The licenses for most software and other practical works are designed to take away your freedom to share and change the works. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change all versions of a program--to make sure it remains free software for all its users.",
        *_gnu("General Public License", 3),
    ),
    "ISC": (
        "ISC License",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
        " THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER"
        " RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    "LGPL-3.0": (
        "This library is licensed under the GNU Lesser General Public License, version 3.",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        f"GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> {_GNU_VERBATIM} This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below.",
        *_gnu("Lesser General Public License", 3),
    ),
    "MIT": (
        "Released under the MIT License.",
        "MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
        " The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
        " THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY,"
        " WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.",
        "Mozilla Public License Version 2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    "Proprietary": ("All rights reserved.",),
}
#: What only says that there is a copyright: it counts where no licence does.
LAST = "Proprietary"
#: What a line of a header says, names of licence files, terms, ends of lines, lines without a letter or digit.
CUE = r"licen[sc]|copyright|all rights|public domain|spdx|creative commons|hereby granted|redistribut"
LICENCE_FILE = r"(?i)(^|/)(licen[sc]e|copying|notice)[^/]*$"
TERM = r"[a-z0-9]+(?:[.][0-9]+)?"
LINE = r"\r\n|\r|\n"
BLANK = r"(?:\r\n|\r|\n)(?:[^\p{L}\p{N}\r\n]*(?:\r\n|\r|\n))+"
THRESHOLD = 0.4


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def _notices(templates: dict[str, tuple[str, ...]]) -> list[tuple[int, str, str]]:
    """Number, licence and text of each template; the SPDX tag of each licence is one."""
    rows = [(name, text) for name, texts in sorted(templates.items()) for text in (*texts, *[f"SPDX-License-Identifier: {name}"] * (name != LAST))]
    return [(k, name, text) for k, (name, text) in enumerate(rows)]


def licence_scan(files: DataFrame, templates: dict[str, tuple[str, ...]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of files(path, text): path, own_licence and score (of the template with the largest cosine to one of
    the file's headers; ties: the first by name; null under the threshold; LAST counts only if no other does), licence (own,
    else that of the nearest ancestor directory with a licence file) and inherited_from (that directory).

    Headers are, anywhere in a file, the lines with a licence cue and the blocks of lines (between lines without a letter or
    digit) with one; in licence files the whole text too, of any length. Document frequencies count every header of every
    file. Null and empty texts have no header; a null path has no directory; rows repeated with one path get one answer,
    that of all their texts; columns but path and text don't count. No files give no rows.

    Headers repeat, so each different one is scored once. Templates are fixed and broadcast; other narrow sides are
    broadcast only after a count. Directories are resolved once each, so a hot directory costs one row."""
    spark = files.sparkSession
    rows = files.select("path", F.regexp_replace("path", r"/?[^/]*$", "").alias("dir"), F.coalesce(F.col("path").rlike(LICENCE_FILE), F.lit(False)).alias("is_licence"), F.coalesce("text", F.lit("")).alias("text"))
    cued = F.filter(F.concat(F.split("text", LINE), F.split("text", BLANK)), lambda x: F.lower(x).rlike(CUE))
    cued = F.when(F.lower("text").rlike(CUE), cued).otherwise(F.array().cast("array<string>"))
    headers = F.array_distinct(F.when(F.col("is_licence"), F.concat(cued, F.array("text"))).otherwise(cued))
    rows = stored(rows.select("path", "dir", "is_licence", headers.alias("headers")), "files")  # the only pass over the texts
    found = rows.where(F.size("headers") > 0)
    found = stored(found.select("path", "dir", "is_licence", F.explode("headers").alias("header")).withColumn("id", F.sha2(F.col("header").cast("binary"), 256)), "headers")

    units = found.groupBy("id").agg(F.first("header").alias("header"), F.count(F.lit(1)).alias("n"))
    terms = stored(units.select("id", "n", F.explode(_terms(F.col("header"))).alias("term")).groupBy("id", "n", "term").agg(F.count(F.lit(1)).alias("tf")), "terms")
    total = found.count()
    counts = stored(terms.groupBy("term").agg(F.sum("n").alias("df")), "frequencies")
    idf = F.log((F.lit(total) + 1.0) / (F.coalesce("df", F.lit(0)) + 1.0)) + 1.0

    texts = spark.createDataFrame(_notices(templates or TEMPLATES), "template int, licence string, notice string")
    notice = texts.select("template", F.explode(_terms(F.col("notice"))).alias("term")).groupBy("template", "term").agg(F.count(F.lit(1)).alias("tf"))
    known = counts.join(F.broadcast(notice.select("term").distinct()), "term")
    notice = notice.join(F.broadcast(known), "term", "left").select("template", "term", (F.col("tf") * idf).alias("t"))
    length = notice.groupBy("template").agg(F.sqrt(F.sum(F.col("t") * F.col("t"))).alias("t_length"))
    notice = notice.join(F.broadcast(length), "template")

    weights = terms.join(sized(counts), "term").select("id", "term", (F.col("tf") * idf).alias("w"))
    lengths = weights.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    dots = weights.join(F.broadcast(notice), "term").groupBy("id", "template", "t_length").agg(F.sum(F.col("w") * F.col("t")).alias("dot"))
    scored = dots.join(lengths, "id").select("id", "template", F.round(F.col("dot") / F.col("length") / F.col("t_length"), 6).alias("score"))
    scored = scored.where(F.col("score") >= threshold).join(F.broadcast(texts.select("template", "licence")), "template")
    best = F.struct((F.col("licence") == LAST).alias("last"), (-F.col("score")).alias("minus"), "licence")
    best = stored(scored.groupBy("id").agg(F.min(best).alias("top")), "scores")

    matched = found.join(sized(best), "id").groupBy("path", "dir", "is_licence").agg(F.min("top").alias("top"))
    own = stored(matched.select("path", "dir", "is_licence", F.col("top.licence").alias("own_licence"), (-F.col("top.minus")).alias("score")), "own")
    order = F.struct((F.col("own_licence") == LAST).alias("last"), (-F.col("score")).alias("minus"), "own_licence")
    given = own.where("is_licence").groupBy("dir").agg(F.min(order).alias("top"))
    given = stored(given.select(F.col("dir").alias("inherited_from"), F.col("top.own_licence").alias("given")), "given")
    parts = F.split("dir", "/")
    above = F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/")))
    climbed = rows.where("dir is not null").select("dir").distinct().select("dir", above.alias("inherited_from"))
    near = climbed.join(sized(given), "inherited_from").groupBy("dir").agg(F.max_by(F.struct("inherited_from", "given"), F.length("inherited_from")).alias("near"))
    near = stored(near.select("dir", "near.*"), "nearest")

    out = rows.select("path", "dir").join(sized(own.select("path", "own_licence", "score")), "path", "left").join(sized(near), "dir", "left")
    mine = F.col("own_licence").isNotNull()
    return out.select("path", "own_licence", "score", F.coalesce("own_licence", "given").alias("licence"), F.when(~mine, F.col("inherited_from")).alias("inherited_from"))


#: The tree that documents stand for: directories by source, language and doc_id; texts with a cue and a doc_id divisible by 7
#: are licence files, on three levels of it.
_PATH = "concat_ws('/', coalesce(source, 'none'), if({licence} and pmod(doc_id, 3) = 0, null, coalesce(lang, 'none')), if({licence} and pmod(doc_id, 3) < 2, null, cast(pmod(doc_id, 50) as string)), concat(if({licence}, 'LICENSE_', 'doc_'), cast(doc_id as string), '.txt'))"


def op5_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """licence_scan of the tree that documents stand for, with doc_id. A null doc_id has a null path. Other columns don't
    count."""
    docs = table(spark, sf_dir, "documents")
    licence = f"coalesce(lower(text) rlike '{CUE}' and pmod(doc_id, 7) = 0, false)"
    files = docs.select(F.expr(_PATH.format(licence=licence)).alias("path"), "text")
    found = licence_scan(files)
    doc_id = F.regexp_extract("path", r"_(-?\d+)\.txt$", 1)
    return found.select(F.when(doc_id != "", doc_id.cast("long")).alias("doc_id"), "path", "own_licence", "score", "licence", "inherited_from")


_NOTICES = ", ".join("({}, '{}', '{}')".format(k, name, text.replace("'", "''")) for k, name, text in _notices(TEMPLATES))
OP5_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(text, '') AS text, is_licence,
         concat_ws('/', coalesce(source, 'none'), CASE WHEN is_licence AND doc_id % 3 = 0 THEN NULL ELSE coalesce(lang, 'none') END,
                   CASE WHEN is_licence AND ((doc_id % 3) + 3) % 3 < 2 THEN NULL ELSE CAST(((doc_id % 50) + 50) % 50 AS VARCHAR) END) AS dir
  FROM (SELECT *, coalesce(regexp_matches(lower(text), '{CUE}') AND doc_id % 7 = 0, false) AS is_licence FROM documents) x),
f AS (SELECT *, dir || '/' || CASE WHEN is_licence THEN 'LICENSE_' ELSE 'doc_' END || CAST(doc_id AS VARCHAR) || '.txt' AS path FROM d),
h AS (
  SELECT DISTINCT path, dir, is_licence, header FROM (
    SELECT path, dir, is_licence, unnest(list_concat(regexp_split_to_array(text, '{LINE}'), regexp_split_to_array(text, '{BLANK}'))) AS header FROM f WHERE regexp_matches(lower(text), '{CUE}')) x
  WHERE regexp_matches(lower(header), '{CUE}')
  UNION SELECT path, dir, is_licence, text FROM f WHERE is_licence),
u AS (SELECT header, count(*) AS n FROM h GROUP BY header),
t AS (SELECT header, n, term, count(*) AS tf FROM (SELECT header, n, unnest(regexp_extract_all(lower(header), '{TERM}')) AS term FROM u) x GROUP BY header, n, term),
df AS (SELECT term, sum(n) AS df FROM t GROUP BY term),
total AS (SELECT count(*) AS total FROM h),
w AS (SELECT header, t.term, tf * (ln((total + 1.0) / (df + 1.0)) + 1.0) AS w FROM t JOIN df ON t.term = df.term, total),
nt AS (SELECT template, term, count(*) AS tf FROM (SELECT template, unnest(regexp_extract_all(lower(notice), '{TERM}')) AS term FROM (VALUES {_NOTICES}) v(template, licence, notice)) x GROUP BY template, term),
nw AS (SELECT template, nt.term, tf * (ln((total + 1.0) / (coalesce(df, 0) + 1.0)) + 1.0) AS t FROM nt LEFT JOIN df ON nt.term = df.term, total),
nl AS (SELECT template, sqrt(sum(t * t)) AS l FROM nw GROUP BY template),
wl AS (SELECT header, sqrt(sum(w * w)) AS l FROM w GROUP BY header),
s AS (
  SELECT w.header, nw.template, round(sum(w.w * nw.t) / any_value(wl.l) / any_value(nl.l), 6) AS score
  FROM w JOIN nw ON w.term = nw.term JOIN wl ON wl.header = w.header JOIN nl ON nl.template = nw.template
  GROUP BY w.header, nw.template),
own AS (
  SELECT path, dir, is_licence, licence AS own_licence, score FROM (
    SELECT h.*, v.licence, s.score, row_number() OVER (PARTITION BY h.path ORDER BY v.licence = '{LAST}', s.score DESC, v.licence) AS k
    FROM h JOIN s ON h.header = s.header JOIN (VALUES {_NOTICES}) v(template, licence, notice) ON v.template = s.template WHERE s.score >= {THRESHOLD}) x WHERE k = 1),
given AS (
  SELECT dir, own_licence FROM (
    SELECT dir, own_licence, row_number() OVER (PARTITION BY dir ORDER BY own_licence = '{LAST}', score DESC, own_licence) AS k FROM own WHERE is_licence) x WHERE k = 1),
up(dir, above) AS (
  SELECT DISTINCT dir, dir FROM f
  UNION SELECT dir, regexp_replace(above, '/[^/]*$', '') FROM up WHERE contains(above, '/')),
near AS (
  SELECT dir, above, own_licence FROM (
    SELECT up.dir, up.above, given.own_licence, row_number() OVER (PARTITION BY up.dir ORDER BY length(up.above) DESC) AS k
    FROM up JOIN given ON up.above = given.dir) x WHERE k = 1)
SELECT f.doc_id, f.path, own.own_licence, own.score, coalesce(own.own_licence, near.own_licence) AS licence,
       CASE WHEN own.own_licence IS NULL THEN near.above END AS inherited_from
FROM f LEFT JOIN own ON f.path = own.path LEFT JOIN near ON f.dir = near.dir
"""
