"""Licence scan: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored

_AS_IS_MIT = (
    'The software is provided "as is", without warranty of any kind, express or implied, including but not limited to the warranties of '
    "merchantability, fitness for a particular purpose and noninfringement. In no event shall the authors or copyright holders be liable for any "
    "claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software "
    "or the use or other dealings in the software."
)
_AS_IS_BSD = (
    'This software is provided by the copyright holders and contributors "as is" and any express or implied warranties, including, but not limited '
    "to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed. In no event shall the copyright holder or "
    "contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, "
    "procurement of substitute goods or services; loss of use, data, or profits; or business interruption) however caused and on any theory of "
    "liability, whether in contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the use of this "
    "software, even if advised of the possibility of such damage."
)
_BSD_TWO = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution. "
)
_BSD_NAMES = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
    "software without specific prior written permission. "
)
_GNU_REST = (
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY "
    "or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} for more details. You should have received a copy of the GNU {0} along with this program. "
    "If not, see <https://www.gnu.org/licenses/>."
)
_GNU_HEAD = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software "
    "Foundation, either version {} of the License, or (at your option) any later version. "
)
_GNU_LIBRARY = (
    "This library is free software; you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software "
    "Foundation; either version {} of the License, or (at your option) any later version. "
)
_MPL_OLD = (
    'The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License"); you may not use this file except in compliance '
    "with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/ Software distributed under the License is distributed on an "
    '"AS IS" basis, WITHOUT WARRANTY OF ANY KIND, either express or implied. See the License for the specific language governing rights and limitations '
    "under the License."
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
    'copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH '
    "REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, "
    "DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
    "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_GNU = {"": "General Public License", "L": "Lesser General Public License", "A": "Affero General Public License"}

#: Notices as licences word them, in one line, as headers, and as whole files where a licence is short.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, version 3"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted. BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("Proprietary", "All rights reserved."),
    ("Proprietary", "Copyright. All rights reserved."),
    (
        "MIT", "MIT License. Copyright (c). Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, '
        "merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial "
        "portions of the Software. " + _AS_IS_MIT,
    ),
    ("BSD-2-Clause", _BSD_TWO + _AS_IS_BSD),
    ("BSD-3-Clause", _BSD_TWO + _BSD_NAMES + _AS_IS_BSD),
    (
        "Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or '
        "implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    (
        "MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with "
        "this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    *((f"{k}GPL-{v}.0", _GNU_HEAD.format(name, v) + _GNU_REST.format(name))
      for k, v, name in (("", 2, _GNU[""]), ("", 3, _GNU[""]), ("L", 3, _GNU["L"]), ("A", 3, _GNU["A"]))),
    ("GPL-1.0", _GNU_HEAD.format(_GNU[""], 1).replace(":", ";") + _GNU_REST.format(_GNU[""])),
    *((f"LGPL-{v}", _GNU_LIBRARY.format(name, year) + _GNU_REST.format(name).replace("program", "library")) for v, name, year in (
        ("2.0", "Library General Public License", "2"), ("2.1", _GNU["L"], "2.1"))),
    ("MPL-1.1", _MPL_OLD),
    ("ISC", _ISC),
    ("BSD-3-Clause", _BSD_TWO + _BSD_NAMES.replace("the copyright holder", "the University") + _AS_IS_BSD.replace("copyright holder", "regents")),
    # An SPDX tag is one word, so that no other tag comes near it.
    *((name, "spdx" + tag) for name, tags in (
        ("MIT", "mit"), ("Apache-2.0", "apache20"), ("BSD-2-Clause", "bsd2clause"), ("BSD-3-Clause", "bsd3clause"), ("MPL-2.0", "mpl20"),
        ("GPL-2.0", "gpl20 gpl20only gpl20orlater"), ("GPL-3.0", "gpl30 gpl30only gpl30orlater"),
        ("LGPL-3.0", "lgpl30 lgpl30only lgpl30orlater"), ("AGPL-3.0", "agpl30 agpl30only agpl30orlater"),
        ("GPL-1.0", "gpl10 gpl10only gpl10orlater"), ("LGPL-2.0", "lgpl20 lgpl20only lgpl20orlater"),
        ("LGPL-2.1", "lgpl21 lgpl21only lgpl21orlater"), ("MPL-1.1", "mpl11"), ("ISC", "isc"), ("Artistic-1.0", "artistic10 artistic10perl"),
        ("CC-BY-4.0", "ccby40"), ("CC-BY-SA-4.0", "ccbysa40"), ("CC-BY-NC-4.0", "ccbync40"), ("CC0-1.0", "cc010"),
    ) for tag in tags.split()),
]
#: How long licences name themselves at their head. In a licence file the first of these decides.
TITLES = [
    ("GPL-1.0", "GNU GENERAL PUBLIC LICENSE Version 1, February 1989"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.0", "GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("GFDL-1.2", "GNU Free Documentation License Version 1.2, November 2002"),
    ("GFDL-1.3", "GNU Free Documentation License Version 1.3, 3 November 2008"),
    ("MPL-1.1", "MOZILLA PUBLIC LICENSE Version 1.1"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Artistic-1.0", 'The "Artistic License"'),
    ("CC0-1.0", "Creative Commons CC0 1.0 Universal"),
    ("EPL-1.0", "Eclipse Public License - v 1.0"),
    ("EPL-2.0", "Eclipse Public License - v 2.0"),
]
#: All that notices are compared with: templates, then titles.
KNOWN = [*TEMPLATES, *TITLES]
#: A line that says one of these is a notice to score.
TRIGGER = r"(?i)licen[cs]|copyright|rights reserved|public domain|spdx|permission is hereby granted|redistribution and use|creative commons|cc0 1"
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|unlicense|notice)"
#: Words keep the dots of version numbers; those that hold a digit weigh so many times as much.
WORD = r"[a-z0-9]+(?:\.[0-9]+)*"
VERSION = 2.0
#: The least score, and by how much the best licence must lead the next.
THRESHOLD, MARGIN = 0.6, 0.004
#: Lines of more words are also cut into windows of so many, each a fifth after the one before.
LONG, WINDOWS = 80, (10, 40)
SPDX = r"(?i)spdx-license-identifier:\s*([a-z0-9.+-]+)"
#: Blocks end at lines without letters and digits, and where lines with a comment mark do.
BREAK = r"\n[^\p{L}\p{N}\n]*\n"
MARKED = r"(\n[ \t]*[#/*;%-][^\n]*)(\n[ \t]*[^#/*;%\- \t\n])"
#: A text of several lines; takes linear time on a long line.
LINES = r"\S[^\S\n]*\n\s*\S"
#: Candidates by what they are: in a licence file a title goes before the whole text, that before a block, a block before a line.
TITLE, WHOLE, BLOCK, LINE = 0, 1, 2, 3


def _words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))


def _counts(frame: DataFrame, key: list[str], text: str) -> DataFrame:
    return frame.select(*key, F.explode(_words(F.col(text))).alias("word")).groupBy(*key, "word").agg(F.count("*").alias("tf"))


def template_frame(spark: SparkSession) -> DataFrame:
    rows = [(k, name, text) for k, (name, text) in enumerate(KNOWN)]
    return spark.createDataFrame(rows, "template int, licence string, template_text string")


def _flat(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def _candidate(text: Column, kind: int, no: Column) -> Column:
    return F.struct(text.alias("notice"), F.lit(kind).alias("kind"), no.cast("int").alias("no"))


def candidates(name: Column, text: Column) -> Column:
    """Array of ``notice, kind, no``: lines, or windows of long ones, and blocks of several lines that speak of a licence, and a licence file's whole text."""
    line = lambda x: F.when(
        F.regexp_extract(x, SPDX, 1) != "", F.concat(F.lit("spdx"), F.lower(F.regexp_replace(F.regexp_extract(x, SPDX, 1), "[^A-Za-z0-9]", "")))
    ).otherwise(_flat(x))
    told = lambda f, kind: F.filter(
        F.transform(f, lambda x, i: F.struct(x.alias("x"), i.alias("i"))),
        lambda s: s["x"].rlike(TRIGGER) & (s["x"].rlike(LINES) if kind == BLOCK else F.lit(True)),
    )
    split = F.split(text, "\n")
    lines = F.transform(told(split, LINE), lambda s: _candidate(line(s["x"]), LINE, s["i"]))
    words = lambda x: F.split(_flat(x), " ")
    long = F.filter(told(split, LINE), lambda s: F.size(words(s["x"])) > LONG)
    starts = F.array(*(F.lit(size) for size in WINDOWS))
    part = lambda w, size: F.transform(F.sequence(F.lit(0), F.size(w) - 1, (size / 5).cast("int")), lambda n: F.array_join(F.slice(w, n + 1, size), " "))
    cut = lambda s: F.flatten(F.transform(F.array(words(s["x"])), lambda w: F.flatten(F.transform(starts, lambda size: part(w, size)))))
    window = lambda s: F.transform(F.filter(cut(s), lambda x: x.rlike(TRIGGER)), lambda x: _candidate(x, LINE, s["i"]))
    lines = F.concat(lines, F.flatten(F.transform(long, window)))
    blocks = F.split(F.regexp_replace(F.concat(F.lit("\n"), text), MARKED, "$1\n$2"), BREAK)
    blocks = F.transform(told(blocks, BLOCK), lambda s: _candidate(_flat(s["x"]), BLOCK, s["i"]))
    none = F.expr("cast(array() as array<struct<notice:string,kind:int,no:int>>)")
    whole = F.when(name.rlike(LICENCE_FILE) & (text != ""), F.array(_candidate(_flat(text), WHOLE, F.lit(0)))).otherwise(none)
    return F.coalesce(F.concat(F.when(text.rlike(TRIGGER), F.concat(lines, blocks)).otherwise(none), whole), none)


def notice_key(c: str) -> Column:
    """128 bits that stand for a notice, so that words of long ones don't carry their texts."""
    return F.struct(F.xxhash64(c).alias("a"), F.xxhash64(F.lit(7), c).alias("b"))


def _weight(tf: Column, idf: Column, word: Column) -> Column:
    """Sublinear tf times idf; words that hold a digit, such as versions, count more."""
    return (F.log(tf) + 1) * idf * F.when(word.rlike("[0-9]"), VERSION).otherwise(1.0)


def notice_scores(notices: DataFrame, templates: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The best licence of each different ``notice`` by its ``key``: ``key, licence, score, template``.

    Weights are 1 + ln tf times ln((1 + N) / (1 + df)) + 1, where N and df count
    the templates, so that a notice's score doesn't depend on what else is scanned;
    a word in no template has a df of 0. A notice as near to a template of another licence, but for
    ``MARGIN``, has none. Ties within a licence go to the template that comes first.
    """
    words = _counts(notices.dropDuplicates(["key"]), ["key"], "notice")
    # Templates are a fixed list, so all that is made of them may be broadcast.
    shape = _counts(templates, ["template", "licence"], "template_text")
    n = len(KNOWN)
    idf = shape.groupBy("word").agg((F.log(F.lit(1.0 + n) / (1 + F.count("*"))) + 1).alias("idf"))
    shape = shape.join(idf, "word").withColumn("tw", _weight(F.col("tf"), F.col("idf"), F.col("word"))).select("template", "licence", "word", "tw")
    size = shape.groupBy("template", "licence").agg(F.sqrt(F.sum(F.col("tw") * F.col("tw"))).alias("tnorm"))
    held = shape.groupBy("word").agg(F.collect_list(F.struct("template", "tw")).alias("shapes")).join(idf, "word")
    weighed = words.join(F.broadcast(held), "word", "left").select(
        "key", "shapes", _weight(F.col("tf"), F.coalesce("idf", F.log(F.lit(1.0 + n)) + 1), F.col("word")).alias("w")
    )
    # One pass over the words: their own norm and their products with the templates that hold them.
    norm = F.struct(F.lit(-1).alias("template"), F.col("w").alias("tw"))
    each = weighed.select("key", "w", F.explode(F.concat(F.array(norm), F.coalesce("shapes", F.expr("cast(array() as array<struct<template:int,tw:double>>)")))).alias("s"))
    dots = each.groupBy("key", F.col("s.template").alias("template")).agg(F.sum(F.col("w") * F.col("s.tw")).alias("dot"))
    length = dots.filter("template = -1").select(F.col("key").alias("of"), F.sqrt("dot").alias("norm"))
    scored = dots.filter("template >= 0").join(length, F.col("key") == F.col("of")).join(F.broadcast(size), "template")
    scored = scored.withColumn("score", F.round(F.col("dot") / F.col("norm") / F.col("tnorm"), 6)).filter(F.col("score") >= threshold - MARGIN)
    by = scored.groupBy("key", "licence").agg(F.min(F.struct((-F.col("score")).alias("s"), "template")).alias("b"))
    best = by.groupBy("key").agg(F.sort_array(F.collect_list(F.struct(F.col("b.s").alias("s"), "licence", F.col("b.template").alias("template")))).alias("all"))
    lead = F.coalesce(F.get("all", F.lit(1))["s"] - F.col("all")[0]["s"], F.lit(1.0))
    best = best.filter((F.col("all")[0]["s"] <= -threshold) & (F.round(lead, 6) >= MARGIN))
    return best.select("key", F.col("all")[0]["licence"].alias("licence"), (-F.col("all")[0]["s"]).alias("score"), F.col("all")[0]["template"].alias("template"))


def license_scan(files: DataFrame, path_col: str = "path", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Licence of every file: ``path, licence, score, origin, origin_path``.

    Scored against the templates are, of whole texts, every line and every block of lines
    that says it is about a licence, and licence files as a whole; a long line also in
    windows. A file's own licence is, in a licence file, that of the first title of a
    licence, else that of the whole file, else of the best block, else of the best line, the earlier of
    equals. An SPDX tag in a line is compared as one word. What is nearly as close to
    another licence, or near none, has no licence.
    Files without one inherit from the licence file in their own or else their
    nearest ancestor directory; of several licence files in one directory the best score,
    then the least path holds. ``origin`` is ``own``, ``inherited`` or ``none``. Null
    and empty texts have no licence of their own; a null path inherits nothing. Repeated
    rows are each returned. Nothing here runs outside Spark's own expressions.
    """
    spark = files.sparkSession
    rows = files.select(F.col(path_col).cast("string").alias("path"), F.col(text_col).cast("string").alias("t"))
    path = F.regexp_replace("path", "^/+", "")
    found = rows.select(
        "path", F.regexp_replace(path, "/?[^/]*$", "").alias("dir"), F.regexp_extract(path, "[^/]*$", 0).alias("name"),
        candidates(F.coalesce(F.regexp_extract(path, "[^/]*$", 0), F.lit("")), F.col("t")).alias("told"),
    )
    found = found.withColumn("row", F.monotonically_increasing_id())
    found = stored(found, "notices")
    each = found.filter(F.size("told") > 0).select("row", F.col("name").rlike(LICENCE_FILE).alias("file"), F.explode("told").alias("x")).select("row", "file", "x.*").withColumn("key", notice_key("notice"))
    scores = notice_scores(each.select("key", "notice"), template_frame(spark), threshold)
    # A hash of the key, so that both sides have exchanges of their own and a hot notice's can be split.
    scores = scores.select(F.xxhash64("key").alias("k"), F.col("key").alias("scored"), "licence", "score", "template")
    hits = each.select("row", "file", "kind", "no", "key").withColumn("k", F.xxhash64("key")).join(scores, "k").filter("key = scored")
    titled = F.col("file") & (F.col("template") >= len(TEMPLATES)) & (F.col("kind") != WHOLE)
    hits = hits.withColumn("kind", F.when(titled, TITLE).otherwise(F.col("kind")))
    place = F.when(titled, F.col("no")).otherwise(-1)
    own = hits.groupBy("row").agg(F.min(F.struct("kind", place.alias("place"), (-F.col("score")).alias("s"), "no", "licence")).alias("b"))
    own = own.select("row", F.col("b.licence").alias("own"), (-F.col("b.s")).alias("own_score"))
    files_ = found.select("row", "path", "dir", "name").join(own, "row", "left")
    # One licence for each directory that has a licence file.
    given = files_.filter(F.col("own").isNotNull() & F.col("name").rlike(LICENCE_FILE) & F.col("path").isNotNull())
    given = given.groupBy("dir").agg(F.min(F.struct((-F.col("own_score")).alias("s"), "path", "own")).alias("b"))
    given = given.select(F.col("dir").alias("up"), F.col("b.own").alias("up_licence"), (-F.col("b.s")).alias("up_score"), F.col("b.path").alias("up_path"))
    # Ancestors of each different directory, itself included, joined by path; the deepest wins.
    parts = F.split("dir", "/")
    ups = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    dirs = files_.filter("dir is not null").select("dir").distinct()
    up = dirs.select("dir", F.explode(F.array_distinct(ups)).alias("up")).join(given, "up")
    nearest = up.groupBy("dir").agg(F.max_by(F.struct("up_licence", "up_score", "up_path"), F.length("up")).alias("up"))
    nearest = nearest.select(F.xxhash64("dir").alias("k"), F.col("dir").alias("d"), "up.*")
    left = files_.withColumn("fk", F.xxhash64("dir"))
    joined = left.join(nearest, (F.col("fk") == F.col("k")) & (F.col("dir") == F.col("d")), "left")
    has_own = F.col("own").isNotNull()
    return joined.select(
        "path",
        F.coalesce("own", "up_licence").alias("licence"),
        F.coalesce("own_score", "up_score").alias("score"),
        F.when(has_own, "own").when(F.col("up_licence").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(has_own, F.col("path")).otherwise(F.col("up_path")).alias("origin_path"),
    )
