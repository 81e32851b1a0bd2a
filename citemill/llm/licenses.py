"""Operator 4, license scans by MinHash bands over overlapping windows. Main path: DataFrame functions only.

Words are lower-cased and split at white space and ASCII punctuation. Templates are notices and headers, or
whole licence bodies of any length. A template of m 3-word shingles is sought in windows of `window_size(m)`
consecutive shingles of the text, a quarter more to twice as many, that start every quarter of a window; every
occurrence lies wholly inside one. Windows and templates have `BANDS` MinHash values, each a band of one row,
over all their own shingles; windows that share a band with a template are verified by exact shingle
containment of at least `LEAST`, in which all shingles with a digit (version numbers) must occur. A window
that holds `LEAST` of a template has a similarity s of `least_similarity(m)` at least, 0.25 for one
shingle and over 0.37 beyond, and bands miss it with a probability of (1 - s) ** 64, 10 ** -8 at most:

    similarity         0.05   0.10    0.25      0.37      0.50      0.80
    retrieved          0.962  0.9988  1 - 1e-8  1 - 1e-13 1 - 5e-20 1 - 2e-45

A band of a window can only equal a template's if the window holds the one shingle that is the template's
least there. So windows around such shingles are found first, by a join with these few, and only they are
signed and fetched again by a hash of id and text: the same matches as by signing every window.

Templates of fewer than three words have no shingle; they are matched by their exact sequence of words, which
counts as one shingle. A template without any word matches nothing. The templates are a parameter of the
caller's making, a list that is sent to all executors. Null and empty texts match nothing. A null doc_id
takes part. Rows that repeat in full count once; rows that only share an id are told apart by a hash of their
text. Empty tables give an empty result. Extra columns don't matter.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citemill.llm.rows import row_key, small, spread
from citemill.runtime import materialize, table

SHINGLE, BANDS, LEAST = 3, 64, 0.8
#: Starts of windows in a window.
STARTS = 4
MAX_TEMPLATES = 5000
GAPS = r"[\x09-\x0D\x20-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]+"

#: Well-known notices and the openings of licence texts.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    (
        "BSD",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met",
    ),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    (
        "LGPL-2.1",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    (
        "AGPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, "
        "compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, "
        "commercial or non-commercial, and by any means.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" "
        "AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND "
        "FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
        "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
        "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software "
        "is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be "
        "included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY "
        "KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
        "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
        "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR "
        "OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
        "the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of "
        "the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
        "without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY "
        "EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
        "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, "
        "INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
        "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN "
        "CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, "
        "EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    ("Proprietary", "All rights reserved."),
)


def template_words(text: str) -> list[str]:
    return [w for w in re.split(GAPS, text.lower()) if w]


def window_size(shingles: int) -> int:
    """Shingles of the windows in which a template of so many is sought: 4, 8, 12, 16, 24, 32, 48, 64, ..."""
    size = STARTS
    while 3 * size < 4 * shingles:
        size = size * 2 if size < 8 else size * 3 // 2 if size & (size - 1) == 0 else size * 4 // 3
    return size


def least_similarity(shingles: int, least: float = LEAST) -> float:
    """The least Jaccard similarity to a template of a window that holds `least` of its shingles."""
    need = math.ceil(least * shingles - 1e-9)
    return need / (window_size(shingles) + shingles - need)


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), GAPS), lambda w: w != "")


def _hashes(text: Column) -> Column:
    return F.transform(_words(text), lambda w: F.xxhash64(w))


def _shingles(h: str) -> Column:
    """The shingles of an array of hashes, in order."""
    at = F.when(F.size(h) >= SHINGLE, F.sequence(F.lit(0), F.size(h) - SHINGLE)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(SHINGLE)]))


def _minima(shingles: Column) -> list[Column]:
    """For each band, the least hash of the shingles, with the shingle."""
    return [F.array_min(F.transform(shingles, lambda s: F.struct(F.xxhash64(s, F.lit(b)).alias("h"), s.alias("s")))) for b in range(BANDS)]  # noqa: B023


def template_table(spark: SparkSession, templates: tuple[tuple[str, str], ...]) -> DataFrame:
    """template, license, kind (window size), of (shingles), set and must (those with a digit) of each template that has a shingle."""
    if len(templates) > MAX_TEMPLATES:
        raise ValueError(f"over {MAX_TEMPLATES} templates")
    rows = []
    for i, (name, text) in enumerate(templates):
        words = template_words(text)
        n = len(words) - SHINGLE + 1
        if n > 0:
            digits = [k for k in range(n) if any(c.isdigit() for w in words[k : k + SHINGLE] for c in w)]
            rows.append((i, name, window_size(n), text, digits))
    made = spark.createDataFrame(rows, "template int, license string, kind int, text string, digits array<int>")
    made = made.withColumn("h", _hashes(F.col("text"))).withColumn("all", _shingles("h"))
    must = F.array_distinct(F.transform("digits", lambda i: F.get("all", i)))
    return made.withColumns({"set": F.array_distinct("all"), "must": must}).select("template", "license", "kind", F.size("set").alias("of"), "set", "must")


def _short_matches(rows: DataFrame, templates: tuple[tuple[str, str], ...]) -> DataFrame:
    """The columns of `license_matches` for the templates that are too short for a shingle, at their first place."""
    few = [(i, name, len(template_words(text)), text) for i, (name, text) in enumerate(templates) if 0 < len(template_words(text)) < SHINGLE]
    known = rows.sparkSession.createDataFrame(few, "template int, license string, length int, text string")
    known = known.select("template", "license", "length", F.xxhash64(_hashes(F.col("text"))).alias("sequence"))

    def sequences(n: int) -> DataFrame:
        at = F.sequence(F.lit(0), F.size("h") - n)
        found = F.transform(at, lambda i: F.xxhash64(F.slice("h", i + 1, n)))
        return rows.where(F.size("h") >= n).select("doc_id", "row", F.lit(n).alias("length"), F.posexplode(found).alias("at", "sequence"))

    first, *more = [sequences(n) for n in sorted({x[2] for x in few})]
    words = first.unionByName(more[0]) if more else first
    met = words.join(F.broadcast(known), ["length", "sequence"]).groupBy("doc_id", "row", "license", "template", "length").agg(F.min("at").alias("start"))
    return met.select("doc_id", "row", "license", "template", F.lit(1).alias("matched"), F.lit(1).alias("of"), "start", (F.col("start") + F.col("length") - 1).alias("end"))


def license_matches(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """(doc_id, row, license, template, matched, of, start, end): each template that a document holds, at its best window.

    `row` is a hash of id and text; `start` and `end` are the numbers of the first and last word that the
    matched shingles cover there.
    """
    known = materialize(template_table(docs.sparkSession, templates), "templates")
    rows = docs.select("doc_id", row_key().alias("row"), "text")
    least_of = known.select("template", "license", "kind", "of", "set", "must", F.posexplode(F.array(*_minima(F.col("set")))).alias("band", "least"))
    wanted = materialize(least_of.select("template", "kind", "band", "least.h", "least.s"), "bands")

    # windows that hold the least shingle of some template
    starters = wanted.groupBy(F.col("s").alias("shingle")).agg(F.collect_set("kind").alias("kinds"))
    zipped = F.arrays_zip(*[F.slice("h", k + 1, F.size("h")).alias(f"h{k}") for k in range(SHINGLE)])
    words = rows.select("row", _hashes(F.col("text")).alias("h")).select("row", F.posexplode(zipped).alias("at", "w")).where(f"w.h{SHINGLE - 1} is not null")
    words = words.select("row", "at", F.xxhash64(*[F.col(f"w.h{k}") for k in range(SHINGLE)]).alias("shingle"))
    hits = words.join(F.broadcast(starters), "shingle").select("row", "at", F.explode("kinds").alias("kind"))
    latest = F.expr(f"at div (kind div {STARTS})")
    windows = hits.select("row", "kind", F.explode(F.array(*[latest - k for k in range(STARTS)])).alias("window")).where("window >= 0")
    windows = materialize(windows.groupBy("row").agg(F.collect_set(F.struct("kind", "window")).alias("windows")), "windows")

    # their own shingles, signed
    texts = spread(rows.join(small(windows.select("row")), "row", "left_semi"), "row").dropDuplicates(["row"]).select("row", "doc_id", _hashes(F.col("text")).alias("h"))
    texts = texts.select("row", "doc_id", _shingles("h").alias("all")).join(windows, "row")
    begin = lambda w: w["window"].cast("int") * (w["kind"] / STARTS).cast("int")
    held = F.transform("windows", lambda w: F.struct(w["kind"].alias("kind"), begin(w).alias("at"), F.slice("all", begin(w) + 1, w["kind"]).alias("own")))
    signed = texts.select("row", "doc_id", F.explode(held).alias("w")).select("row", "doc_id", "w.kind", "w.at", "w.own")
    bands = signed.select("*", F.posexplode(F.array(*[x["h"] for x in _minima(F.col("own"))])).alias("band", "h"))
    met = bands.join(F.broadcast(wanted.select("template", "kind", "band", "h")), ["kind", "band", "h"])
    met = met.groupBy("row", "doc_id", "kind", "at", "template").agg(F.first("own").alias("own"))

    # exact containment
    met = met.join(F.broadcast(known.select("template", "license", "of", "set", "must")), "template")
    met = met.withColumn("matched", F.size(F.array_intersect("own", "set"))).where(F.col("matched") >= F.col("of") * least)
    met = met.where(F.size(F.array_intersect("own", "must")) == F.size("must"))
    places = F.filter(F.transform("own", lambda s, i: F.when(F.array_contains("set", s), i)), lambda i: i.isNotNull())
    met = met.withColumns({"start": F.col("at") + F.array_min(places), "end": F.col("at") + F.array_max(places) + (SHINGLE - 1)})
    best = F.max(F.struct("matched", (-F.col("start")).alias("s"), (-F.col("end")).alias("e"))).alias("best")
    out = met.groupBy("row", "doc_id", "license", "template", "of").agg(best)
    out = out.select(
        "doc_id", "row", "license", "template", F.col("best.matched").alias("matched"), "of", (-F.col("best.s")).alias("start"), (-F.col("best.e")).alias("end")
    )
    if any(0 < len(template_words(text)) < SHINGLE for _, text in templates):
        return out.unionByName(_short_matches(rows.withColumn("h", _hashes(F.col("text"))), templates))
    return out


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every template in every one of `documents`: doc_id, license, template, matched, of, start, end."""
    return license_matches(table(spark, sf_dir, "documents")).drop("row")


_VALUES = ", ".join(
    f"({i}, '{name}', {window_size(len(template_words(text)) - SHINGLE + 1)}, '{' '.join(template_words(text))}')" for i, (name, text) in enumerate(TEMPLATES)
)
ORACLE_SQL = f"""
with t(template, license, kind, words) as (values {_VALUES}),
tw as (select template, license, kind, string_split(words, ' ') as w from t),
ts as (select distinct template, license, kind, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2])) as s from tw),
tn as (select template, count(*) as n, count(*) filter (where regexp_matches(s, '[0-9]')) as must from ts group by 1),
d as (
  select distinct doc_id, text, list_filter(regexp_split_to_array(lower(text), '{GAPS}'), lambda x: x <> '') as w from documents),
ds as (
  select doc_id, text, generate_subscripts(w, 1) - 1 as pos, unnest(list_transform(range(1, len(w) + 1), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2])) as s from d),
hit as (select doc_id, text, pos, ds.s, template, license, unnest(list_transform(range(0, {STARTS}), lambda k: pos // (kind // {STARTS}) - k)) as win from ds join ts on ds.s = ts.s),
per as (
  select doc_id, text, license, template, win, count(distinct s) as matched, count(distinct s) filter (where regexp_matches(s, '[0-9]')) as dated, min(pos) as a, max(pos) + 2 as b
  from hit where win >= 0 group by all),
good as (select per.*, n from per join tn using (template) where matched >= n * {LEAST} and dated = must),
best as (select *, row_number() over (partition by doc_id, text, template order by matched desc, a, b) as r from good)
select doc_id, license, template, matched::int as matched, n::int as "of", a::int as start, b::int as "end" from best where r = 1
"""
