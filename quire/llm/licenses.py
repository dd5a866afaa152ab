"""License scans in DataFrame functions alone.

Words are runs of ASCII letters (A-Z lower-cased), digits and non-ASCII characters. Templates and texts are compared by
five-word shingles. A text is cut into overlapping windows that are a little longer than a template's span, at so small steps
that every occurrence of a span lies whole in one of them. MinHash bands of one row each retrieve templates: a span whose
shingles are a share J of a window's union meets it in one of b bands with a chance of 1 - (1 - J)^b. A window around an
unaltered span has J of 0.8 or more, and even where half of the union differs, 32 bands miss with a chance of 2e-10.
Retrieved templates are verified by exact containment of all their shingles in the text around the window.

A band can only meet if its smallest hash belongs to a shingle that both sides have. So windows that share no shingle with
any template are left out before hashing: that loses nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE = 5
BANDS = 32
#: Words of a template that one window has to hold whole, and the step from window to window. A template has the longest span
#: of which it holds two; the shorter ones have 8 or 5.
SPANS = ((5, 1), (8, 2), (16, 4), (32, 8))
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Templates that may be broadcast and put into the plan: some megabytes.
MOST_TEMPLATES = 2_000

# Public licence notices, by SPDX identifier.
NOTICES = {
    "MIT-notice": "Released under the MIT License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-2.1-or-later": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


def notices(spark: SparkSession) -> DataFrame:
    """``license, text`` of the built-in templates."""
    rows = ", ".join("('{}', '{}')".format(k, v.replace("'", "\\'")) for k, v in NOTICES.items())
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(license, text)")


def words(text: Column) -> Column:
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(lower, F.lit(WORD), F.lit(0))


def shingles(w: str | Column, size: int = SHINGLE) -> Column:
    """64-bit hashes of all ``size`` successive words, in order."""
    w = F.col(w) if isinstance(w, str) else w
    none = F.array().cast("array<bigint>")
    at = F.sequence(F.lit(1), F.size(w) - size + 1)
    return F.when(F.size(w) < size, none).otherwise(F.transform(at, lambda i: F.xxhash64(F.slice(w, i, size))))


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f(x)`` with ``x`` evaluated once: as a lambda's variable, not copied into the lambdas of ``f``."""
    return F.element_at(F.transform(F.array(x), f), 1)


def minhashes(x: Column, bands: int = BANDS) -> Column:
    """The smallest of all hashes under each of ``bands`` hash functions: multiply-xor permutations of 64-bit hashes."""
    return F.transform(F.sequence(F.lit(1), F.lit(bands)), lambda b: F.array_min(F.transform(x, lambda h: F.xxhash64(h, b))))


def scan(docs: DataFrame, templates: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", least: float = 0.75, bands: int = BANDS) -> DataFrame:
    """``<id>, license, containment, start, stop``: each template (``license, text``) that a text holds, once per row of
    ``docs``, with the share of the template's shingles that the best place holds (``least`` or more) and that place's words.

    Whole texts of any length are searched. Null, empty and short texts (under five words) hold nothing, and templates under
    five words are never found; an empty table gives no rows. Repeated rows with one id give one result, of texts that share
    an id each is searched, and a null id is an id of its own. Of places that tie the first counts. Templates with one name are
    one template with several texts. Other columns are not read.
    """
    spark = docs.sparkSession
    known = (notices(spark) if templates is None else templates.select("license", "text")).select("license", words(F.col("text")).alias("tw"))
    known = known.where(F.size("tw") >= SHINGLE).distinct().withColumn("ts", let(F.col("tw"), lambda w: F.array_distinct(shingles(w))))
    assert known.count() <= MOST_TEMPLATES, "too many templates for the plan; scan in several runs"
    vocabulary = [r[0] for r in known.select(F.explode("ts")).distinct().collect()]  # a hash set in the plan: one look-up for a shingle
    likely = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"), let(words(F.col(text_col)), lambda w: shingles(w)).alias("s")).where(F.exists("s", lambda h: h.isin(vocabulary)))
    # A template is known by its successive spans; a window that holds one retrieves it.
    n = F.size("tw")
    span = F.when(n >= 64, 32).when(n >= 32, 16).when(n >= 8, 8).otherwise(5)
    step = F.greatest(F.lit(1), F.floor(F.col("span") / 2).cast("int"))
    spans = known.withColumn("span", span).select("license", "tw", "ts", "span", F.explode(F.sequence(F.lit(1), F.size("tw") - F.col("span") + 1, step)).alias("at"))
    spans = spans.select("license", "tw", "ts", "span", F.posexplode(let(let(F.expr("slice(tw, at, span)"), lambda w: F.array_distinct(shingles(w))), lambda x: minhashes(x, bands))).alias("band", "low"))
    spans = spans.distinct()
    # Windows of span + step - 1 words at every step-th word, as far as they hold a shingle of any template.
    hits = F.filter(F.transform("s", lambda h, i: F.when(h.isin(vocabulary), i)), lambda i: i.isNotNull())
    found = likely.select("id", "key", "s", F.explode(F.array(hits)).alias("hits"))

    def begins(size: int, step: int) -> Column:
        room = size + step - 1 - SHINGLE
        around = F.transform("hits", lambda i: F.sequence(F.ceil(F.greatest(F.lit(0), i - room) / step).cast("int"), F.floor(i / step).cast("int")))
        return F.transform(F.array_distinct(F.flatten(around)), lambda k: F.struct(F.lit(size).alias("size"), F.lit(size + step - 1 - SHINGLE + 1).alias("width"), (k * step).alias("from")))

    windows = found.select("id", "key", "s", F.explode(F.flatten(F.array(*(begins(*x) for x in SPANS)))).alias("w")).select("id", "key", "s", "w.*")
    # A generated column is computed once, however often it is used.
    windows = windows.select("id", "key", "s", "size", "from", F.explode(F.array(F.array_distinct(F.expr("slice(s, from + 1, width)")))).alias("part"))
    # What a template can span around the window goes along; it is a few hundred words at most.
    longest = known.agg(F.max(F.size("tw"))).first()[0] or 0
    lead = F.greatest(F.lit(0), F.col("from") - longest)
    windows = windows.select("id", "key", "size", lead.alias("lead"), F.slice("s", lead + 1, F.lit(2 * longest) + 2 * F.col("size")).alias("near"), F.posexplode(minhashes(F.col("part"), bands)).alias("band", "low"))
    met = windows.join(F.broadcast(spans), ["band", "low"]).where(F.col("size") == F.col("span"))
    # Exact containment at the best place: of all stretches as long as the template that begin with one of its shingles.
    m = F.size("ts")

    def share(i: Column) -> Column:
        stretch = F.slice("near", i + 1, F.size("tw") - SHINGLE + 1)
        return F.struct((F.size(F.array_intersect("ts", stretch)) / m).alias("share"), (-i).alias("back"))

    places = F.filter(F.transform("near", lambda h, i: F.when(F.array_contains("ts", h), i)), lambda i: i.isNotNull())
    met = met.dropDuplicates(["id", "key", "lead", "license", "tw"])  # texts that share an id, or have none, are verified each
    best = met.withColumn("b", F.array_max(F.transform(places, share)))
    held = best.where(F.col("b.share") >= least).select("id", "license", F.col("b.share").alias("share"), (F.col("lead") - F.col("b.back")).alias("start"), F.size("tw").alias("len"))
    top = held.groupBy("id", "license").agg(F.max(F.struct("share", (-F.col("start")).alias("back"), "len")).alias("x"))
    return top.select(F.col("id").alias(id_col), "license", F.col("x.share").alias("containment"), (-F.col("x.back")).cast("long").alias("start"), (F.col("x.len") - F.col("x.back")).cast("long").alias("stop"))
