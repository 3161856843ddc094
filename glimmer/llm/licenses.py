"""License scans in DataFrame functions alone: MinHash bands of text windows retrieve templates, shingles confirm them.

Texts and templates become words (runs of a-z and 0-9, lower-cased) and shingles of five words. For each template of t
shingles, windows of t shingles that begin at multiples of t/8 cover every text. A window gets BANDS band keys of ROWS
MinHash values each; equal keys retrieve the template. A place that holds a copy with ``percent`` of the shingles left has
a window whose Jaccard similarity with the template is 0.52 or more, which the bands miss with a probability of 5e-4, and
neighbours of 0.39 (0.02 each; they overlap, so the chances aren't independent). Over all tables here the result equals
the SQL, which tries every window. A band key can be equal only if its values come from shingles that both sides have:
so only windows around shingles of some template need keys, and the broadcast table of those shingles finds them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glimmer.llm.common import table, without

WORDS, PERCENT, BANDS, ROWS = 5, 75, 24, 2
#: Templates that may be broadcast, in shingles; more raise an error, and must be scanned in several calls.
MOST = 200_000

#: License notices, as their licenses word them.
NOTICES = [
    ("MIT-notice", "Released under the MIT License."),
    ("Apache-2.0-notice", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0-notice", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0-notice", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0-notice", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0-notice", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("Apache-2.0-header", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("GPL-3.0-header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MPL-2.0-header", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
]


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, not at each mention."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def word_array(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")


def shingle_array(word_hashes: Column, words: int) -> Column:
    """Hashes of the shingles in order; none for fewer words than a shingle has."""
    places = F.sequence(F.lit(0), F.size(word_hashes) - words)
    each = F.transform(places, lambda i: F.xxhash64(*[F.get(word_hashes, i + k) for k in range(words)]))
    return F.when(F.size(word_hashes) >= words, each).otherwise(F.array().cast("array<bigint>"))


def _shingled(df: DataFrame, words: int, *keep: str) -> DataFrame:
    hashes = F.transform(word_array(F.col("text")), lambda w: F.xxhash64(w))
    return df.select(*keep, let(hashes, lambda h: shingle_array(h, words)).alias("shingles"))


def band_keys(shingles: Column, bands: int, rows: int) -> Column:
    """An array of the band keys of a set of shingles; keys of different bands differ."""
    least = lambda k: F.array_min(F.transform(shingles, lambda s: F.xxhash64(s, F.lit(k))))
    return F.array(*[F.xxhash64(F.lit(b), *[least(b * rows + r) for r in range(rows)]) for b in range(bands)])


def _windows(own: dict[int, set[int]]) -> Column:
    """t, low, window, stretch for each window of a text that holds a shingle of a template of t shingles, each window once.

    ``own``: the shingles of the templates of each size; ``hits``: the places of all of them. All is worked out within the text's row, in room that grows with
    its length, so no shingles are copied for each place or shuffled.
    """
    def of_size(t: int, places: Column) -> Column:
        step, slack = max(1, t // 8), -(-t // 4)
        # starts of the windows of t shingles that hold the place: multiples of the step
        lowest = lambda p: F.greatest(F.lit(0), F.ceil((p - t + 1) / step).cast("int"))
        starts = F.flatten(F.transform(places, lambda p: F.sequence(lowest(p), F.greatest(lowest(p), F.floor(p / step).cast("int")))))

        def window(k: Column) -> Column:
            start = k * step
            low = F.greatest(F.lit(0), start - slack)
            return F.struct(F.lit(t).alias("t"), low.alias("low"), F.slice("shingles", start + 1, t).alias("window"), F.slice("shingles", low + 1, start + t + slack - low).alias("stretch"))

        return F.transform(F.array_distinct(starts), window)

    if not own:
        return F.array().cast("array<struct<t: int, low: int, window: array<bigint>, stretch: array<bigint>>>")
    return F.concat(*[of_size(t, _held(own[t], "hits")) for t in sorted(own)])


def _held(shingles: set[int], places: str) -> Column:
    """Those of some places whose shingle is among ``shingles``: one look-up in a hash set for each place."""
    return F.expr(f"filter({places}, i -> get(shingles, i) in ({', '.join(map(str, sorted(shingles))) or 'null'}))")


def scan(docs: DataFrame, templates: DataFrame, words: int = WORDS, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, license, matched, shingles, first_word: each template that a text holds, with the shingles of the best place.

    ``templates`` has license and text; a place counts if ``percent`` in 100 of the template's distinct shingles stand in
    the stretch of its length there and a quarter more on either side. first_word is the earliest such stretch's first
    matched word among the best places. Null, empty and short texts match nothing; templates of fewer than ``words``
    words are left out; rows of equal doc_id count as one document whose texts are searched one by one, rows without a doc_id likewise.
    Extra columns are ignored.
    """
    known = _shingled(without(templates, "license", "text"), words, "license").where(F.size("shingles") > 0)
    known = known.withColumn("t", F.size("shingles")).withColumn("own", F.array_distinct("shingles"))
    total = known.agg(F.sum("t")).collect()[0][0] or 0
    if total > MOST:
        raise ValueError(f"{total} shingles of templates; at most {MOST} go in one call")
    own: dict[int, set[int]] = {}
    for r in known.select("t", "own").collect():  # MOST shingles at most
        own.setdefault(r["t"], set()).update(r["own"])
    keyed = F.broadcast(known.select("license", "t", "own", F.explode(band_keys(F.col("own"), bands, rows)).alias("key")))
    texts = _shingled(without(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")), words, "doc_id")
    texts = texts.withColumn("hits", _held(set().union(*own.values()), "sequence(0, size(shingles) - 1)"))
    near = texts.select("doc_id", F.explode(_windows(own)).alias("w")).select("doc_id", "w.*")
    found = near.select("doc_id", "t", "low", "stretch", F.explode(band_keys(F.col("window"), bands, rows)).alias("key")).join(keyed, ["t", "key"])
    places = F.filter(F.transform("own", lambda s: F.array_position("stretch", s)), lambda p: p > 0)
    sure = found.select("doc_id", "license", F.size("own").alias("shingles"), "low", places.alias("places")).withColumn("matched", F.size("places"))
    sure = sure.where(F.col("matched") * 100 >= F.col("shingles") * percent)
    best = sure.groupBy("doc_id", "license").agg(F.min(F.struct((-F.col("matched")).alias("less"), (F.col("low") + F.array_min("places") - 1).alias("first"), "shingles")).alias("b"))
    return best.select("doc_id", "license", (-F.col("b.less")).cast("long").alias("matched"), F.col("b.shingles").cast("long").alias("shingles"), F.col("b.first").cast("long").alias("first_word"))


def notices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(NOTICES, "license string, text string")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), notices(spark))


_SPLIT = "list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda w: w <> '')"
_SHINGLED = "CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) ELSE [] END"
#: The same result by brute force: every window that holds a shingle of a template, without MinHash.
ORACLE_SQL = f"""WITH tpl(license, text) AS (VALUES {", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in NOTICES)}),
t AS (SELECT license, sh, len(sh) AS t, list_distinct(sh) AS own FROM (SELECT license, {_SHINGLED} AS sh FROM (SELECT license, {_SPLIT} AS w FROM tpl))),
d AS (SELECT doc_id, {_SHINGLED} AS sh FROM (SELECT doc_id, {_SPLIT} AS w FROM documents)),
e AS (SELECT doc_id, unnest(sh) AS shingle, generate_subscripts(sh, 1) - 1 AS place FROM d),
sizes AS (SELECT DISTINCT t, unnest(own) AS shingle FROM t),
h AS (SELECT doc_id, place, t, greatest(1, t // 8) AS step FROM e JOIN sizes USING (shingle)),
s AS (SELECT DISTINCT doc_id, t, unnest(range(CAST(ceil(greatest(0, place - t + 1) / step) AS BIGINT), place // step + 1)) * step AS start FROM h),
b AS (SELECT doc_id, t, start, greatest(0, start - CAST(ceil(t / 4) AS BIGINT)) AS low, start + t + CAST(ceil(t / 4) AS BIGINT) AS high FROM s),
m AS (SELECT doc_id, license, low, len(own) AS shingles, list_filter(list_transform(own, lambda x: list_position(d.sh[low + 1:high], x)), lambda p: p > 0) AS places FROM b JOIN d USING (doc_id) JOIN t USING (t)),
k AS (SELECT doc_id, license, len(places) AS matched, shingles, low + list_min(places) - 1 AS first_word FROM m WHERE 100 * len(places) >= {PERCENT} * shingles),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, license ORDER BY matched DESC, first_word) AS n FROM k)
SELECT doc_id, license, CAST(matched AS BIGINT) AS matched, CAST(shingles AS BIGINT) AS shingles, CAST(first_word AS BIGINT) AS first_word FROM r WHERE n = 1"""
