"""License scans by diagonal voting.

Every rolling k-gram of a text's words is hashed, and Spark joins all of them with the k-grams of the templates (a table
whose size is that of the templates, checked against MAX_TEMPLATE_GRAMS before it is broadcast; beyond it the join is a
shuffled one). A hit lies on the diagonal "word in the text minus word in the template". Hits are aggregated by
diagonal; diagonals of a template that chain at distances of at most SLIP form a band, as an inserted or dropped word
shifts the rest by one, and a band falls into spans where none of its diagonals so far reaches the next one's start. A span
counts if the distinct template words it covers reach MIN_COVER of the template. Every hit
is verified on the words themselves, taken from the text at the gram's byte positions, so hash collisions can't count.

Base phrases are templates too: a place of a phrase of m words is a diagonal stretch of m - k + 1 verified hits, that is
one at each template position, which the grams' start words tell apart exactly.

Cases: null and empty texts have no words and no labels; repeated rows are scanned alike, each on its own; a null doc_id is
allowed; an empty table gives an empty result. Only doc_id and text are read, so other columns can't clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytestext as bt
from .shared import short_batches, stash, table

K = 3
SLIP, MIN_COVER = 3, 0.6
MAX_TEMPLATE_GRAMS = 100_000
UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Fixed by the contract of the query: phrase and label. A phrase has at least K words.
BASE = [
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
]
#: Passages of public licences, in the words of this scan.
TEMPLATES = [
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction", "mit"),
    ("including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so", "mit"),
    ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "mit"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache-2"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", "apache-2"),
    ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", "apache-2"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "bsd"),
    ("redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", "bsd"),
    ("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "bsd"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details", "gpl"),
    ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", "lgpl"),
    ("you should have received a copy of the gnu lesser general public license along with this library", "lgpl"),
    ("it under the terms of the gnu affero general public license as published by the free software foundation", "agpl"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", "mpl-2"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("this work is licensed under a creative commons attribution sharealike 4 0 international license", "cc-by-sa"),
    ("licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "cc0"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software", "unlicense"),
    ("all rights reserved no part of this publication may be reproduced", "proprietary"),
    ("no part of this publication may be reproduced distributed or transmitted in any form or by any means without the prior written permission of the publisher", "proprietary"),
]
_LISTS = T.StructType([T.StructField(n, T.ArrayType(T.LongType())) for n in ("h", "a", "b")])
#: Every text's first entry: it joins a template row of its own, so that texts without hits stay.
_MARK = 1


@F.arrow_udf(_LISTS)
def rolling(texts: pa.Array) -> pa.Array:
    """For each text the hashes h of its k-grams and the byte positions a to b of each; before them _MARK and the number of words."""
    hashes, firsts, lasts, sizes = [], [], [], []
    for _, _, flat, offsets in bt.chunks(texts):
        flat = bt.LOWER[flat]
        starts, ends, rows = bt.spans(flat, offsets, bt.ALNUM)
        words = bt.hash_spans(flat, starts, ends)
        where, counts = bt.gram_rows(rows, K)
        base = np.repeat(offsets[:-1], counts)
        at = bt.bounds(counts)[:-1]
        hashes.append(np.insert(bt.gram_hashes(words, K)[where].view(np.int64), at, _MARK))
        firsts.append(np.insert(starts[where] - base, at, np.diff(rows)))
        lasts.append(np.insert(ends[where + K - 1] - base if len(where) else where, at, 0))
        sizes.append(counts + 1)
    where = pa.array(bt.bounds(np.concatenate(sizes) if sizes else np.zeros(0, dtype=np.int64)).astype(np.int32))
    parts = [pa.ListArray.from_arrays(where, pa.array(np.concatenate(x) if x else np.zeros(0, dtype=np.int64))) for x in (hashes, firsts, lasts)]
    return pa.StructArray.from_arrays(parts, ["h", "a", "b"])


def template_grams(spark: SparkSession, templates: list[tuple[str, str]], base: int) -> DataFrame:
    """(h, gram, template, place, label, length, is_base) of all templates, the first base of which are base phrases."""
    rows = [(_MARK, "", -1, 0, "", 0, False)]
    for n, (text, label) in enumerate(templates):
        words = text.split(" ")
        flat = np.frombuffer(text.encode(), dtype=np.uint8)
        starts, ends, _ = bt.spans(flat, np.array([0, len(flat)]), bt.ALNUM)
        found = bt.gram_hashes(bt.hash_spans(flat, starts, ends), K).view(np.int64)
        rows += [(int(h), " ".join(words[i : i + K]), n, i, label, len(words), n < base) for i, h in enumerate(found)]
    grams = spark.createDataFrame(rows, "h long, gram string, template int, place int, label string, length int, is_base boolean")
    return F.broadcast(grams) if len(rows) <= MAX_TEMPLATE_GRAMS else grams


def scan(docs: DataFrame, base: list[tuple[str, str]] = BASE, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of each row of docs."""
    spark = docs.sparkSession
    short_batches(spark)
    texts = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    rolled = texts.select("doc_id", "row", F.col("text").cast("binary").alias("bytes"), rolling("text").alias("g"))
    grams = rolled.select("doc_id", "row", "bytes", F.col("g.a").alias("a"), F.col("g.b").alias("b"), F.posexplode("g.h").alias("pos", "h"))
    hits = grams.join(template_grams(spark, base + templates, len(base)), "h")
    first = F.get("a", F.col("pos"))
    seen = F.when(F.col("template") >= 0, F.substring("bytes", (first + 1).cast("int"), (F.get("b", F.col("pos")) - first).cast("int")).cast("string"))
    hits = hits.select(
        "doc_id", "row", "template", "label", "length", "is_base", "place", "gram", (F.col("pos") - 1).cast("long").alias("word"),
        F.when(F.col("template") < 0, first).alias("n_words"), F.regexp_replace(F.translate(seen, UPPER, SMALL), NOT_WORD, " ").alias("seen"),
    )
    hits = hits.filter("template < 0 OR seen = gram").withColumn("diagonal", F.col("word") - F.col("place"))

    # A base phrase stands where one diagonal has a hit for each of its grams; any other template is voted for by all hits on it.
    diagonals = stash(hits.groupBy("doc_id", "row", "template", "label", "length", "is_base", "diagonal").agg(
        F.count("*").alias("votes"), F.min("word").alias("low"), F.max("word").alias("high"), F.collect_set("place").alias("places"), F.max("n_words").alias("n_words")
    ), "diagonals")
    own = ["row", "template"]
    by_diagonal, by_place = Window.partitionBy(*own).orderBy("diagonal"), Window.partitionBy(*own, "band").orderBy("low", "diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(by_diagonal) > SLIP, F.lit(True))
    merged = diagonals.filter("NOT is_base AND template >= 0").withColumn("apart", apart.cast("int")).withColumn("band", F.sum("apart").over(by_diagonal))
    reach = F.max("high").over(by_place.rowsBetween(Window.unboundedPreceding, -1))
    merged = merged.withColumn("ended", F.coalesce(F.col("low") - reach > SLIP + K, F.lit(True)).cast("int")).withColumn("span", F.sum("ended").over(by_place))
    spans = ["doc_id", *own, "label", "length", "band", "span"]
    covered = merged.select(*spans, F.explode("places").alias("place")).distinct().select(*spans, F.explode(F.sequence("place", F.col("place") + K - 1)).alias("at")).distinct()
    merged = covered.groupBy(*spans).agg((F.count("*") / F.col("length")).alias("cover")).filter(F.col("cover") >= MIN_COVER)
    blank = [F.lit(None).cast("long").alias(c) for c in ("low", "high", "n_words")]
    evidence = diagonals.filter(f"template < 0 OR (is_base AND votes = length - {K - 1})").select(
        "doc_id", "row", F.when(F.col("is_base"), F.col("label")).alias("base_label"), F.when(F.col("is_base"), F.col("label")).alias("label"),
        F.when(F.col("is_base"), F.col("diagonal")).alias("low"), F.when(F.col("is_base"), F.col("diagonal")).alias("high"), "n_words",
        F.when(F.col("is_base"), F.lit(1.0)).alias("cover"),
    ).unionByName(merged.select("doc_id", "row", F.lit(None).cast("string").alias("base_label"), "label", *blank, "cover"))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return evidence.groupBy("doc_id", "row").agg(
        F.max("n_words").alias("n_words"), F.count("base_label").alias("n_base"), F.min("low").alias("first_word"), F.max("high").alias("last_word"),
        joined("base_label").alias("base_labels"), joined("label").alias("labels"), F.coalesce(F.max("cover"), F.lit(0.0)).alias("score"),
    ).drop("row")


def op2_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    grams = []
    for n, (text, label) in enumerate(BASE + TEMPLATES):
        words = text.split(" ")
        grams += [f"({n}, '{label}', {len(words)}, {str(n < len(BASE)).lower()}, {i}, '{' '.join(words[i : i + K])}')" for i in range(len(words) - K + 1)]
    return f"""
WITH t(template, label, length, is_base, place, gram) AS (VALUES {", ".join(grams)}),
docs AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{SMALL}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents),
flat AS (SELECT row, unnest(w) AS x, unnest(range(len(w))) AS word FROM docs),
ahead AS (SELECT row, word, x, lead(x, 1) OVER o AS y, lead(x, 2) OVER o AS z FROM flat WINDOW o AS (PARTITION BY row ORDER BY word)),
hits AS (SELECT a.row, a.word, t.*, a.word - t.place AS diagonal FROM ahead a JOIN t ON t.gram = concat(a.x, ' ', a.y, ' ', a.z) WHERE a.z IS NOT NULL),
base AS (SELECT row, label, diagonal FROM hits WHERE is_base GROUP BY row, template, label, length, diagonal HAVING count(*) = length - {K - 1}),
diagonals AS (SELECT row, template, diagonal, min(word) AS low, max(word) AS high FROM hits WHERE NOT is_base GROUP BY ALL),
apart AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY row, template ORDER BY diagonal) <= {SLIP} THEN 0 ELSE 1 END AS apart FROM diagonals),
bands AS (SELECT *, sum(apart) OVER (PARTITION BY row, template ORDER BY diagonal) AS band FROM apart),
ended AS (
  SELECT *, CASE WHEN low - max(high) OVER (PARTITION BY row, template, band ORDER BY low, diagonal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= {SLIP + K} THEN 0 ELSE 1 END AS ended
  FROM bands),
spans AS (SELECT *, sum(ended) OVER (PARTITION BY row, template, band ORDER BY low, diagonal) AS span FROM ended),
covers AS (
  SELECT s.row, h.label, CAST(count(DISTINCT h.place + k.k) AS DOUBLE) / h.length AS cover
  FROM spans s JOIN hits h ON s.row = h.row AND s.template = h.template AND s.diagonal = h.diagonal CROSS JOIN (SELECT unnest(range({K})) AS k) k
  GROUP BY s.row, s.template, s.band, s.span, h.label, h.length),
evidence AS (
  SELECT row, label, label AS base_label, diagonal, CAST(1 AS DOUBLE) AS cover FROM base
  UNION ALL SELECT row, label, NULL, NULL, cover FROM covers WHERE cover >= {MIN_COVER}),
found AS (
  SELECT row, count(base_label) AS n_base, min(diagonal) AS first_word, max(diagonal) AS last_word, max(cover) AS score,
         array_to_string(list_sort(list(DISTINCT base_label) FILTER (base_label IS NOT NULL)), ',') AS base_labels, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels
  FROM evidence GROUP BY row)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       coalesce(score, CAST(0 AS DOUBLE)) AS score
FROM docs LEFT JOIN found USING (row)
"""


ORACLE_SQL = _oracle()
