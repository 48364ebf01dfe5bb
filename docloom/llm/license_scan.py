"""Licence scans: fixed phrases, and whole notices found by a positional index of rare words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.base import ascii_lower, checkpointed, count_words, on_key, row_key, small_or_shuffled, words_of
from docloom.llm.decontaminate import SEPARATORS

#: Phrases whose label always stands where they occur.
PHRASES = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]

#: (label, words of the notice, the phrase in it without which it does not count): words of public licence notices.
TEMPLATES = [
    ("agpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version", "gnu affero general public license"),
    ("agpl", "licensed under the gnu affero general public license version 3", "gnu affero general public license"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license", "apache license version 2 0"),
    ("apache", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("apache", "you may obtain a copy of the license at http www apache org licenses license 2 0", "apache org licenses"),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software", "accompanying documentation covered by this license"),
    ("boost", "distributed under the boost software license version 1 0", "boost software license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", "redistribution and use in source and binary forms"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("bsd", "use of this source code is governed by a bsd style license that can be found in the license file", "bsd style license"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "waived all copyright"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", "eclipse public license"),
    ("gpl", "this work is licensed under the gnu general public license version 3", "gnu general public license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", "gnu general public license"),
    ("gpl", "you should have received a copy of the gnu general public license along with this program if not see http www gnu org licenses", "gnu general public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "permission to use copy modify and or distribute"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version", "gnu lesser general public license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "associated documentation files"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "associated documentation files"),
    ("mit", "released under the mit license", "mit license"),
    ("mit", "licensed under the mit license", "mit license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", "mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software", "unencumbered software released into the public domain"),
    ("wtfpl", "this program is free software it comes without any warranty to the extent permitted by applicable law you can redistribute it and or modify it under the terms of the do what the fuck you want to public license", "want to public license"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely", "alter it and redistribute it freely"),
]
#: Words of templates that are too common to be licence words.
COMMON = set("a and any are as at be been but by can do for from have he her his i if in into is it not no of on one or our she so that the their they this to was we were what which will with without you your may use".split())
#: A template is looked up by so many of its words that a file holds, those found in fewest documents.
RARE_WORDS = 8
#: Two of the words looked up must stand as far from each other as in the template; then so large a share of all licence
#: words of the template must stand within DRIFT words of where it has them.
LEAST_VOTES, SHARE, DRIFT = 2, 0.75, 2
#: Candidates, which are as many as the files with notices, are broadcast only up to so many rows.
CANDIDATES = 20_000


def template_tables(spark: SparkSession, templates: list[tuple[str, str, str]] | DataFrame) -> tuple[DataFrame, DataFrame]:
    """postings (w, template, at): licence words and their places; keys (template, label, phrase, key_at, licence_words)."""
    if isinstance(templates, list):
        templates = spark.createDataFrame(templates, "label string, body string, phrase string")
    t = templates.select("label", "body", "phrase").distinct().withColumn("template", F.xxhash64("label", "body", "phrase"))
    t = checkpointed(t.where(F.expr("instr(concat(' ', body, ' '), concat(' ', phrase, ' '))") > 0))
    postings = t.select("template", F.posexplode(F.split("body", " ")).alias("at", "w")).where(~F.col("w").isin(sorted(COMMON))).select("w", "template", "at")
    before = F.expr("substring(concat(' ', body, ' '), 1, instr(concat(' ', body, ' '), concat(' ', phrase, ' ')))")
    keys = t.select("template", "label", "phrase", (F.size(F.split(before, " ")) - 2).alias("key_at"))
    keys = keys.join(postings.groupBy("template").agg(F.count("*").alias("licence_words")), "template")
    return checkpointed(postings), checkpointed(keys)


def _occurrences(docs: DataFrame, phrases: DataFrame, licence_words: DataFrame) -> DataFrame:
    """_id, _hash, pos, w (a licence word, else null), runs (those of the ``phrases`` that begin at pos); checkpointed.

    Words meet the vocabulary, a table of (w, licensed), in a join. Up to the filter only generated code runs on the rows
    that still hold a text's words, so no row with all words is ever copied; its size does not grow with the templates.
    """
    firsts = phrases.select(F.substring_index("run", " ", 1).alias("w"), F.lit(False).alias("licensed"))
    vocabulary = licence_words.select("w", F.lit(True).alias("licensed")).union(firsts).groupBy("w").agg(F.max("licensed").alias("licensed"), F.max(F.when(~F.col("licensed"), True)).alias("begins"))
    lengths = sorted(r[0] for r in phrases.select(F.size(F.split("run", " "))).distinct().collect())  # a few small numbers
    d = docs.select(*row_key(), words_of(ascii_lower(F.col("text"))).alias("words"))
    d = d.select("_id", "_hash", "words", F.posexplode_outer("words").alias("pos", "w")).join(small_or_shuffled(checkpointed(vocabulary)), "w")
    cuts = [F.when(F.col("begins") & (F.col("pos") + n <= F.size("words")), F.array_join(F.slice("words", F.col("pos") + 1, F.lit(n)), " ")).alias(f"run{n}") for n in lengths]
    d = d.select("_id", "_hash", "pos", F.when(F.col("licensed"), F.col("w")).alias("w"), *cuts)
    known = small_or_shuffled(checkpointed(phrases.select("run").distinct()))
    for n in lengths:
        d = d.join(known.withColumnRenamed("run", f"known{n}"), F.col(f"run{n}") == F.col(f"known{n}"), "left").drop(f"run{n}")
    runs = F.array_compact(F.array(*[F.col(f"known{n}") for n in lengths]))
    d = d.select("_id", "_hash", "pos", "w", runs.alias("runs"))
    return checkpointed(d.where(F.col("w").isNotNull() | (F.size("runs") > 0)).distinct())


def license_scan(docs: DataFrame, templates: list[tuple[str, str, str]] | DataFrame | None = None, rare_words: int = RARE_WORDS) -> DataFrame:
    """One row per row of ``docs``: n_words, n_base, first_word, last_word, base_labels, labels, score.

    Base phrases are counted wherever their words stand in a row. ``templates`` are rows (label, body, phrase) of lower-case
    words parted by blanks. The index holds the place of each licence word in each template. Of the words that a file
    shares with a template, those that the fewest documents hold are looked up (document frequencies are counted over all
    documents; equal ones go by the word), for each template apart, so that no notice crowds out another. Each occurrence
    votes for the template and the shift between the two places. A shift with two votes is a candidate: its share is that
    of all the template's licence words that stand within two words of where the template has them, which allows for words
    put in or left out. It counts if the share is at least 0.75 and the template's mandatory phrase stands, as closely, at
    its place. A bare mention of a licence's name is far below that. ``score`` is the largest share of those that count, 0
    without any.

    Null and empty texts have no words and no labels; repeated rows get the same result each; without templates only base
    phrases label. The rows of a file and template in a window are bounded by the template's words. Every table made from
    the templates is broadcast only if it is small.
    """
    spark = docs.sparkSession
    postings, keys = template_tables(spark, TEMPLATES if templates is None else templates)
    base_phrases = spark.createDataFrame(PHRASES, "run string, label string")
    phrases = checkpointed(base_phrases.select("run").union(keys.select("phrase")).distinct())
    postings_small, keys_small = small_or_shuffled(postings), small_or_shuffled(keys)
    key = ["_id", "_hash"]

    seen = _occurrences(docs, phrases, postings.select("w").distinct())
    begun = seen.select(*key, "pos", F.explode("runs").alias("run"))
    base = begun.join(F.broadcast(base_phrases), "run").groupBy(*key).agg(F.count("*").alias("n_base"), F.min("pos").alias("first_word"), F.max("pos").alias("last_word"), F.collect_set("label").alias("base"))

    words = seen.where("w IS NOT NULL").select(*key, "w").distinct()
    frequency = checkpointed(words.groupBy("w").agg(F.count("*").alias("files")))
    shared = words.join(small_or_shuffled(frequency), "w").join(small_or_shuffled(checkpointed(postings.select("w", "template").distinct())), "w")
    rank = F.row_number().over(Window.partitionBy(*key, "template").orderBy("files", "w"))
    rare = shared.withColumn("rank", rank).where(F.col("rank") <= rare_words).select(*[F.col(k).alias(f"r{k}") for k in key], F.col("w").alias("rw"), F.col("template").alias("r_template"))
    same = F.col("_id").eqNullSafe(F.col("r_id")) & (F.col("_hash") == F.col("r_hash"))
    placed = seen.where("w IS NOT NULL").select(*key, "pos", "w").join(postings_small, "w")
    looked = placed.join(rare, same & (F.col("w") == F.col("rw")) & (F.col("template") == F.col("r_template")), "left_semi")
    votes = looked.groupBy(*key, "template", (F.col("pos") - F.col("at")).alias("shift")).agg(F.count("*").alias("votes"))
    candidates = checkpointed(votes.where(F.col("votes") >= LEAST_VOTES).select(*[F.col(k).alias(f"r{k}") for k in key], F.col("template").alias("r_template"), F.col("shift").alias("r_shift")))
    candidates = small_or_shuffled(candidates, CANDIDATES)  # they grow with the corpus

    drift = F.explode(F.sequence(F.lit(-DRIFT), F.lit(DRIFT))).alias("drift")
    asked = same & (F.col("template") == F.col("r_template"))
    near = placed.join(small_or_shuffled(checkpointed(candidates.select("r_id", "r_hash", "r_template").distinct()), CANDIDATES), asked, "left_semi")
    near = near.select(*key, "template", "at", (F.col("pos") - F.col("at")).alias("diagonal"), drift).withColumn("shift", F.col("diagonal") + F.col("drift"))
    in_place = near.join(candidates, asked & (F.col("shift") == F.col("r_shift")), "left_semi").select(*key, "template", "shift", "at").distinct()
    agreed = in_place.groupBy(*key, "template", "shift").agg(F.count("*").alias("agreed")).join(keys_small, "template").where(F.col("agreed") >= SHARE * F.col("licence_words"))
    begins = begun.join(keys_small, begun["run"] == keys_small["phrase"]).select(*key, "template", (F.col("pos") - F.col("key_at")).alias("diagonal"), drift)
    begins = begins.select(*[F.col(k).alias(f"r{k}") for k in key], F.col("template").alias("r_template"), (F.col("diagonal") + F.col("drift")).alias("r_shift"))
    proved = agreed.join(begins, asked & (F.col("shift") == F.col("r_shift")), "left_semi")
    method = proved.groupBy(*key).agg(F.collect_set("label").alias("method"), F.max(F.col("agreed") / F.col("licence_words")).alias("score"))

    none = F.array().cast("array<string>")
    counted = docs.select(*row_key(), "doc_id", count_words(F.col("text"), SEPARATORS).alias("n_words"))
    out = counted.join(base.alias("b"), on_key(counted, base), "left").select(counted["*"], "n_base", "first_word", "last_word", "base")
    out = out.join(method, on_key(out, method), "left")
    return out.select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        F.col("first_word").cast("long").alias("first_word"),
        F.col("last_word").cast("long").alias("last_word"),
        F.array_join(F.sort_array(F.coalesce("base", none)), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union(F.coalesce("base", none), F.coalesce("method", none))), ",").alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def oracle() -> str:
    """DuckDB SQL of the registered query."""

    def text(s: str) -> str:
        return "'" + s + "'"

    template_rows = ", ".join(f"({i}, {text(label)}, {text(body)}, {text(key)})" for i, (label, body, key) in enumerate(TEMPLATES))
    phrase_rows = ", ".join(f"({text(p)}, {text(label)})" for p, label in PHRASES)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, text, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
t(template, label, body, key) AS (VALUES {template_rows}),
ph(phrase, label) AS (VALUES {phrase_rows}),
tw AS (SELECT template, unnest(range(len(string_split(body, ' ')))) AS tp, string_split(body, ' ') AS b FROM t),
post AS (SELECT template, tp, b[tp + 1] AS w FROM tw WHERE b[tp + 1] NOT IN ({", ".join(text(w) for w in sorted(COMMON))})),
size AS (SELECT template, count(*) AS words FROM post GROUP BY template),
pos AS (SELECT rid, i, w[i + 1] AS x, w FROM (SELECT rid, w, unnest(range(len(w))) AS i FROM d)),
starts AS (SELECT rid, i, p FROM pos JOIN (SELECT DISTINCT p FROM (SELECT phrase AS p FROM ph UNION ALL SELECT key FROM t))
           ON x = string_split(p, ' ')[1] AND array_to_string(w[i + 1:i + len(string_split(p, ' '))], ' ') = p),
base AS (SELECT rid, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list_sort(list(DISTINCT label)) AS labels
         FROM starts JOIN ph ON p = phrase GROUP BY rid),
occ AS (SELECT rid, i, x FROM pos WHERE x IN (SELECT w FROM post)),
fw AS (SELECT DISTINCT rid, x FROM occ),
df AS (SELECT x, count(DISTINCT (doc_id, text)) AS files FROM fw JOIN d USING (rid) GROUP BY x),
rare AS (SELECT rid, template, x FROM (SELECT rid, template, x, row_number() OVER (PARTITION BY rid, template ORDER BY files, x) AS k
         FROM fw JOIN df USING (x) JOIN (SELECT DISTINCT template, w FROM post) ON x = w) WHERE k <= {RARE_WORDS}),
cand AS (SELECT rid, r.template, i - tp AS shift FROM occ JOIN rare r USING (rid, x) JOIN post ON x = post.w AND post.template = r.template
         GROUP BY ALL HAVING count(*) >= {LEAST_VOTES}),
agreed AS (SELECT c.rid, c.template, c.shift, count(DISTINCT tp) AS n FROM cand c JOIN occ ON occ.rid = c.rid
           JOIN post ON x = post.w AND post.template = c.template AND abs(i - tp - shift) <= {DRIFT} GROUP BY ALL),
good AS (SELECT a.rid, t.label, n / words AS score FROM agreed a JOIN size USING (template) JOIN t USING (template) WHERE n >= {SHARE} * words
         AND EXISTS (SELECT 1 FROM starts s WHERE s.rid = a.rid AND s.p = t.key AND abs(s.i - a.shift
             - (len(string_split(substr(' ' || body || ' ', 1, strpos(' ' || body || ' ', ' ' || key || ' ')), ' ')) - 2)) <= {DRIFT})),
m AS (SELECT rid, list(DISTINCT label) AS labels, max(score) AS score FROM good GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
       CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(array_to_string(base.labels, ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(m.labels, [])))), ','), '') AS labels,
       coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN base USING (rid) LEFT JOIN m USING (rid)
"""
