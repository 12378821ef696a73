"""Licence notices by a positional index of rare words. DataFrame functions only.

Templates are single sentences of notices, which also edited notices keep, and whole texts of short licences. Their words, but for stop words, are posted with their positions. In one pass over the
texts each document keeps where it has posted words. Document frequencies over all documents give the words' IDF. The
index is of each template's words of highest IDF: as many as hold more of its IDF than a found template may lack, so
that every place where a template can be found has at least one of them. Those words of a document nominate places at
which a template would start; there all postings of the template are intersected with the document's words by relative
position. A template is found where enough of its IDF agrees and its key phrase begins within its extent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilframe.llm.common import let, settle, table

# Base phrases and labels; templates as label, key phrase, notice; stop words.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
TEMPLATES = (
    ("apache-2.0", "apache license", "licensed under the apache license version 2 0"),
    ("apache-2.0", "apache license", "you may not use this file except in compliance with the license"),
    ("mit", "mit license", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("gpl", "general public license", "this work is licensed under the gnu general public license version"),
    ("gpl", "general public license", "redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "lesser general public license", "licensed under the gnu lesser general public license version"),
    ("agpl", "affero general public license", "licensed under the gnu affero general public license version"),
    ("cc-by-nc", "cc by nc", "licensed under cc by nc"),
    ("cc-by-sa", "cc by sa", "licensed under cc by sa"),
    ("cc0", "public domain", "cc0 1 0 universal public domain dedication"),
    ("unlicense", "free and unencumbered software", "this is free and unencumbered software released into the public domain"),
    ("bsd", "redistribution and use in source and binary forms", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "distribute this software for any purpose", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl-2.0", "mozilla public license", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("wtfpl", "do what the fuck you want to", "do what the fuck you want to public license terms and conditions for copying distribution and modification"),
    ("boost", "boost software license", "distributed under the boost software license version 1 0"),
    ("zlib", "altered source versions must be plainly marked", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    # whole texts
    ("apache-2.0", "apache license", """
        licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at
        http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
        without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"""),
    ("gpl", "general public license", """
        this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either
        version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied
        warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"""),
    ("zlib", "altered source versions must be plainly marked", """
        this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission
        is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions 1 the
        origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product
        documentation would be appreciated but is not required 2 altered source versions must be plainly marked as such and must not be misrepresented as being the original software 3 this
        notice may not be removed or altered from any source distribution"""),
    ("isc", "distribute this software for any purpose", """
        permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice
        appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness
        in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action
        of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"""),
    ("mit", "permission is hereby granted free of charge", """
        permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction
        including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished
        to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software
        is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement
        in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in
        connection with the software or the use or other dealings in the software"""),
    ("bsd", "redistribution and use in source and binary forms", """
        redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain
        the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and
        the following disclaimer in the documentation and or other materials provided with the distribution this software is provided by the copyright holders and contributors as is and any
        express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"""),
)
STOP = frozenset(
    "a an and any all are as at be being but by can do even for from i if in into is it may more must no not of on or other out see shall so such that the their this to under use used was what "
    "which who whom will with within without work would you your 0 1 2 3 v".split()
)
#: A template needs so much of its IDF.
ENOUGH = 0.6
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
VOCABULARY = sorted({w for _, _, notice in TEMPLATES for w in notice.split()} - STOP)
#: Words of each template.
SIZES = [len(notice.split()) for _, _, notice in TEMPLATES]
KEYS = sorted({key for _, key, _ in TEMPLATES})


def _starts(words: Column, phrase: str) -> Column:
    """Where the phrase's words stand in words, in order."""
    parts = phrase.split()
    last = F.size(words) - len(parts)

    def here(i: Column) -> Column:
        out = F.get(words, i) == parts[0]
        for j, w in enumerate(parts[1:], 1):
            out = out & (F.get(words, i + j) == w)
        return out

    return F.when(last >= 0, F.filter(F.sequence(F.lit(0), last), here)).otherwise(F.array().cast("array<int>"))


def _seen(docs: DataFrame) -> DataFrame:
    """Of each text: n_words, starts of base phrases by phrase, key phrases with their starts, and its posted words with places."""
    none = F.array().cast("array<int>")

    def read(joined: Column) -> Column:
        """joined: the words with a space around each."""
        has = [joined.contains(f" {phrase} ") for phrase, _ in BASE]
        some = joined.rlike(" (?:" + "|".join(VOCABULARY) + ") ")

        def of(words: Column) -> Column:
            starts = [F.when(h, _starts(words, phrase)).otherwise(none).alias(f"b{i}") for i, (h, (phrase, _)) in enumerate(zip(has, BASE))]
            spots = lambda k: F.transform(F.when(joined.contains(f" {k} "), _starts(words, k)).otherwise(none), lambda i: F.struct(F.lit(k).alias("key"), i.alias("at")))
            keys = F.when(some, F.flatten(F.array(*map(spots, KEYS)))).otherwise(F.array().cast("array<struct<key:string,at:int>>"))
            placed = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("word"), i.alias("at"))), lambda x: x["word"].isin(VOCABULARY))
            hits = F.when(some, placed).otherwise(F.array().cast("array<struct<word:string,at:int>>"))
            return F.struct(F.size(words).cast("long").alias("n_words"), *starts, keys.alias("keys"), hits.alias("hits"))

        return let(F.filter(F.split(joined, " "), lambda w: w != ""), of)

    text = F.translate(F.coalesce(F.col("text"), F.lit("")), UPPER, LOWER)
    return docs.select("doc_id", let(F.regexp_replace(F.concat(F.lit(" "), text, F.lit(" ")), GAPS, " "), read).alias("s")).select("doc_id", "s.*")


def scan(docs: DataFrame) -> DataFrame:
    """A row for each row of docs(doc_id, text, ...).

    n_words; n_base: places of base phrases; first_word, last_word: smallest and largest start of one, else null;
    base_labels and labels, with those of found templates: distinct, sorted, joined by commas, else empty; score:
    1 with a base phrase, else the largest share of a found template's IDF, else 0.

    Null texts are empty and have no words. Repeated rows and null ids give rows like others. A text may hold any
    number of notices, and be of any length. An empty table gives an empty result. Extra columns are ignored.
    """
    spark = docs.sparkSession
    seen = settle(_seen(docs).withColumn("_uid", F.monotonically_increasing_id()), "licence_words")
    hits = seen.where(F.size("hits") > 0).select("_uid", F.explode("hits").alias("h")).select("_uid", "h.word", "h.at")
    total = seen.count()
    posted = spark.createDataFrame([(t, label, key, SIZES[t], w, p) for t, (label, key, notice) in enumerate(TEMPLATES) for p, w in enumerate(notice.split()) if w not in STOP], "template int, label string, key string, size int, word string, place int")
    # from here to mass, tables have a row for each posting, so they are always small
    frequency = seen.where(F.size("hits") > 0).select(F.explode(F.array_distinct("hits.word")).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    postings = posted.join(F.broadcast(frequency), "word", "left").withColumn("idf", F.log(1 + F.lit(total) / F.coalesce("df", F.lit(1))))
    mass = postings.groupBy("template", "label", "key", "size").agg(F.sum("idf").alias("mass"))
    rarer = Window.partitionBy("template").orderBy(F.col("idf").desc(), "place").rowsBetween(Window.unboundedPreceding, -1)
    ranked = postings.withColumns({"before": F.coalesce(F.sum("idf").over(rarer), F.lit(0.0)), "all": F.sum("idf").over(Window.partitionBy("template"))})
    index = ranked.where(F.col("before") <= (1 - ENOUGH + 1e-9) * F.col("all")).select("template", "word", "place")
    places = hits.join(F.broadcast(index), "word").select("_uid", "template", (F.col("at") - F.col("place")).alias("begin")).distinct()
    due = places.join(F.broadcast(postings.select("template", "word", "place", "idf")), "template").select("_uid", "template", "begin", "word", (F.col("begin") + F.col("place")).alias("at"), "idf")
    agree = due.join(hits, ["_uid", "word", "at"]).groupBy("_uid", "template", "begin").agg(F.sum("idf").alias("found"))
    agree = agree.join(F.broadcast(mass), "template").withColumn("share", F.col("found") / F.col("mass")).where(F.col("share") >= ENOUGH)
    # an extent has two stretches of its size, and a stretch few key phrases: so texts of any number of notices stay linear
    stretch = lambda at: F.floor(at / F.col("size"))
    agree = agree.withColumn("_stretch", F.explode(F.array_distinct(F.array(stretch(F.col("begin")), stretch(F.col("begin") + F.col("size") - 1)))))
    keys = seen.where(F.size("keys") > 0).select("_uid", F.inline("keys")).join(F.broadcast(mass.select("template", "key", "size")), "key").select("_uid", "template", "at", stretch(F.col("at")).alias("_stretch"))
    agree = agree.join(keys, ["_uid", "template", "_stretch"]).where((F.col("at") >= F.col("begin")) & (F.col("at") < F.col("begin") + F.col("size")))
    found = agree.groupBy("_uid").agg(F.collect_set("label").alias("more"), F.max("share").alias("share"))
    d = seen.join(found, "_uid", "left")
    starts = F.concat(*[f"b{i}" for i in range(len(BASE))])
    labels = F.concat(*[F.when(F.size(f"b{i}") > 0, F.array(F.lit(label))).otherwise(F.array().cast("array<string>")) for i, (_, label) in enumerate(BASE)])
    join = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    return d.select(
        "doc_id", "n_words", F.size(starts).cast("long").alias("n_base"), F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
        join(labels).alias("base_labels"), join(F.concat(labels, F.coalesce("more", F.array().cast("array<string>")))).alias("labels"),
        F.when(F.size(starts) > 0, F.lit(1.0)).otherwise(F.round(F.least(F.coalesce("share", F.lit(0.0)), F.lit(1.0)), 6)).alias("score"),
    )


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    q = lambda s: "'" + s + "'"
    rows = ", ".join(f"({t}, {q(label)}, {q(key)}, {SIZES[t]}, {q(w)}, {p})" for t, (label, key, notice) in enumerate(TEMPLATES) for p, w in enumerate(notice.split()) if w not in STOP)
    base = " UNION ALL ".join(
        f"SELECT uid, spot, {q(label)} AS label FROM w WHERE " + " AND ".join(f"{'word' if j == 0 else f'list_extract(words, spot + {j + 1})'} = {q(x)}" for j, x in enumerate(phrase.split())) for phrase, label in BASE
    )
    return rf"""
WITH d AS (SELECT row_number() OVER () AS uid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
w AS (SELECT uid, words, unnest(words) AS word, unnest(range(len(words))) AS spot FROM d),
base AS ({base}),
p(template, label, key, size, word, place) AS (VALUES {rows}),
hits AS (SELECT uid, word, spot FROM w WHERE word IN ({", ".join(map(q, VOCABULARY))})),
df AS (SELECT word, count(DISTINCT uid) AS df FROM hits GROUP BY word),
post AS (SELECT p.*, ln(1 + (SELECT count(*) FROM d) / coalesce(df, 1)) AS idf FROM p LEFT JOIN df USING (word)),
mass AS (SELECT template, label, key, size, sum(idf) AS mass FROM post GROUP BY ALL),
votes AS (SELECT uid, template, spot - place AS start, sum(idf) AS found FROM hits JOIN post USING (word) GROUP BY ALL),
ok AS (SELECT v.uid, m.label, found / mass AS share FROM votes v JOIN mass m USING (template) JOIN d ON d.uid = v.uid
       WHERE found / mass >= {ENOUGH} AND contains(' ' || array_to_string(words[greatest(start, 0) + 1 : start + size + len(string_split(key, ' ')) - 1], ' ') || ' ', ' ' || key || ' ')),
b AS (SELECT uid, count(*) AS n, min(spot) AS lo, max(spot) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM base GROUP BY uid),
l AS (SELECT uid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT uid, label FROM base UNION ALL SELECT uid, label FROM ok) GROUP BY uid),
s AS (SELECT uid, max(share) AS share FROM ok GROUP BY uid)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, lo::BIGINT AS first_word, hi::BIGINT AS last_word, coalesce(b.labels, '') AS base_labels,
       coalesce(l.labels, '') AS labels, CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE round(least(coalesce(share, 0), 1.0), 6)::DOUBLE END AS score
FROM d LEFT JOIN b USING (uid) LEFT JOIN l USING (uid) LEFT JOIN s USING (uid)"""


ORACLE = _oracle()
