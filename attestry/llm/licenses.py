"""License notices in texts by a positional index of rare words. DataFrame functions only.

Words are runs of digits, letters and characters beyond ASCII, A-Z in lower case. TEMPLATES are notices and the openings of
license texts, each with a label and its mandatory phrases. The index of a template holds its RARE words of the highest
inverse document frequency among those that any text holds (half of them, if that is fewer), with all their places;
frequencies are counted over all texts, which give at most a row a template word. A text looks up all of its words that are in the index, with no cut of its
own, so a text with several licenses loses none.

Postings meet by relative position: a word at place p of the text and q of the template votes for the start p - q. Starts
are gathered in cells of WIDTH words that overlap by half, so a notice in which words are added or left out still meets.
In a cell each template place counts once, with its word's weight. A template is found where its index words reach SHARE of
their weight and every mandatory phrase stands, word by word, at its own relative place in the same cell. Texts without a
mandatory phrase can't hold a template, so only those with one send rows to the exchange, and only index words and phrases.
The score is the greatest share of weight of a template found, 0 where none is.

The base labels come from BASE phrases alone, wherever their words stand consecutively, and are part of the labels.

Cases: a null or empty text has no words and no labels; rows that repeat give the same result each; a null doc_id stays
null; an empty table gives no rows; further columns are ignored; of equally rare words the lesser one is in the index.
"""

from __future__ import annotations

from math import floor, log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import keyed, written

#: The base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Label, words of a public license's notice or opening, mandatory phrases.
TEMPLATES = [
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "licensed under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", ["permission is hereby granted free of charge", "to deal in the software without restriction"]),
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license", "version 2 0"]),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ["apache license version 2 0", "in compliance with the license"]),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ["general public license", "version 3"]),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2", ["general public license", "version 2"]),
    ("gpl-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", ["redistribute it and or modify it under the terms of the gnu general public license", "version 3 of the license"]),
    ("gpl-2.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", ["redistribute it and or modify it under the terms of the gnu general public license", "version 2 of the license"]),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ["lesser general public license"]),
    ("agpl", "licensed under the gnu affero general public license", ["affero general public license"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ["for any purpose with or without fee is hereby granted"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["unencumbered software released into the public domain"]),
    ("cc0", "dedicated to the public domain under cc0 1 0", ["public domain", "cc0"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc-by-nd", "licensed under cc by nd 4 0", ["cc by nd"]),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", ["creative commons attribution noncommercial"]),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ["creative commons attribution sharealike"]),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution 4 0 international license"]),
]
RARE, SHARE_PERCENT, WIDTH = 8, 60, 16
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    found = F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), BREAK)
    return F.filter(found, lambda w: w != "")


def _postings(templates: list[tuple[str, str, list[str]]]) -> list[tuple[int, str, int]]:
    """Template, word and place of every word of every template: a fixed list."""
    return [(t, w, q) for t, (_, text, _) in enumerate(templates) for q, w in enumerate(text.split())]


def weights(rows: DataFrame, templates: list[tuple[str, str, list[str]]]) -> dict[str, int]:
    """Of each template word that a text holds a thousand times ln((n + 1) / (texts with it + 1)), rounded, 1 at least. rows: words."""
    known = sorted({w for _, w, _ in _postings(templates)})
    counted = rows.select(F.explode(F.concat(F.array_intersect("words", F.lit(known)), F.array(F.lit("")))).alias("w")).groupBy("w").count()
    found = {r["w"]: r["count"] for r in counted.collect()}
    n = found.pop("", 0)
    return {w: max(1, floor(1000 * log((n + 1) / (count + 1)) + 0.5)) for w, count in found.items()}


def index(spark: SparkSession, weight: dict[str, int], templates: list[tuple[str, str, list[str]]]) -> tuple[DataFrame, list[str]]:
    """word, template, q, weight and whole (the template's weight) of the index words, and these words. Bounded by the templates."""
    rows = []
    for t, (_, text, _) in enumerate(templates):
        own = sorted(set(text.split()) & set(weight), key=lambda w: (-weight[w], w))
        own = set(own[: min(RARE, -(-len(own) // 2))])
        places = [(w, q) for q, w in enumerate(text.split()) if w in own]
        whole = sum(weight[w] for w, _ in places)
        rows += [(w, t, q, weight[w], whole) for w, q in places]
    return spark.createDataFrame(rows, "word string, template int, q int, weight long, whole long"), sorted({r[0] for r in rows})


def _phrases(templates: list[tuple[str, str, list[str]]]) -> list[str]:
    return sorted({*BASE, *(p for _, _, phrases in templates for p in phrases)})


def _places(templates: list[tuple[str, str, list[str]]]) -> Column:
    """Place and name of every phrase that starts in `words`: places of first words are found first, phrases compared there."""
    phrases = _phrases(templates)
    first = sorted({p.split()[0] for p in phrases})
    known = F.array(*[F.struct(F.lit(p).alias("name"), F.array(*[F.lit(w) for w in p.split()]).alias("words")) for p in phrases])
    at = F.filter(F.transform("words", lambda w, i: F.when(w.isin(first), i)), lambda i: i.isNotNull())
    here = lambda i: F.transform(F.filter(known, lambda p: F.slice("words", i + 1, F.size(p["words"])) == p["words"]), lambda p: F.struct(i.alias("p"), p["name"].alias("name")))
    return F.flatten(F.transform(at, here))


def scan(docs: DataFrame, templates: list[tuple[str, str, list[str]]] = TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of each row. docs: doc_id, text."""
    spark = docs.sparkSession
    rows = keyed(docs).select("_id", "_th", "doc_id", words(F.col("text")).alias("words"))
    postings, looked_up = index(spark, weights(rows, templates), templates)
    phrases = F.filter("phrases", lambda x: x["name"].isin(list(BASE)))
    hits = F.filter(F.transform("words", lambda w, i: F.when(w.isin(looked_up), F.struct(i.alias("p"), w.alias("word")))), lambda x: x.isNotNull())
    mandatory = sorted({p for _, _, own in templates for p in own})
    may = F.exists("phrases", lambda x: x["name"].isin(mandatory))
    slim = rows.withColumn("phrases", _places(templates)).withColumn("base", phrases)
    name = F.create_map(*[F.lit(x) for pair in BASE.items() for x in pair])
    slim = written(
        slim.select(
            "_id", "_th", "doc_id",
            F.size("words").cast("long").alias("n_words"),
            F.size("base").cast("long").alias("n_base"),
            F.array_min(F.transform("base", lambda x: x["p"])).cast("long").alias("first_word"),
            F.array_max(F.transform("base", lambda x: x["p"])).cast("long").alias("last_word"),
            F.array_sort(F.array_distinct(F.transform("base", lambda x: F.element_at(name, x["name"])))).alias("base_labels"),
            F.when(may, hits).alias("hits"),
            F.when(may, F.col("phrases")).alias("phrases"),
        )
    )
    found = _met(slim, postings, templates)
    labels = F.array_sort(F.array_distinct(F.concat("base_labels", F.coalesce("found", F.array().cast("array<string>")))))
    return slim.join(found, ["_id", "_th"], "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base_labels", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def _met(slim: DataFrame, postings: DataFrame, templates: list[tuple[str, str, list[str]]]) -> DataFrame:
    """_id, _th, found (labels), score of the texts that hold a template."""
    spark, key = slim.sparkSession, ["_id", "_th"]
    wanted = []
    for t, (_, text, own) in enumerate(templates):
        for p in own:
            places = [q for q in range(len(text.split())) if text.split()[q : q + len(p.split())] == p.split()]
            wanted += [(p, t, q, len(own)) for q in places[:1]]
    needed = spark.createDataFrame(wanted, "name string, template int, q int, needed int")
    some = slim.where("phrases is not null")
    half = WIDTH // 2
    cells = lambda df: df.withColumn("cell", F.floor((F.col("p") - F.col("q")) / half)).withColumn("cell", F.explode(F.array(F.col("cell"), F.col("cell") - 1)))
    where = [*key, "template", "cell"]
    told = some.select(*key, F.explode("phrases").alias("x")).select(*key, "x.p", "x.name").join(F.broadcast(needed), "name")
    told = cells(told).groupBy(*where, "name").agg(F.max("needed").alias("needed")).groupBy(*where).agg(F.count(F.lit(1)).alias("there"), F.max("needed").alias("needed"))
    told = told.where("there = needed").select(*where)
    met = some.select(*key, F.explode("hits").alias("x")).select(*key, "x.p", "x.word").join(F.broadcast(postings), "word")
    met = cells(met).groupBy(*where, "q").agg(F.max("weight").alias("weight"), F.max("whole").alias("whole"))
    met = met.groupBy(*where).agg(F.sum("weight").alias("weight"), F.max("whole").alias("whole")).where(F.col("weight") * 100 >= F.col("whole") * SHARE_PERCENT)
    label = F.get(F.array(*[F.lit(x) for x, _, _ in templates]), F.col("template"))
    both = met.join(told, where, "left_semi").select(*key, label.alias("label"), (F.col("weight") / F.col("whole")).alias("score"))
    return both.groupBy(*key).agg(F.collect_set("label").alias("found"), F.max("score").alias("score"))


def op13(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
