"""License scans (DataFrame functions only).

1. The lines of a file, and its spans of as many words as a template has, are compared with licence templates by the cosine of
   their TF-IDF vectors.  Spans cross lines and start anywhere within them, so wrapped and embedded notices are found too.
   Document frequencies of the templates' words are counted over all files; words of no template weigh as if no other file had them.
2. A prefix of each template's heaviest words is chosen so that what is left can't reach the threshold: a line or span without
   any of these words is not compared, and none that would match is missed.  Nor is a span whose words hold too little
   of the template's weight to reach the threshold.
3. A file without a licence of its own inherits from its nearest ancestor directory that has one, by joins on paths.
"""

from __future__ import annotations

import json
import math
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

#: Licence templates: the statements that headers use, and first lines of licence files.  Fixed values.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
]


def words_of(text: str) -> list[str]:
    return [w for w in "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split() if w]


def words(line: Column) -> Column:
    """ASCII words, lower-cased, as ``words_of``."""
    return F.filter(F.split(F.lower(line), "[^a-z0-9]+"), lambda w: w != "")


def template_vectors(files: int, frequency: dict[str, int]) -> tuple[list[tuple[str, dict[str, float]]], dict[str, float]]:
    """(licence, unit vector of its words) and the words' inverse document frequencies."""
    idf = {w: math.log((1 + files) / (1 + frequency.get(w, 0))) + 1 for _, t in TEMPLATES for w in words_of(t)}
    out = []
    for name, text in TEMPLATES:
        weights = {w: n * idf[w] for w, n in Counter(words_of(text)).items()}
        norm = math.sqrt(sum(v * v for v in weights.values()))
        out.append((name, {w: v / norm for w, v in sorted(weights.items())}))
    return out, idf


def telling_words(vectors: list[tuple[str, dict[str, float]]], threshold: float) -> list[str]:
    """Words of which every line that reaches the threshold with some template has one."""
    chosen = set()
    for _, vector in vectors:
        rest = sum(v * v for v in vector.values())
        for word, value in sorted(vector.items(), key=lambda x: (-x[1], x[0])):
            if rest < threshold * threshold - 1e-9:
                break
            chosen.add(word)
            rest -= value * value
    return sorted(chosen)


def spans(texts: DataFrame, vectors: list[tuple[str, dict[str, float]]], threshold: float) -> DataFrame:
    """``_id, line, _words``: spans of the files' words, as long as a template, that may reach the threshold with it, and the
    lines they start in."""
    sizes = F.array(*[F.lit(len(words_of(t))) for _, t in TEMPLATES])
    owners: dict[str, list[int]] = {}
    for i, (_, vector) in enumerate(vectors):
        for w in telling_words([(_, vector)], threshold):
            owners.setdefault(w, []).append(i + 1)
    owner = F.from_json(F.lit(json.dumps(owners)), "map<string,array<int>>")
    squares = F.from_json(F.lit(json.dumps([{w: v * v for w, v in vector.items()} for _, vector in vectors])), "array<map<string,double>>")

    def may(rows: str) -> Column:
        """The words hold enough of the template's weight (Cauchy-Schwarz)."""
        held = F.array_distinct(F.transform(rows, lambda x: x["w"]))
        return F.aggregate(held, F.lit(0.0), lambda a, w: a + F.coalesce(F.try_element_at(F.element_at(squares, F.col("t")), w), F.lit(0.0))) >= threshold * threshold - 1e-7

    telling = F.array(*[F.lit(w) for w in sorted(owners)])
    flat = F.flatten(F.transform(F.split("_text", "\n"), lambda text, i: F.transform(words(text), lambda w: F.struct(w.alias("w"), (i + 1).alias("line")))))
    whole = texts.where(F.arrays_overlap(words(F.col("_text")), telling)).select("_id", flat.alias("_flat"))
    told = F.filter(F.transform("_flat", lambda x, i: F.struct(i.alias("p"), F.try_element_at(owner, x["w"]).alias("ts"))), lambda h: h["ts"].isNotNull())

    def near(p: Column, t: Column) -> Column:
        """What spans around place ``p`` can hold; they start in its first ``starts`` words."""
        size = F.element_at(sizes, t)
        first = F.greatest(p - size + 1, F.lit(0))
        return F.struct(t.alias("t"), (p - first + 1).alias("starts"), F.slice("_flat", first + 1, p - first + size).alias("near"))

    around = whole.select("_id", F.inline(F.flatten(F.transform(told, lambda h: F.transform(h["ts"], lambda t: near(h["p"], t)))))).where(may("near"))
    begun = around.select("_id", "t", "near", F.explode(F.sequence(F.lit(1), F.col("starts"))).alias("o"))
    cut = begun.select("_id", "t", F.slice("near", F.col("o"), F.element_at(sizes, F.col("t"))).alias("span")).where(may("span"))
    return cut.select("_id", F.element_at("span", 1)["line"].alias("line"), F.transform("span", lambda x: x["w"]).alias("_words"))


def own_licenses(files: DataFrame, *, id_col: str, text_col: str, threshold: float = 0.75) -> DataFrame:
    """``id_col, line`` (from 1), ``license, score`` for each file with a line or span whose cosine with a template reaches
    ``threshold``: its best one's (first) line, the first of equals.  Null and empty texts have none."""
    vocabulary = sorted({w for _, t in TEMPLATES for w in words_of(t)})
    known = F.array(*[F.lit(w) for w in vocabulary])
    text = F.coalesce(F.col(text_col), F.lit(""))
    whole = files.select(F.col(id_col).alias("_id"), text.alias("_text"))
    counted = (
        whole.select(F.explode(F.array_intersect(F.split(F.lower("_text"), "[^a-z0-9]+"), known)).alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()
    )  # one row for each word of the templates
    files_ = whole.count()
    vectors, idf = template_vectors(files_, {r["w"]: r["n"] for r in counted})
    telling = F.array(*[F.lit(w) for w in telling_words(vectors, threshold)])
    rare = math.log((1 + files_) / 2) + 1  # a word that one file has
    # Stored, as few lines are left, and as the predicate on scores would otherwise be pushed down and evaluate every vector anew.
    lines = checkpointed(
        whole.select("_id", F.posexplode(F.split("_text", "\n")).alias("line", "_line"))
        .withColumn("_words", words(F.col("_line"))).where(F.arrays_overlap("_words", telling))
        .select("_id", (F.col("line") + 1).alias("line"), "_words").union(spans(whole, vectors, threshold))
    )
    weights = F.from_json(F.lit("{" + ",".join(f'"{w}":{idf[w]!r}' for w in vocabulary) + "}"), "map<string,double>")
    counts = F.transform(F.array_distinct("_words"), lambda w: F.struct(w.alias("w"), (F.size(F.filter("_words", lambda x: x == w)) * F.coalesce(F.try_element_at(weights, w), F.lit(rare))).alias("v")))
    vector = lines.withColumn("_vector", counts).withColumn("_norm", F.sqrt(F.aggregate("_vector", F.lit(0.0), lambda a, x: a + x["v"] * x["v"])))

    def cosine(template: dict[str, float]) -> Column:
        own = F.from_json(F.lit("{" + ",".join(f'"{w}":{v!r}' for w, v in template.items()) + "}"), "map<string,double>")
        return F.aggregate("_vector", F.lit(0.0), lambda a, x: a + x["v"] * F.coalesce(F.try_element_at(own, x["w"]), F.lit(0.0))) / F.col("_norm")

    best = F.array_max(F.array(*[F.struct(F.round(cosine(v), 9).alias("score"), F.lit(-i).alias("order"), F.lit(name).alias("license")) for i, (name, v) in enumerate(vectors)]))
    scored = checkpointed(vector.select("_id", "line", best.alias("b"))).where(F.col("b.score") >= threshold)
    chosen = F.max(F.struct(F.col("b.score").alias("score"), (-F.col("line")).alias("at"), F.col("b.order").alias("order"), F.col("b.license").alias("license")))
    return scored.groupBy("_id").agg(chosen.alias("c")).select(F.col("_id").alias(id_col), (-F.col("c.at")).alias("line"), F.col("c.license").alias("license"), F.col("c.score").alias("score"))


def ancestors(path: Column) -> Column:
    """The directories above a path, nearest first; the root is the empty string."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.size(parts) - 1, F.lit(0), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def inherited(files: DataFrame, owners: DataFrame, *, path_col: str = "path") -> DataFrame:
    """``files`` with ``dir_license`` and ``dir_from``: the licence of the nearest directory at or above each path that
    ``owners`` (``dir, dir_license``) has; both are null where there is none."""
    held = files.withColumn("_dir", F.element_at(ancestors(F.coalesce(F.col(path_col), F.lit(""))), 1))
    dirs = held.select("_dir").distinct()
    steps = dirs.select("_dir", F.posexplode(F.concat(F.array("_dir"), F.filter(ancestors(F.col("_dir")), lambda d: d != F.col("_dir")))).alias("_far", "dir"))
    found = steps.join(owners, "dir").groupBy("_dir").agg(F.min(F.struct("_far", "dir", "dir_license")).alias("n"))
    return held.join(found, "_dir", "left").withColumn("dir_license", F.col("n.dir_license")).withColumn("dir_from", F.col("n.dir")).drop("n", "_dir")


def license_scan(files: DataFrame, *, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text", threshold: float = 0.75) -> DataFrame:
    """``id_col, path_col, own_license, line, score, license, inherited_from`` for every file.

    A directory's licence is that of its licensed file of the smallest id (the smallest path breaks ties).  ``license`` is the file's own or the
    nearest directory's (``inherited_from``, null for its own).  A null path lies in the root.

    Ids need not be unique: rows are told apart by id, path and text, and rows that agree in all three have the same result each.  No rows give none; only the
    named columns are read.
    """
    told = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    key = F.sha2(F.concat(*[told(F.col(c).cast("string")) for c in (id_col, path_col, text_col)]).cast("binary"), 256)
    own = checkpointed(own_licenses(files.select(key.alias("_row"), F.col(text_col)), id_col="_row", text_col=text_col, threshold=threshold))
    named = files.select(id_col, path_col, key.alias("_row")).join(own, "_row", "left").drop("_row")
    placed = named.where(F.col("license").isNotNull()).withColumn("dir", F.element_at(ancestors(F.coalesce(F.col(path_col), F.lit(""))), 1))
    owners = placed.groupBy("dir").agg(F.min(F.struct(F.col(id_col), F.col(path_col), F.col("license"))).alias("o")).select("dir", F.col("o.license").alias("dir_license"))
    out = inherited(named, owners, path_col=path_col)
    return out.select(
        id_col, path_col, F.col("license").alias("own_license"), "line", "score", F.coalesce("license", "dir_license").alias("license"),
        F.when(F.col("license").isNull(), F.col("dir_from")).alias("inherited_from"),
    )


def op4_license_scan(spark, sf_dir: str) -> DataFrame:
    """Licences of ``documents``, their own or their directory's."""
    from .common import table

    docs = table(spark, sf_dir, "documents")
    # The table has no paths; a source is a directory tree by language.
    return license_scan(docs.withColumn("path", F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))))
