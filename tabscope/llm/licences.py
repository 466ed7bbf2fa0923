"""Licence notices found by Dice similarity to templates. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Usual notices of common licences.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    (
        "MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    ("BSD", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)

NOT_WORDS = "[^\\p{L}\\p{N}]+"
# Stands for a line that is a notice; no word is like it.
LINE = "\n"


def words_of(unit: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(unit), NOT_WORDS, -1), "")


def bigrams(words: Column) -> Column:
    """Distinct pairs of neighbouring words of an array of two or more."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.concat(F.get(words, i - 1), F.lit(" "), F.get(words, i))))


def size_bounds(sizes: list[int], threshold: float) -> tuple[int, int]:
    """Between what sizes a set can reach the threshold with any of the given ones: 2 * min >= threshold * (a + b)."""
    ratio = threshold / (2 - threshold)
    return int(min(sizes) * ratio), int(max(sizes) / ratio) + 1


def telling_words(words: list[str], need: int) -> list[str]:
    """Long words first, as many as it takes that a text without any of them has fewer than ``need`` of the bigrams."""
    left = set(zip(words, words[1:], strict=False))
    chosen: list[str] = []
    for word in sorted(set(words), key=lambda w: (-len(w), w)):
        if len(left) < need:
            break
        chosen.append(word)
        left = {pair for pair in left if word not in pair}
    return chosen


def scan(docs: DataFrame, threshold: float = 0.8, templates: tuple[tuple[str, str], ...] = TEMPLATES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: ``doc_id``, ``n_notices``, ``licences``, ``best_dice``.

    Units are compared with the templates by the Dice coefficient of their
    distinct word bigrams, in this order:

    1. Each line. Templates whose size lets them not reach the threshold are
       passed over, and lines no template could match are never cut into bigrams.
    2. What stands between matching lines, its lines joined: windows of each
       template's number of words (fewer at the end) that begin with a bigram of
       it. A window needs a least number of the template's bigrams, which their
       positions tell before any window is cut. From left to right, a match that
       overlaps the one at hand takes its place if it is better, else is dropped.
    3. The whole text, if nothing else matches.

    ``n_notices`` counts what matches, ``licences`` names the best template's
    licence of each, distinct and sorted; of equal ones the first template wins.
    Null or empty texts and units of one word match nothing (``best_dice``
    null). Equal rows each get a row of their own; an empty table gives an empty
    one. Nothing is shuffled; other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    prepared = spark.createDataFrame([(n, name, body) for n, (name, body) in enumerate(templates)], "no int, name string, body string")
    prepared = prepared.select("no", "name", words_of(F.col("body")).alias("words")).select("*", bigrams(F.col("words")).alias("grams")).orderBy("no").collect()
    needs = {r["no"]: max(1, int(len(r["grams"]) * threshold / (2 - threshold))) for r in prepared}
    known = F.array(
        *(
            F.struct(
                F.lit(-r["no"]).alias("rank"),
                F.lit(r["name"]).alias("name"),
                F.lit(r["grams"]).alias("grams"),
                F.lit(len(r["words"])).alias("length"),
                F.lit(needs[r["no"]]).alias("need"),
            )
            for r in prepared
        )
    )
    low, high = size_bounds([len(r["grams"]) for r in prepared], threshold)
    telling = sorted({word for r in prepared for word in telling_words(r["words"], needs[r["no"]])})
    any_gram = sorted({gram for r in prepared for gram in r["grams"]})

    def dice(grams: Column, t: Column) -> Column:
        return 2.0 * F.size(F.array_intersect(t["grams"], grams)) / (F.size(t["grams"]) + F.size(grams))

    def best(grams: Column) -> Column:
        possible = F.filter(known, lambda t: 2 * F.least(F.size(t["grams"]), F.size(grams)) >= threshold * (F.size(t["grams"]) + F.size(grams)))
        scored = F.transform(possible, lambda t: F.struct(dice(grams, t).alias("dice"), t["rank"].alias("rank"), t["name"].alias("name")))
        return F.array_max(F.filter(scored, lambda s: s["dice"] >= threshold))

    def best_of(units: Column) -> Column:
        """The best match of each unit of words, null where there is none."""
        cut = F.transform(units, lambda w: F.when(F.size(w) > max(1, low), bigrams(w)))
        return F.transform(cut, lambda g: F.when(F.size(g).between(low, high), best(g)))

    def windows(words: Column, places: Column) -> Column:
        """Matches of windows by start; ``places`` are the positions of all template bigrams."""

        def of(t: Column) -> Column:
            own = F.transform(F.filter(places, lambda p: F.array_contains(t["grams"], p["gram"])), lambda p: p["at"])
            # A window's bigrams begin at most length - 2 words after its first.
            begun = F.transform(
                F.filter(F.transform(own, lambda at, k: F.struct(at.alias("at"), F.get(own, k + t["need"] - 1).alias("last"))), lambda p: p["last"] <= p["at"] + t["length"] - 2),
                lambda p: F.struct(p["at"].alias("at"), F.slice(words, p["at"], t["length"]).alias("words")),
            )
            inside = F.transform(
                begun,
                lambda b: F.struct(
                    b["at"].alias("at"),
                    F.when(F.array_contains(b["words"], LINE), F.slice(b["words"], F.lit(1), F.array_position(b["words"], LINE).cast("int") - 1)).otherwise(b["words"]).alias("words"),
                ),
            )
            scored = F.transform(
                F.transform(inside, lambda b: F.struct(b["at"].alias("at"), (b["at"] + F.size(b["words"])).alias("end"), bigrams(b["words"]).alias("grams"))),
                lambda b: F.struct(b["at"].alias("at"), (-dice(b["grams"], t)).alias("minus"), (-t["rank"]).alias("no"), t["name"].alias("name"), b["end"].alias("end")),
            )
            return F.filter(scored, lambda s: -s["minus"] >= threshold)

        return F.array_sort(F.flatten(F.transform(known, of)))

    def noted(matches: Column) -> Column:
        """Number, licences and best Dice of the windows that are notices."""
        nothing = "struct<n:bigint,names:array<string>,dice:double,end:int,minus:double,no:int,name:string>"
        first = F.struct(
            F.lit(0).cast("bigint").alias("n"), F.array().cast("array<string>").alias("names"), F.lit(None).cast("double").alias("dice"),
            F.lit(0).alias("end"), F.lit(None).cast("double").alias("minus"), F.lit(None).cast("int").alias("no"), F.lit(None).cast("string").alias("name"),
        ).cast(nothing)

        def closed(a: Column) -> list[Column]:
            names = F.when(a["name"].isNull(), a["names"]).otherwise(F.array_union(a["names"], F.array(a["name"])))
            return [names.alias("names"), F.greatest(a["dice"], -a["minus"]).alias("dice")]

        def step(a: Column, m: Column) -> Column:
            own = [m[f].alias(f) for f in ("end", "minus", "no", "name")]
            better = F.struct(m["minus"], m["no"]) < F.struct(a["minus"], a["no"])
            following = F.struct((a["n"] + 1).alias("n"), *closed(a), *own).cast(nothing)
            instead = F.struct(a["n"].alias("n"), a["names"].alias("names"), a["dice"].alias("dice"), *own).cast(nothing)
            return F.when(m["at"] >= a["end"], following).when(better, instead).otherwise(a)

        return F.aggregate(matches, first, step, lambda a: F.struct(a["n"].alias("n"), *closed(a)))

    whole = F.coalesce(F.col(text), F.lit(""))
    lines = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.transform(F.split(whole, "\n", -1), words_of).alias("lines"))
    lines = lines.select("doc_id", "lines", best_of(F.col("lines")).alias("best"))
    rest = F.flatten(F.zip_with("lines", "best", lambda w, b: F.when(b.isNull(), w).otherwise(F.array(F.lit(LINE)))))
    rest = lines.select("doc_id", "best", F.when(F.size("lines") > 1, F.flatten("lines")).alias("whole"), rest.alias("rest"))
    gram = lambda i: F.concat(F.get("rest", i - 1), F.lit(" "), F.get("rest", i))
    pairs = F.when((F.size("rest") > 1) & F.arrays_overlap("rest", F.lit(telling)), F.sequence(F.lit(1), F.size("rest") - 1)).otherwise(F.array().cast("array<int>"))
    places = F.transform(F.filter(pairs, lambda i: gram(i).isin(any_gram)), lambda i: F.struct(i.alias("at"), gram(i).alias("gram")))
    placed = rest.select("doc_id", F.filter("best", lambda b: b.isNotNull()).alias("best"), "whole", "rest", places.alias("places"))
    found = placed.select("doc_id", "best", "whole", noted(windows(F.col("rest"), F.col("places"))).alias("noted"))
    alone = (F.size("best") == 0) & (F.col("noted")["n"] == 0) & F.col("whole").isNotNull()
    of_whole = F.filter(best_of(F.when(alone, F.array("whole")).otherwise(F.array().cast("array<array<string>>"))), lambda b: b.isNotNull())
    met = found.select("doc_id", "noted", F.concat("best", of_whole).alias("met"))
    return met.select(
        "doc_id",
        (F.size("met") + F.col("noted")["n"]).cast("bigint").alias("n_notices"),
        F.array_join(F.array_sort(F.array_union(F.transform("met", lambda m: m["name"]), F.col("noted")["names"])), ",").alias("licences"),
        F.greatest(F.array_max(F.transform("met", lambda m: m["dice"])), F.col("noted")["dice"]).alias("best_dice"),
    )
