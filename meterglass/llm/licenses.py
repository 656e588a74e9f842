"""License scans: a trained paragraph classifier whose predictions templates confirm, by DataFrame functions alone.

A multinomial logistic regression on words and pairs of words tells the licence families and an unknown class apart. Its
margin over unknown must pass a cut calibrated on held-back unknown paragraphs, and a template of the family must then
share enough of its word pairs with the paragraph. Paragraphs are single lines, and stretches of adjoining lines, as
notices are often wrapped; what is long is taken in overlapping pieces that hold any template whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

UNKNOWN = "unknown"
# fixed values: notices as the licences' own texts and the SPDX list word them
TEMPLATES = {
    "agpl": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: AGPL-3.0-only", "SPDX-License-Identifier: AGPL-3.0-or-later",
    ),
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES",
        "Released under the BSD 3-Clause License.", "Licensed under the BSD 2-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause", "SPDX-License-Identifier: BSD-2-Clause",
    ),
    "cc-by": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0"),
    "cc0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "Dedicated to the public domain under CC0 1.0 Universal.", "SPDX-License-Identifier: CC0-1.0"),
    "epl": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "Licensed under the Eclipse Public License 2.0.", "SPDX-License-Identifier: EPL-2.0"),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "Licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-only", "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "isc": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "Released under the ISC License.", "SPDX-License-Identifier: ISC"),
    "lgpl": (
        "This library is licensed under the GNU Lesser General Public License, version 3.",
        "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "SPDX-License-Identifier: LGPL-2.1-or-later", "SPDX-License-Identifier: LGPL-3.0-only",
    ),
    "mit": (
        "Released under the MIT License.", "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
        "SPDX-License-Identifier: MIT",
    ),
    "mpl": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0.", "SPDX-License-Identifier: MPL-2.0"),
    "unlicense": ("This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary", "SPDX-License-Identifier: Unlicense"),
}
FAMILIES = (*sorted(TEMPLATES), UNKNOWN)
#: Talk of licences, rights and permissions that grants none: examples of the unknown class for every corpus.
OTHER = (
    "She got her driving license at the age of eighteen.", "A fishing license is needed to use the lake.", "The pub lost its license last year.", "This is copyright nobody.", "All rights reserved.",
    "Copyright 2019 by the author. All rights reserved.", "Ask the owner for permission before you use the picture.", "The library is free and open to the general public.", "Software distributed without permission is a problem.",
    "The terms of the contract are the following.", "The foundation published a report about free software.", "The license of this work is not known.", "Please read the license before you go on.", "Permission was granted by the city.",
    "We need a source of light and a public place.", "The redistribution of land took many years.", "Creative people have much in common.", "The warranty ends after two years.", "The department licensed the drug for general use.", "see the license file",
)
FEATURES = 1 << 14
#: Distinct lines of the corpus that stand for the unknown class, at most, of each kind: plain ones, and ones with a
#: string of NOTICE that no template comes near to; those with the smallest hash.
MOST_UNKNOWN = 3_000
#: Words of a piece of corpus text that templates are put beside, and how many are put beside each.
PIECE, TEMPLATES_A_PIECE = 9, 3
#: So much of every template's pairs has a word with one of these strings, in whatever case, that what is left is less than
#: CONFIRMED: a paragraph without them can't be a notice. Lines without them are plain.
NOTICE = (
    "licen", "copyright", "permission", "warrant", "gnu", "affero", "software", "compliance", "binary", "obtain", "distribut", "implied", "express", "modif", "permitted", "conditions", "retain", "bsd", "4.0",
    "neighboring", "waived", "extent", "cc0", "eclipse", "accompanying", "materials", "merchantab", "purpose", "granted", "released", "lesser", "hereby", "mozilla", "subject", "2.0", "unencumbered", "domain", "compile",
)
#: Share of a template's pairs of neighbouring words that a paragraph must have for the template to confirm its family,
#: and from which on a paragraph is no example of the unknown class.
CONFIRMED, NEAR = 0.6, 0.35
#: Chance of wrongly naming a family that the cut on the classifier's margin leaves to unknown paragraphs.
WRONG = 0.001
LINE = "\\r?\\n"
#: Characters of lines that are taken whole; longer ones, and stretches of lines, are taken in pieces of 2 * STEP words
#: that overlap by STEP, which is more words than any template has.
LONG, STEP = 600, 40


def words_of(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.lower(text), "[^a-z0-9.-]+"), lambda w: F.trim(w, F.lit(".-"))), lambda w: w != "")


def pairs_of(words: Column) -> Column:
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.concat(a, F.lit(" "), b))


def has_any(text: Column, strings: Iterable[str]) -> Column:
    """Whether the text, in lower case, holds one of the strings; lowered once for all of them."""
    return F.exists(F.array(F.lower(text)), lambda low: reduce(lambda a, b: a | b, [low.contains(s) for s in strings]))


def template_pairs(template: str) -> list[str]:
    found = [w for raw in re.split("[^a-z0-9.-]+", template.lower()) if (w := raw.strip(".-"))]
    return sorted({f"{a} {b}" for a, b in zip(found, found[1:], strict=False)})


def nearness(pairs: Column, family: Column | None = None) -> Column:
    """The largest share of a template's pairs that are among these, over all templates, or those of the family."""
    table = F.array(*(F.struct(F.lit(f).alias("family"), F.array(*map(F.lit, template_pairs(t))).alias("pairs")) for f, many in TEMPLATES.items() for t in many))
    asked = table if family is None else F.filter(table, lambda t: t["family"] == family)
    return F.coalesce(F.array_max(F.transform(asked, lambda t: F.size(F.array_intersect(pairs, t["pairs"])) / F.size(t["pairs"]))), F.lit(0.0))


def tokens_of(line: Column) -> Column:
    """What stands between blanks, if it has a word; each is a word or more."""
    return F.filter(F.split(line, "\\s+"), lambda w: w.rlike("[A-Za-z0-9]"))


def slices(tokens: Column) -> Column:
    """The tokens' overlapping pieces."""

    def cut(words: Column) -> Column:
        last = F.greatest(F.ceil(F.size(words) / STEP).cast("int") - 2, F.lit(0))
        return F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(words, k * STEP + 1, 2 * STEP))

    return F.transform(F.array(tokens), cut)[0]  # in an array, so that tokens are made once and not for each piece


def pieces_of(line: Column) -> Column:
    """The line, or its overlapping pieces if it is long: features of thousands of words would drown each other."""
    return F.when(F.length(line) <= LONG, F.array(line)).otherwise(F.transform(slices(tokens_of(line)), lambda words: F.array_join(words, " ")))


def lines_of(docs: DataFrame, text: str) -> DataFrame:
    """(paragraph): lines that are not blank, or pieces of long ones."""
    return docs.select(F.explode(F.flatten(F.transform(F.split(F.col(text), LINE), pieces_of))).alias("paragraph")).where(F.trim("paragraph") != "")


def stretches(text: Column) -> Column:
    """Arrays of adjoining lines that aren't blank, each line with its number before it and a \\1 between."""
    numbered = F.transform(F.split(text, LINE), lambda line, i: F.when(F.trim(line) == "", "").otherwise(F.concat(i.cast("string"), F.lit("\1"), line)))
    return F.filter(F.transform(F.split(F.array_join(numbered, "\n"), "\n{2,}"), lambda s: F.trim(s, F.lit("\n"))), lambda s: s != "")


def candidates(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, place, lines, piece, paragraph): what may hold a notice.

    Lines with a string of NOTICE, or pieces of long ones, and pieces of stretches of lines that aren't blank. Nothing that
    shares CONFIRMED of a template's pairs within STEP words is left out, however it is wrapped.
    """
    docs = docs.where(has_any(F.col(text), NOTICE)).select(F.col(key).alias("key"), F.explode(stretches(F.col(text))).alias("stretch"))
    docs = docs.where(has_any(F.col("stretch"), NOTICE)).select("key", F.split("stretch", "\n").alias("all"))
    docs = docs.select("key", F.transform("all", lambda x: F.transform(F.array(F.split(x, "\1", 2)), lambda y: F.struct(y[0].cast("int").alias("place"), y[1].alias("line")))[0]).alias("all"))

    def alone(x: Column) -> Column:
        return F.transform(pieces_of(x["line"]), lambda p, k: F.struct(x["place"].alias("place"), F.lit(1).alias("lines"), k.alias("piece"), p.alias("paragraph")))

    def joined(words: Column) -> Column:
        """Words with a blank, or the end of a line, between."""
        gap = lambda w, k: F.when(k == 0, "").when(F.get(words, k - 1)["place"] < w["place"], "\n").otherwise(" ")
        return F.array_join(F.transform(words, lambda w, k: F.concat(gap(w, k), w["word"])), "")

    def together(words: Column) -> Column:
        first = F.get(words, F.lit(0))["place"]
        return F.struct(first.alias("place"), (F.element_at(words, -1)["place"] - first + 1).alias("lines"), F.lit(0).alias("piece"), joined(words).alias("paragraph"))

    words = F.flatten(F.transform("all", lambda x: F.transform(tokens_of(x["line"]), lambda w: F.struct(x["place"].alias("place"), w.alias("word")))))
    several = F.filter(slices(words), lambda w: (F.size(w) > 0) & (F.element_at(w, -1)["place"] > F.get(w, F.lit(0))["place"]))
    units = F.flatten(F.transform(F.filter("all", lambda x: has_any(x["line"], NOTICE)), alone))
    units = F.when(F.size("all") > 1, F.concat(units, F.transform(several, together))).otherwise(units)
    return docs.select("key", F.explode(units).alias("x")).select("key", "x.*").where(has_any(F.col("paragraph"), NOTICE))


def features(rows: DataFrame) -> DataFrame:
    """Adds words, their pairs and the sparse features of a paragraph."""
    hashed = HashingTF(numFeatures=FEATURES, binary=True, inputCol="_terms", outputCol="features")
    rows = rows.withColumn("_words", words_of(F.col("paragraph"))).withColumn("_pairs", pairs_of(F.col("_words")))
    return hashed.transform(rows.withColumn("_terms", F.concat("_words", "_pairs"))).drop("_words", "_terms")


def unknown_lines(lines: DataFrame) -> DataFrame:
    """(paragraph, talks): distinct lines with the smallest hashes, MOST_UNKNOWN at most with and without talk of rights.

    Estimates of how many distinct ones there are bound the hashes that are looked at, so few lines are shuffled.
    """
    h, talks = F.xxhash64("paragraph"), has_any(F.col("paragraph"), NOTICE)
    rows = lines.select("paragraph", h.alias("h"), talks.alias("talks"))
    n = rows.agg(*(F.approx_count_distinct(F.when(F.col("talks") == yes, F.col("h")), 0.03).alias(str(yes)) for yes in (True, False))).first()
    below = [(1 << 63) - 1 if n[str(yes)] < 1.5 * MOST_UNKNOWN else int((1 << 64) * 1.5 * MOST_UNKNOWN / n[str(yes)]) - (1 << 63) for yes in (True, False)]
    rows = common.cut(rows.where(F.col("h") <= F.when(F.col("talks"), below[0]).otherwise(F.lit(below[1]))).distinct())
    least = [rows.where(F.col("talks") == yes).orderBy("h", "paragraph").limit(MOST_UNKNOWN) for yes in (True, False)]
    return common.cut(least[0].union(least[1]).select("paragraph", "talks"))


def examples(lines: DataFrame) -> DataFrame:
    """(paragraph, label, part): templates alone and inside other text, and unknown lines, one part in 4 held back."""
    spark = lines.sparkSession
    unknown = float(len(FAMILIES) - 1)
    sample = unknown_lines(lines)
    plain = sample.where("not talks").select("paragraph")
    hard = features(sample.where("talks")).where(nearness(F.col("_pairs")) < NEAR).select("paragraph")
    notices = [(t, float(FAMILIES.index(f))) for f, many in sorted(TEMPLATES.items()) for t in many]
    listed = F.array(*(F.struct(F.lit(k).cast("long").alias("k"), F.lit(t).alias("notice"), F.lit(label).alias("label")) for k, (t, label) in enumerate(notices)))
    numbered = spark.range(1).select(F.explode(listed).alias("x")).select("x.*")
    # pieces of corpus text alone, and with a few templates picked by their hash, before, after or amid them
    words = words_of(F.col("paragraph"))
    pieces = plain.select(F.array_join(F.slice(words, 1, PIECE), " ").alias("piece"), F.array_join(F.slice(words, PIECE + 1, PIECE), " ").alias("more"), F.explode(F.sequence(F.lit(0), F.lit(TEMPLATES_A_PIECE - 1))).alias("way"), F.xxhash64("paragraph").alias("h"))
    mixed = pieces.withColumn("k", F.pmod(F.xxhash64("h", "way"), F.lit(len(notices)))).join(F.broadcast(numbered), "k")
    mixed = mixed.select(F.when(F.col("way") % 3 == 0, F.concat_ws(" ", "notice", "piece")).when(F.col("way") % 3 == 1, F.concat_ws(" ", "piece", "notice")).otherwise(F.concat_ws(" ", "piece", "notice", "more")).alias("paragraph"), "label")
    plain = plain.union(pieces.where("way = 0").select("piece"))
    other = spark.range(1).select(F.explode(F.array(*map(F.lit, OTHER))).alias("paragraph"))
    rows = numbered.select(F.col("notice").alias("paragraph"), "label").union(mixed).union(plain.union(hard).select("paragraph", F.lit(unknown).alias("label")))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("paragraph", F.lit(7)), F.lit(4)))
    # templates and fixed examples are always learned from, so that all classes are always there
    alone = F.col("paragraph").isin([t for t, _ in notices])
    rows = rows.withColumn("part", F.when(alone, F.lit(1)).otherwise(F.col("part")).cast("long"))
    return rows.union(other.select("paragraph", F.lit(unknown), F.lit(1).cast("long")))


def confidence(model: LogisticRegressionModel, rows: DataFrame) -> DataFrame:
    """Adds family (the likeliest but unknown) and margin (its log odds against unknown)."""
    out = model.transform(features(rows)).withColumn("_l", vector_to_array(F.col("rawPrediction")))
    out = out.withColumn("_best", F.array_max(F.slice("_l", 1, len(FAMILIES) - 1)))
    named = F.element_at(F.array(*map(F.lit, FAMILIES)), F.array_position("_l", F.col("_best")).cast("int"))
    return out.withColumns({"family": named, "margin": F.col("_best") - F.element_at("_l", len(FAMILIES))}).drop("_l", "_best", "features", "rawPrediction", "probability", "prediction")


def fit(lines: DataFrame) -> tuple[LogisticRegressionModel, float]:
    """The classifier, and the margin that held-back lines of the unknown class exceed with a chance of WRONG.

    The cut is the empirical quantile of their margins; where fewer than 1 / WRONG are held back, their largest margin.
    """
    rows = common.cut(examples(lines))
    learner = LogisticRegression(family="multinomial", regParam=1e-3, elasticNetParam=0.0, maxIter=40)
    model = learner.fit(features(rows.where("part > 0")).select("features", "label"))
    held = confidence(model, rows.where(f"part = 0 and label = {len(FAMILIES) - 1}"))
    seen = held.agg(F.percentile("margin", 1 - WRONG).alias("q"), F.max("margin").alias("m"), F.count("*").alias("n")).first()
    return model, max(0.0, (seen["q"] if seen["n"] * WRONG >= 1 else seen["m"]) or 0.0)


def confirmed(family: Column) -> Column:
    """Whether a template of the family shares enough of its pairs with the paragraph."""
    return nearness(F.col("_pairs"), family) >= CONFIRMED


def nearness_by_family() -> Column:
    """The nearness of a row's pairs to each family."""
    share = lambda p: F.size(F.array_intersect("_pairs", p)) / F.size(p)
    most = {f: F.array_max(F.transform(F.array(*(F.array(*map(F.lit, template_pairs(t))) for t in many)), share)) for f, many in TEMPLATES.items()}
    return F.create_map(*(x for f, n in most.items() for x in (F.lit(f), n)))


def settled(found: DataFrame) -> DataFrame:
    """Notices without lines and stretches of unlike families that are one notice; drops _near.

    Where a line is as near to the family of a stretch around it, it is but a part of that. Where the line alone would
    confirm the stretch's family, and is nearer to its own, the stretch is only what stands around the line.
    """
    names = ("key", "place", "lines", "piece", "family")
    around = found.where("lines > 1").select(*(F.col(c).alias(f"s_{c}") for c in names), F.explode(F.expr("sequence(place, place + lines - 1)")).alias("at"))
    line = found.where("lines = 1").select(*(F.col(c).alias(f"l_{c}") for c in names), "_near")
    met = around.join(line, F.col("s_key").eqNullSafe(F.col("l_key")) & (F.col("at") == F.col("l_place")) & (F.col("s_family") != F.col("l_family")))
    there, own = F.element_at("_near", F.col("s_family")), F.element_at("_near", F.col("l_family"))
    part = F.when(there >= own, "l").when(there >= CONFIRMED, "s")
    lost = common.cut(met.select(*(F.when(part == "l", F.col(f"l_{c}")).otherwise(F.col(f"s_{c}")).alias(f"x_{c}") for c in names), part.alias("_part")).where("_part is not null").distinct())
    same = [F.col("key").eqNullSafe(F.col("x_key")), *(F.col(c) == F.col(f"x_{c}") for c in names[1:])]
    return found.drop("_near").join(lost, reduce(lambda a, b: a & b, same), "left_anti")


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, place, lines, paragraph, family, margin) of each paragraph that the classifier and a template call a notice.

    place: number of its first line, from 0; lines: how many there are. A wrapped stretch counts only where no line of
    it is a notice of its family by itself, see also `settled`; what overlaps and is of one family is given once. Null and empty texts have no
    paragraphs. Rows of a repeated key are all scanned; a notice at the same lines of both is given once. An empty table
    gives an empty result; a corpus without a plain line is judged by the fixed examples of the unknown class alone.
    """
    # written first: Spark would otherwise merge the filters and classify every line
    likely = common.cut(candidates(docs, key, text).distinct())
    if likely.isEmpty():  # nothing to tell apart
        return likely.select(F.col("key").alias(key), "place", "lines", "paragraph", F.lit(UNKNOWN).alias("family"), F.lit(0.0).alias("margin"))
    model, cut = fit(lines_of(docs, text))
    # and again: the comparison would otherwise ask the classifier anew for every template
    found = common.cut(confidence(model, likely).where(F.col("margin") > cut)).where(confirmed(F.col("family"))).withColumn("_near", nearness_by_family()).drop("_pairs")
    # the next line from here on that is a notice by itself
    ahead = Window.partitionBy("key", "family").orderBy(F.desc("place")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    own = F.min(F.when(F.col("lines") == 1, F.col("place"))).over(ahead) < F.col("place") + F.col("lines")
    found = settled(common.cut(found.withColumn("_own", F.coalesce(own, F.lit(False))).where("lines = 1 or not _own").drop("_own")))
    before = F.lag(F.struct("place", "lines", "piece")).over(Window.partitionBy("key", "family", F.col("lines") > 1).orderBy("place", "lines", "piece"))
    again = F.when(F.col("lines") > 1, F.col("_b.place") + F.col("_b.lines") > F.col("place")).otherwise((F.col("_b.place") == F.col("place")) & (F.col("_b.piece") == F.col("piece") - 1))
    found = found.withColumn("_b", before).where(~F.coalesce(again, F.lit(False)))
    return found.select(F.col("key").alias(key), "place", "lines", "paragraph", "family", "margin")


def summary(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_lines, n_notices, licences) of each key: lines that aren't blank; the sorted distinct families, joined."""
    n = F.size(F.filter(F.split(F.coalesce(F.col(text), F.lit("")), LINE), lambda p: F.trim(p) != "")).cast("long")
    each = docs.groupBy(key).agg(F.sum(n).alias("n_lines"))
    found = scan(docs, key, text).groupBy(key).agg(F.count("*").alias("n_notices"), F.array_join(F.array_sort(F.collect_set("family")), ",").alias("licences"))
    return each.alias("e").join(found.alias("f"), F.col(f"e.{key}").eqNullSafe(F.col(f"f.{key}")), "left").select(F.col(f"e.{key}").alias(key), "n_lines", F.coalesce("n_notices", F.lit(0)).alias("n_notices"), F.coalesce("licences", F.lit("")).alias("licences"))
