"""Licence scan by a trained paragraph classifier.

A paragraph is a stretch of neighbouring lines with a word; comment markers are no
words. Its words are looked at in windows around words that licences use, at any
place of a line and over line ends. The word n-grams of a window that templates use go
through a multinomial logistic regression over licence families and an unknown class,
trained on every window of the corpus that holds nothing like a template, as it is and
with a statement of a family set into it. The unknown class is calibrated on all of
these: a window needs more confidence than all but a small share of ordinary ones
reach under a model that has not seen them.
The families that the classifier names are then confirmed, and placed, by their own
templates: a stretch of the window must have most of a template's n-grams, and its
names and version numbers. SPDX identifiers are read as such.

Everything runs in the JVM: DataFrame functions and the DataFrame-based
machine-learning library.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.ml import Model, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, NGram, SQLTransformer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wiretally.llm.common import staged

UNKNOWN = "unknown"
# The statements by which texts name their licence.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        "software and associated documentation files",
        "The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software.",
        "The software is provided as is, without warranty of any kind, express or implied, including "
        "but not limited to the warranties of merchantability, fitness for a particular purpose and "
        "noninfringement.",
        "This project is licensed under the terms of the MIT license.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Released under the Apache License 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this '
        "file except in compliance with the License.",
        "Apache License, Version 2.0, January 2004",
        "This file is licensed under Apache 2.0.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "Released under the GNU GPL v3.",
        "This program is free software: you can redistribute it and/or modify it under the terms "
        "of the GNU General Public License as published by the Free Software Foundation, either "
        "version 3 of the License",
        "This file is licensed under GPL version 3.",
        "under the terms of the GNU General Public License version 3",
        "GNU General Public License Version 3, June 2007",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "Released under the GNU GPL v2.",
        "This program is free software; you can redistribute it and/or modify it under the terms "
        "of the GNU General Public License as published by the Free Software Foundation; either "
        "version 2 of the License",
        "This file is licensed under GPL version 2.",
        "under the terms of the GNU General Public License version 2",
        "GNU General Public License Version 2, June 1991",
    ),
    "AGPL-3.0": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "Released under the GNU AGPL v3.",
        "This program is free software: you can redistribute it and/or modify it under the terms "
        "of the GNU Affero General Public License as published by the Free Software Foundation, "
        "either version 3 of the License",
        "This file is licensed under AGPL version 3.",
    ),
    "LGPL-2.1": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "Released under the GNU LGPL v2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms "
        "of the GNU Lesser General Public License as published by the Free Software Foundation; "
        "either version 2.1 of the License",
        "This file is licensed under LGPL version 2.1.",
    ),
    "LGPL-3.0": (
        "This library is licensed under the GNU Lesser General Public License, version 3.",
        "Released under the GNU LGPL v3.",
        "This library is free software: you can redistribute it and/or modify it under the terms "
        "of the GNU Lesser General Public License as published by the Free Software Foundation, "
        "either version 3 of the License",
        "This file is licensed under LGPL version 3.",
    ),
    "BSD-3-Clause": (
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met",
        "Neither the name of the copyright holder nor the names of its contributors may be used to "
        "endorse or promote products derived from this software",
        "This file is licensed under the BSD 3-Clause License.",
    ),
    "BSD-2-Clause": (
        "Released under the BSD 2-Clause License.",
        "Licensed under the Simplified BSD 2-Clause License.",
        "This file is licensed under the BSD 2-Clause License.",
    ),
    "ISC": (
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
        "without fee is hereby granted",
        "This file is licensed under the ISC License.",
    ),
    "EPL-2.0": (
        "Released under the Eclipse Public License 2.0.",
        "This program and the accompanying materials are made available under the terms of the "
        "Eclipse Public License 2.0",
    ),
    "EPL-1.0": (
        "Released under the Eclipse Public License 1.0.",
        "This program and the accompanying materials are made available under the terms of the "
        "Eclipse Public License v1.0",
    ),
    "MPL-2.0": (
        "Released under the Mozilla Public License 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "This file is licensed under MPL 2.0.",
        "Mozilla Public License Version 2.0",
    ),
    "CC-BY-4.0": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "CC-BY-SA-4.0": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International "
        "License.",
    ),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 "
        "International License.",
    ),
    "CC0-1.0": (
        "Released under CC0 1.0.",
        "To the extent possible under law, the author has waived all copyright and related rights "
        "to this work.",
    ),
    "all-rights-reserved": (
        "All rights reserved.",
        "Copyright. All rights reserved. No part may be reproduced without permission.",
    ),
}
# Steps of the confidence by which ordinary windows are counted.
LEVELS = 10_000
# Share of ordinary windows that may be as confident as a find.
MOST_FALSE = 0.001
# The confidence that a find needs at least, where ordinary windows have next to none.
LEAST_LEVEL = 0.05
# Share of probability at which the classifier names a family; a window may hold several statements.
NAMED = 0.1
# Share of a template's n-grams that a statement must have, in a few more words than it.
LEAST_OVERLAP = 0.6
SLACK = 4
# A template alone weighs as much as this share of the windows learned from, and at least as so many.
TEMPLATE_SHARE, TEMPLATE_WEIGHT = 1 / 300, 4.0
# A window's words: those of a block and the longest template before and after it.
BLOCK, AROUND = 16, 48
# Parts of words of which every template has one. What has none can be no find.
_STEMS = ("licen", "copyright", "permission", "redistribut", "rights", "waived", "software", "gpl", "cc0")
# Words of a template without which nothing is said of its family.
_DECIDING = r"[0-9]|^(?:mit|apache|gnu|[al]?gpl|lesser|affero|bsd|mozilla|mpl|cc|creative|isc|eclipse|epl)$"
# Words by which some languages begin a comment.
_COMMENT = r"^\s*(?i:rem|dnl)(?=\s)"
_SPDX = r"(?i)SPDX-License-Identifier:\s*([^\n]*)"
_SPDX_ID = r"[A-Za-z][A-Za-z0-9.-]*\+?"


def words_of(text: Column) -> Column:
    """Lower-case words of letters and digits; a dot or hyphen between them stays."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+(?:[.-][\p{L}\p{N}]+)*"), F.lit(0))


def has_stem(text: Column) -> Column:
    """Whether lower-case ``text`` has a part that licences use."""
    return reduce(Column.__or__, [F.contains(text, F.lit(x)) for x in _STEMS])


_GRAMS = (
    "array_distinct(concat({words}, transform(sequence(1, greatest(size({words}) - 1, 1)), "
    "i -> concat_ws(' ', get({words}, i - 1), get({words}, i)))))"
)


def _grams(words: str) -> Column:
    """Distinct single words and pairs."""
    return F.expr(_GRAMS.format(words=words))


def templates(spark: SparkSession) -> DataFrame:
    rows = [(family, text) for family, texts in TEMPLATES.items() for text in texts]
    return spark.createDataFrame(rows, "family string, text string").select(
        "family", words_of(F.col("text")).alias("words")
    )


def _deciding(words: Column) -> Column:
    """The words with a digit and those of names; ``v3``, ``3`` and ``3.0`` are the same."""
    return F.transform(
        F.filter(words, lambda w: w.rlike(_DECIDING) & ~w.contains(" ")),
        _plain_number,
    )


def _plain_number(word: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(word, r"^v(?=\d)", ""), r"(?<=\d)\.0$", "")


def _known(spark: SparkSession) -> Column:
    """A constant map of each family to its templates: ``words``, ``grams`` and deciding words."""
    rows = (
        templates(spark)
        .select("family", "words", _grams("words").alias("grams"), _deciding(F.col("words")).alias("deciding"))
        .collect()
    )
    by_family = {f: [{c: r[c] for c in ("words", "grams", "deciding")} for r in rows if r["family"] == f] for f in TEMPLATES}
    kind = "map<string, array<struct<words: array<string>, grams: array<string>, deciding: array<string>>>>"
    return F.from_json(F.lit(json.dumps(by_family)), kind)


def _vocabulary(spark: SparkSession) -> list[str]:
    """The n-grams of all templates; others can't tell one family from another."""
    grams = templates(spark).select(F.explode(_grams("words")).alias("g")).distinct().collect()
    return sorted(r["g"] for r in grams)


def _counted(vocabulary: list[str]) -> CountVectorizerModel:
    return CountVectorizerModel.from_vocabulary(vocabulary, "grams", "features", binary=True)


def _featured(vocabulary: list[str]) -> list:
    return [
        NGram(n=2, inputCol="words", outputCol="pairs"),
        SQLTransformer(statement="SELECT *, array_distinct(concat(words, pairs)) AS grams FROM __THIS__"),
        _counted(vocabulary),
    ]


def _paragraphs(docs: DataFrame) -> DataFrame:
    """``row, doc_id, paragraph, words, lines``: the words of each paragraph and the lines they are on."""
    numbered = docs.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.split("text", "\n", -1).alias("of_text")
    )
    lines = numbered.select("row", "doc_id", F.posexplode("of_text").alias("line", "text")).select(
        "row", "doc_id", "line", words_of(F.regexp_replace("text", _COMMENT, "")).alias("words")
    )
    # Written once, so that rows keep their numbers.
    lines = staged(lines, "lines")
    so_far = Window.partitionBy("row").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    blank = F.size("words") == 0
    return (
        lines.withColumn("paragraph", F.count_if(blank).over(so_far))
        .where(~blank)
        .groupBy("row", "doc_id", "paragraph")
        .agg(F.sort_array(F.collect_list(F.struct("line", "words"))).alias("l"))
        .select(
            "row",
            "doc_id",
            "paragraph",
            F.flatten("l.words").alias("words"),
            F.flatten(F.transform("l", lambda x: F.array_repeat(x["line"], F.size(x["words"])))).alias("lines"),
        )
    )


def _windows(paragraphs: DataFrame) -> DataFrame:
    """``row, doc_id, paragraph, first, words, lines``: the words around each block that has a stem.

    ``first`` is the place of the window's first word in its paragraph. The windows
    alone are exploded, so that no paragraph travels beside each of its own.
    """
    around = F.expr(
        f"transform(filter(sequence(0, size(words) - 1, {BLOCK}), b -> exists(slice(words, b + 1, {BLOCK}), w -> "
        + " or ".join(f"contains(w, '{x}')" for x in _STEMS)
        + f")), b -> struct(greatest(b - {AROUND}, 0) as first, "
        f"slice(words, greatest(b - {AROUND}, 0) + 1, b - greatest(b - {AROUND}, 0) + {BLOCK + AROUND}) as words, "
        f"slice(lines, greatest(b - {AROUND}, 0) + 1, b - greatest(b - {AROUND}, 0) + {BLOCK + AROUND}) as lines))"
    )
    return paragraphs.select("row", "doc_id", "paragraph", F.explode(around).alias("x")).select(
        "row", "doc_id", "paragraph", "x.*"
    )


def _ordinary(docs: DataFrame, known: Column) -> DataFrame:
    """``words, h, grams``: every window of every text that holds nothing like a template.

    The windows follow each other; ``grams`` are those that templates use, and
    ``h`` is a hash of the words. The one-element explodes here and in ``_examples`` keep
    n-grams from being made again for each template.
    """
    size = BLOCK + 2 * AROUND
    pieces = F.expr(f"transform(sequence(1, greatest(size(w), 1), {size}), i -> slice(w, i, {size}))")
    windows = (
        docs.where("text is not null")
        .select(words_of(F.col("text")).alias("w"))
        .select(F.explode(pieces).alias("words"))
        .where(F.size("words") > 0)
    )
    grams = windows.select(
        "words", F.abs(F.xxhash64("words")).alias("h"), F.explode(F.array(_known_grams(docs.sparkSession))).alias("grams")
    )
    # A template with more than twice the n-grams can't be half there.
    like = F.exists(
        F.flatten(F.map_values(known)),
        lambda t: F.when(
            F.size("grams") * 2 >= F.size(t["grams"]), F.size(F.array_intersect("grams", t["grams"])) * 2 >= F.size(t["grams"])
        ).otherwise(F.lit(False)),
    )
    return grams.where(~like)


def _known_grams(spark: SparkSession) -> Column:
    """The n-grams of ``words`` that templates use, in order."""
    known = _vocabulary(spark)
    # Letters, digits, dots and hyphens.
    single, pair = (", ".join(f"'{g}'" for g in known if (" " in g) == two) for two in (False, True))
    here = f"filter(sequence(0, size(words) - 1), i -> words[i] in ({single}))"
    pairs = "transform(p, i -> concat_ws(' ', words[i], get(words, i + 1)))"
    both = f"concat(transform(p, i -> words[i]), filter({pairs}, g -> g in ({pair})))"
    return F.expr(f"sort_array(array_distinct(transform(array({here}), p -> {both})[0]))")


def _statements(spark: SparkSession) -> DataFrame:
    """``i, label, said``: the templates' words, numbered, and the numbers of their families from 1."""
    said = [(i, float(1 + list(TEMPLATES).index(f)), t) for i, (f, t) in enumerate((f, t) for f, x in TEMPLATES.items() for t in x)]
    return spark.createDataFrame(said, "i int, label double, text string").select(
        "i", "label", words_of(F.col("text")).alias("said")
    )


def _examples(docs: DataFrame, known: Column) -> DataFrame:
    """``half, label, grams, n``: the ordinary windows as they are, with label 0, and with a statement.

    Each different window counts once, however often it occurs, and takes one statement
    after and before some of its words. ``n`` windows have the same ``grams``;
    that is all that the regression sees of them.
    """
    spark = docs.sparkSession
    many = sum(map(len, TEMPLATES.values()))
    before, after = (f"slice(words, {begin}, cast(h div {by} % {AROUND} as int))" for begin, by in ((1, 1000), (AROUND + 1, 100_000)))
    joined = _ordinary(docs, known).join(F.broadcast(_statements(spark)), F.col("h") % many == F.col("i"))
    inside = joined.select("h", "grams", "label", F.explode(F.array(F.expr(f"concat({before}, said, {after})"))).alias("words"))
    different = inside.select("h", "grams", "label", _known_grams(spark).alias("inside")).distinct()
    both = F.array(
        F.struct(F.lit(0.0).alias("label"), F.col("grams")), F.struct("label", F.col("inside").alias("grams"))
    )
    return (
        different.select((F.expr(f"h div {many}") % 2).alias("half"), F.explode(both).alias("x"))
        .groupBy("half", "x.label", "x.grams")
        .agg(F.count("*").cast("double").alias("n"))
    )


def _fit(examples: DataFrame, alone: DataFrame) -> Model:
    """The regression of ``examples`` and the templates ``alone``."""
    total = examples.where("label = 0").agg(F.sum("n")).head()[0] or 0
    weight = max(TEMPLATE_WEIGHT, TEMPLATE_SHARE * total)
    rows = examples.select("features", "label", F.col("n").alias("weight")).union(
        alone.select("features", "label", F.lit(weight))
    )
    regression = LogisticRegression(
        family="multinomial", maxIter=40, regParam=0.0005, weightCol="weight", standardization=False
    )
    return regression.fit(rows)


def learn(docs: DataFrame, known: Column) -> tuple[PipelineModel, float]:
    """The classifier, and the confidence that a find needs.

    It learns from every template alone and set into ordinary windows, and from such
    windows as they are, of the whole corpus. For the confidence, two more are learned,
    one from each half of the windows, and tried on the other half.
    """
    spark = docs.sparkSession
    vocabulary = _vocabulary(spark)
    counted = _counted(vocabulary)
    examples = staged(counted.transform(staged(_examples(docs, known), "examples")), "fitting")
    alone = _statements(spark).coalesce(1).select("label", F.col("said").alias("words"))
    alone = counted.transform(alone.select("label", _grams("words").alias("grams")))
    tried = [
        _fit(examples.where(F.col("half") != half), alone).transform(examples.where((F.col("half") == half) & (F.col("label") == 0)))
        for half in (0, 1)
    ]
    step = F.ceil((1 - vector_to_array("probability")[0]) * LEVELS).cast("int")
    # At most one row a step.
    ordinary = tried[0].union(tried[1]).groupBy(step.alias("step")).agg(F.sum("n").alias("n")).collect()
    model = PipelineModel([*_featured(vocabulary), _fit(examples, alone)])
    return model, max(LEAST_LEVEL, _level({r["step"]: r["n"] for r in ordinary})) if ordinary else 0.5


def _level(ordinary: dict[int, float]) -> float:
    """The least confidence above which there are at most ``MOST_FALSE`` of the windows, by their numbers of each step."""
    above, most = 0.0, MOST_FALSE * sum(ordinary.values())
    for step in sorted(ordinary, reverse=True):
        above += ordinary[step]
        if above > most:
            return step / LEVELS
    return 0.0


def _identifiers(docs: DataFrame) -> DataFrame:
    """Finds by SPDX identifiers, each of an expression."""
    lines = F.posexplode(F.split("text", "\n", -1)).alias("paragraph", "line")
    said = F.regexp_extract_all(F.regexp_extract("line", _SPDX, 1), F.lit(_SPDX_ID), F.lit(0))
    plain = F.lower(F.regexp_replace("id", r"(?i)(?:-only|-or-later|\+)$", ""))
    names = F.create_map(*[F.lit(x) for f in TEMPLATES for x in (f.lower(), f)])
    return (
        docs.where(F.contains(F.lower("text"), F.lit("spdx-license-identifier")))
        .select("doc_id", lines)
        .where(F.col("line").rlike(_SPDX))
        .select("doc_id", "paragraph", F.explode(F.array_distinct(said)).alias("id"))
        .select("doc_id", "paragraph", names[plain].alias("family"))
        .where(F.col("family").isNotNull())
        .select("*", F.lit(1.0).alias("score"), F.lit(1.0).alias("overlap"))
    )


def license_paragraphs(docs: DataFrame) -> DataFrame:
    """``doc_id, paragraph, family, score, overlap`` of each statement of a licence.

    ``paragraph`` is the line, from 0, on which the statement begins; it may go on
    over lines that follow, up to one without a word, and begin anywhere in a line of
    any length. ``score`` is the classifier's probability of the family and ``overlap`` the
    share of its nearest template. Of statements that share a word the nearest to a
    template counts, then the likeliest, then the first. Defined cases: a null or
    empty text has no paragraph; the notice common to the BSD licences is
    BSD-3-Clause; an SPDX identifier has score and overlap 1; repeated rows give
    repeated finds; an empty table gives none; other columns are not read.
    """
    known = _known(docs.sparkSession)
    low = F.lower("text")
    marked = docs.select("doc_id", "text").where(has_stem(low))
    windows = staged(_windows(_paragraphs(marked)), "windows")
    model, level = learn(docs, known)
    scored = model.transform(windows).withColumn("p", vector_to_array("probability"))
    families = F.array(*[F.lit(f) for f in TEMPLATES])
    likely = F.filter(
        F.arrays_zip(families.alias("family"), F.slice("p", 2, len(TEMPLATES)).alias("p")), lambda x: x["p"] >= NAMED
    )
    named = staged(
        scored.where(1 - F.col("p")[0] >= level).select(
            "row", "doc_id", "paragraph", "first", "words", "lines", F.explode(likely).alias("x")
        ).select("row", "doc_id", "paragraph", "first", "words", "lines", "x.*"),
        "named",
    )
    named = named.withColumn("plain", F.transform("words", _plain_number)).withColumn("known", known[F.col("family")])
    # Where a template of the named family may begin, and how much of it is there.
    here = f"slice(words, j + 1, size(t.words) + {SLACK})"
    grams = _GRAMS.format(words="h")
    tried = (
        "filter(flatten(transform(known, t -> transform("
        "filter(sequence(0, size(words) - 1), j -> words[j] = t.words[0] or get(words, j + 1) = t.words[1]), "
        f"j -> struct(j, size(t.words) as n, transform(array({here}), h -> "
        f"size(array_intersect({grams}, t.grams)) / size(t.grams))[0] as overlap, "
        f"size(array_except(t.deciding, slice(plain, j + 1, size(t.words) + {SLACK}))) = 0 as decided)))), "
        f"x -> x.decided and x.overlap >= {LEAST_OVERLAP})"
    )
    finds = (
        named.select("row", "doc_id", "paragraph", "first", "lines", "family", "p", F.explode(F.expr(tried)).alias("x"))
        .groupBy("row", "doc_id", "paragraph", (F.col("first") + F.col("x.j")).alias("begin"), "family")
        .agg(
            F.max(F.struct("x.overlap", "p", "x.n")).alias("best"),
            F.first(F.expr("lines[x.j]")).alias("line"),
        )
        .select("row", "doc_id", "paragraph", "begin", "family", "line", "best.*")
    )
    # Of neighbours that share words the better one, along the paragraph.
    order = F.struct("begin", (F.col("begin") + F.col("n")).alias("end"), "overlap", "p", "family", "line")
    better = "(x.overlap > k.overlap or x.overlap = k.overlap and x.p > k.p)"
    chosen = F.expr(
        "aggregate(all, slice(all, 1, 0), (kept, x) -> if(size(kept) > 0 and element_at(kept, -1).end > x.begin, "
        f"if(exists(array(element_at(kept, -1)), k -> {better}), "
        "concat(slice(kept, 1, size(kept) - 1), array(x)), kept), concat(kept, array(x))))"
    )
    finds = (
        finds.groupBy("row", "doc_id", "paragraph")
        .agg(F.sort_array(F.collect_list(order)).alias("all"))
        .select("doc_id", F.explode(chosen).alias("x"))
        .select("doc_id", F.col("x.line").alias("paragraph"), "x.family", F.col("x.p").alias("score"), "x.overlap")
    )
    return finds.unionByName(_identifiers(docs))
