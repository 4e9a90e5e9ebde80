"""Licence scans: a trained classifier of paragraphs over sparse word n-grams, confirmed by templates.

DataFrame, SQL and Spark ML operations only. A paragraph is a line of a text. Templates are the names of the families in usual
phrases, and the notices and paragraphs of their texts; the classifier also learns pieces of these (as wrapped lines give them) and
phrases inside ordinary lines. How sure it must be is calibrated on ordinary lines and on families left out of the fit.
"""

from __future__ import annotations

import re
from itertools import chain

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenlake.llm.common import saved
from lumenlake.plans.parallel import spread

NONE, UNKNOWN = "none", "unknown"
FEATURES = 1 << 14
#: Ordinary paragraphs that the classifier is fitted on, from at most so many documents.
SAMPLE_DOCS, SAMPLE_LINES = 2_000, 10_000
#: Share of a paragraph's word pairs that the template of its family must hold.
LEAST_SHARED = 0.6
#: Least probability of a family, whatever the calibration says.
LEAST = 0.5
#: Share of a template's word pairs that a longer paragraph must hold instead.
LEAST_HELD = 0.9
#: Rates of ordinary paragraphs, and of paragraphs of families left out of the fit, that the calibrated limit lets through.
FALSE_RATE, STRANGE_RATE = 1e-3, 0.05
#: The limit never asks for more than this.
MOST = 0.9
#: Words of the pieces of long templates, and from start to start.
PIECE, STEP = 12, 6
#: Families left out of one fit for the calibration (those that share names or texts are on one side), and its iterations.
LEFT_OUT, LEFT_OUT_ITERATIONS = ["CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC0-1.0", "Apache-2.0", "Unlicense", "MPL-2.0"], 20

# fixed values: names of licence families, and public sentences that only they use
NAMES = {
    "MIT": ["MIT License", "MIT licence", "Expat License", "MIT"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0", "Apache 2.0 License"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU General Public License v3.0", "GNU GPL version 3", "GPL-3.0", "GPLv3"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU General Public License v2.0", "GNU GPL version 2", "GPL-2.0", "GPLv2"],
    "LGPL": ["GNU Lesser General Public License", "GNU Lesser General Public License, version 3", "LGPL-3.0", "LGPL-2.1", "LGPL"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "GNU Affero General Public License", "AGPL-3.0", "AGPLv3"],
    "BSD": ["BSD License", "BSD 2-Clause License", "BSD 3-Clause License", "BSD-3-Clause", "BSD-2-Clause"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL-2.0", "MPL 2.0"],
    "ISC": ["ISC License", "ISC"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License", "CC-BY-4.0"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "CC-BY-SA-4.0"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "CC-BY-NC-4.0"],
    "CC0-1.0": ["CC0 1.0 Universal", "CC0-1.0", "CC0", "Creative Commons Zero v1.0 Universal"],
    "Unlicense": ["The Unlicense", "Unlicense"],
}
PHRASES = [
    "Licensed under the {}.",
    "Licensed under {}.",
    "Released under the {}.",
    "Released under {}.",
    "This work is licensed under the {}.",
    "This work is licensed under {}.",
    "This software is distributed under the terms of the {}.",
    "Distributed under the {}.",
    "Available under the {}.",
    "SPDX-License-Identifier: {}",
    "License: {}",
    "Lizenz: {}",
    "Unter der {}-Lizenz.",
    "Veröffentlicht unter der {}.",
    "Sous licence {}.",
    "Bajo la licencia {}.",
    "{}",
]
# names of other licences and of none, which make a paragraph one of no known family
OTHERS = [
    "Example Community License", "vendor agreement", "Artistic License 2.0", "zlib License", "European Union Public Licence",
    "Eclipse Public License", "Boost Software License", "Sleepycat License", "WTFPL", "Open Software License", "company licence",
]
# public texts of licences: notices, conditions, disclaimers and preambles
TEXTS = {
    "MIT": [
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ],
    "Apache-2.0": [
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ],
    "GPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "The GNU General Public License is a free, copyleft license for software and other kinds of works.",
        "The licenses for most software and other practical works are designed to take away your freedom to share and change the works. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change all versions of a program--to make sure it remains free software for all its users.",
    ],
    "GPL-2.0": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users.",
    ],
    "LGPL": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below.",
    ],
    "AGPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software.",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    ],
    "CC0-1.0": ["The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law."],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    UNKNOWN: [
        "All rights reserved.",
        "This file is licensed under a proprietary license.",
        "Released under a custom license, see the file LICENSE for details.",
        "Use of this source code is governed by a license that can be found in the LICENSE file.",
        "This work is licensed under our own licence terms.",
    ],
}


def words(text: Column) -> Column:
    """Words of letters and digits, in lower case."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def _once(made: Column) -> Column:
    """A value that is made once a row: a filter on it stays above, where a filter on a plain column moves below and makes it again."""
    return F.explode(F.array(made))


def _pairs(column: str) -> Column:
    """Neighbouring words of an array, joined by a blank."""
    found = F.col(column)
    n = F.greatest(F.lit(0), F.size(found) - 1)
    return F.zip_with(F.slice(found, F.lit(1), n), F.slice(found, F.lit(2), n), lambda a, b: F.concat(a, F.lit(" "), b))


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, words) of every line that holds a word."""
    lines = spread(docs.select("doc_id", "text")).select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.select("doc_id", _once(words(F.col("line"))).alias("words")).where("size(words) > 0")


def _templates(spark: SparkSession) -> DataFrame:
    """(family, words, pairs, phrase) of all templates: names in phrases (``phrase``), and paragraphs of the texts."""
    named = [(f, name, phrase) for f, names in [*NAMES.items(), (UNKNOWN, OTHERS)] for name in names for phrase in PHRASES]
    # a short name alone on a line may be any word
    rows = [(f, phrase.format(name), True) for f, name, phrase in named if phrase != "{}" or not _may_be_a_word(name) and f != UNKNOWN]
    rows += [(f, text, False) for f, texts in TEXTS.items() for text in texts]
    found = spark.createDataFrame(rows, "family string, line string, phrase boolean")
    found = found.select("family", words(F.col("line")).alias("words"), "phrase")
    return found.select("family", "words", _pairs("words").alias("pairs"), "phrase")


def _names(spark: SparkSession) -> dict[str, list[str]]:
    """Per family, its names as words between blanks; a name that may be any word only inside a phrase."""
    rows = []
    for f, names in NAMES.items():
        for name in names:
            forms = [p.format(name) for p in PHRASES if p != "{}"] if _may_be_a_word(name) else [name]
            rows += [(f, form) for form in forms]
    found = spark.createDataFrame(rows, "family string, form string")
    padded = F.concat(F.lit(" "), F.array_join(words(F.col("form")), " "), F.lit(" "))
    return {r.family: r.n for r in found.groupBy("family").agg(F.collect_set(padded).alias("n")).collect()}


def _may_be_a_word(name: str) -> bool:
    return name.isalpha() and len(name) < 4


def _held() -> Column:
    """Ordinary lines that the fit leaves to the calibration."""
    return F.pmod(F.xxhash64("words"), F.lit(5)) == 0


def _lessons(templates: DataFrame, ordinary: DataFrame) -> DataFrame:
    """(family, words, pairs, phrase) to learn: templates, pieces of long ones, phrases inside ordinary lines, ordinary lines."""
    last = F.size("words") - PIECE
    starts = F.explode(F.sequence(F.lit(0), last, F.lit(STEP)))
    pieces = templates.where(last > 0).select("family", "words", "phrase", starts.alias("at"))
    pieces = pieces.select("family", F.expr(f"slice(words, at + 1, {PIECE})").alias("words"), "phrase")
    # Both sides are bounded: the templates above, and at most SAMPLE_LINES lines.
    # Lines held for the calibration stay out, or their rare words would be learnt with the phrases only.
    fitted = ordinary.where(~_held())
    lines = fitted.select(F.col("words").alias("around"), F.row_number().over(Window.orderBy(F.xxhash64("words"), "words")).alias("n"))
    phrases = templates.where("phrase").select("family", "words", F.row_number().over(Window.orderBy("family", "words")).alias("n"))
    inside = phrases.join(lines, "n").select(
        "family",
        F.concat(F.expr(f"slice(around, 1, {PIECE})"), "words", F.expr(f"slice(around, {PIECE + 1}, {PIECE})")).alias("words"),
        F.lit(False).alias("phrase"),
    )
    added = pieces.unionByName(inside).select("family", "words", _pairs("words").alias("pairs"), "phrase")
    return templates.unionByName(added).unionByName(ordinary.withColumn("phrase", F.lit(False)))


_CUES = r"(?i)licen[sc]|lizenz|copyright|rights reserved|\b(?:apache|gnu|l?gpl|bsd|mozilla|cc0|spdx)\b|creative commons|public domain"
#: Every name of a family, as a whole word; names that may be words of a language ("mit") in capitals only.
_NAMED = (
    r"(?<![\p{L}\p{N}])(?:(?i:"
    + "|".join(re.escape(name) for names in NAMES.values() for name in names if not _may_be_a_word(name))
    + ")|"
    + "|".join(re.escape(name) for names in NAMES.values() for name in names if _may_be_a_word(name))
    + r")(?![\p{L}\p{N}])"
)


def _ordinary(docs: DataFrame, templates: DataFrame) -> DataFrame:
    """A bounded sample of distinct paragraphs without any word of licences, name of a family or run of their texts, by a hash of the id."""
    chosen = docs.where("text is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS)
    lines = docs.join(F.broadcast(chosen), "doc_id").select(F.explode(F.split("text", "\n")).alias("line")).where(~F.col("line").rlike(_CUES) & ~F.col("line").rlike(_NAMED))
    told = templates.where("not phrase").select(F.explode("pairs").alias("p")).distinct().collect()
    found = lines.select("line", words(F.col("line")).alias("words")).where("size(words) > 0").withColumn("pairs", _pairs("words"))
    shared = F.size(F.array_intersect("pairs", F.array(*[F.lit(r.p) for r in told]))) / F.greatest(F.size("pairs"), F.lit(1))
    found = found.where(shared < LEAST_SHARED / 2).select("line", "words", "pairs").dropDuplicates(["line"])
    return found.orderBy(F.xxhash64("line"), "line").limit(SAMPLE_LINES).select(F.lit(NONE).alias("family"), "words", "pairs")


class Scanner:
    """The fitted classifier with its limit and the templates' word pairs."""

    def __init__(self, docs: DataFrame):
        spark = docs.sparkSession
        templates = _templates(spark)
        rows = saved(_lessons(templates, saved(_ordinary(docs, templates), "licence_lines")), "licence_sample")
        self.features = HashingTF(inputCol="grams", outputCol="vector", numFeatures=FEATURES, binary=True)
        texts = templates.where("not phrase").groupBy("family").agg(F.collect_set(F.array_distinct("pairs")).alias("p"))
        self.texts = {r.family: r.p for r in texts.collect()}
        self.names = _names(spark)
        ready = self._vectors(rows).withColumn("held", (F.col("family") == NONE) & _held())
        strange = self._strange(ready)
        self._fit(ready.where("not held"))
        ordinary = ready.where("held")
        self.limit = min(MOST, max(LEAST, self._limit(ordinary, FALSE_RATE), strange))
        # About a licence of whatever family: beyond what the ordinary lines reach.
        allowed = int(FALSE_RATE * ordinary.count())
        about = self._predict(ordinary).where(F.col("predicted") != NONE).orderBy(F.desc("about")).limit(allowed + 1).collect()
        self.about = min(MOST, max(LEAST, about[allowed].about)) if len(about) > allowed else LEAST

    def _fit(self, ready: DataFrame, iterations: int = 60) -> None:
        index = StringIndexer(inputCol="family", outputCol="class", stringOrderType="alphabetAsc").fit(ready)
        self.families: list[str] = list(index.labels)
        sizes = {r["family"]: r["count"] for r in ready.groupBy("family").count().collect()}
        weights = F.create_map(*chain(*((F.lit(f), F.lit((4000.0 if f == NONE else 1000.0) / n)) for f, n in sizes.items())))
        weighed = index.transform(ready).withColumn("weight", F.element_at(weights, F.col("family")))
        self.model: LogisticRegressionModel = LogisticRegression(
            featuresCol="vector", labelCol="class", weightCol="weight", family="multinomial", regParam=1e-4, maxIter=iterations
        ).fit(weighed)

    def _strange(self, ready: DataFrame) -> float:
        """The limit that a fit without some families needs to call most of their phrases no known family."""
        out = F.col("family").isin(LEFT_OUT)
        self._fit(ready.where(~out & ~F.col("held")), LEFT_OUT_ITERATIONS)
        return self._limit(ready.where(out & F.col("phrase")), STRANGE_RATE)

    def _limit(self, rows: DataFrame, rate: float) -> float:
        """The probability that at most this rate of the rows exceed with a family that their templates confirm."""
        wrong = self._predict(rows).where(~F.col("predicted").isin(NONE, UNKNOWN)).where(self._shared() >= LEAST_SHARED)
        allowed = int(rate * rows.count())
        above = wrong.orderBy(F.desc("probability")).select("probability").limit(allowed + 1).collect()
        return above[allowed].probability if len(above) > allowed else LEAST

    def _vectors(self, rows: DataFrame) -> DataFrame:
        return self.features.transform(rows.withColumn("grams", F.concat("words", "pairs")))

    def _predict(self, vectors: DataFrame) -> DataFrame:
        """Adds the most probable class (of equal ones the first by name) and its probability."""
        found = self.model.setProbabilityCol("shares").transform(vectors).select(*vectors.columns, _once(vector_to_array("shares")).alias("shares"))
        best = F.array_max("shares")
        names = F.array(*map(F.lit, self.families))
        about = 1 - F.get("shares", F.lit(self.families.index(NONE))) if NONE in self.families else F.lit(1.0)
        predicted = F.element_at(names, F.array_position("shares", best).cast("int"))
        return found.withColumns({"probability": best, "predicted": predicted, "about": about})

    def _shared(self) -> Column:
        """How well the predicted family's templates and the paragraph agree.

        1 if the paragraph holds a name of the family. Otherwise the larger of: the share of the paragraph's word pairs
        that the family's texts hold, and the share of a text's pairs that the paragraph holds, if at least ``LEAST_HELD``.
        """

        def by_family(listed: dict[str, Column]) -> Column:
            return F.element_at(F.create_map(*chain(*((F.lit(f), c) for f, c in listed.items()))), F.col("predicted"))

        names = by_family({f: F.array(*map(F.lit, n)) for f, n in self.names.items()})
        texts = by_family({f: F.array(*[F.array(*map(F.lit, t)) for t in p]) for f, p in self.texts.items()})
        line, distinct = F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" ")), F.array_distinct("pairs")
        named = F.coalesce(F.exists(names, lambda n: F.contains(line, n)), F.lit(False))
        many = F.size(F.array_intersect(distinct, F.flatten(texts))) / F.greatest(F.size(distinct), F.lit(1))
        held = F.array_max(F.transform(texts, lambda t: F.size(F.array_intersect(t, distinct)) / F.size(t)))
        return F.when(named, 1.0).otherwise(F.greatest(F.lit(0.0), F.when(texts.isNotNull(), many), F.when(held >= LEAST_HELD, held)))

    def scan(self, docs: DataFrame) -> DataFrame:
        """(doc_id, family, probability, shared) of every paragraph that is about a licence; every paragraph is weighed."""
        told = paragraphs(docs)
        found = self._predict(self._vectors(told.withColumn("pairs", _pairs("words")))).where(F.col("predicted") != NONE)
        checked = found.select("doc_id", "predicted", "probability", "about", self._shared().alias("shared"))
        sure = (F.col("predicted") != UNKNOWN) & (F.col("probability") > self.limit) & (F.col("shared") >= LEAST_SHARED)
        told = checked.where(sure | (F.col("about") > self.about))
        family, probability = F.when(sure, F.col("predicted")).otherwise(F.lit(UNKNOWN)), F.when(sure, F.col("probability")).otherwise(F.col("about"))
        return told.select("doc_id", family.alias("family"), probability.alias("probability"), "shared")


def scan_licences(docs: DataFrame) -> DataFrame:
    """One row for each document and licence family found in it: doc_id, licence, n_paragraphs, probability, shared.

    A paragraph has a family if the classifier's probability is above the calibrated limit, and it holds a name of the
    family, ``LEAST_SHARED`` of its word pairs stand in the family's texts, or it holds ``LEAST_HELD`` of the pairs of one
    of them. Of equally probable families the first by name counts. If it is about a licence but no family is confirmed, the licence is
    ``unknown``. Probability and shared are those of the document's best paragraph of the family.

    Every line of every whole text is classified. Null and empty texts, and documents without licences, have no row; a
    null doc_id is one document of that name, and rows that repeat an id are one document.
    """
    if docs.where("text is not null").isEmpty():
        return docs.sparkSession.createDataFrame([], "doc_id long, licence string, n_paragraphs long, probability double, shared double")
    found = Scanner(docs).scan(docs)
    best = F.max(F.struct("probability", "shared"))
    grouped = found.groupBy("doc_id", F.col("family").alias("licence")).agg(F.count(F.lit(1)).alias("n_paragraphs"), best.alias("best"))
    return grouped.select("doc_id", "licence", "n_paragraphs", "best.probability", "best.shared")
