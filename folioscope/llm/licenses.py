"""Licence scans: a trained paragraph classifier, in DataFrame and MLlib functions only.

Paragraphs are blocks between blank lines, with comment marks and line breaks taken out, and
beside them each of their lines alone.  They are classified by multinomial logistic regression
on hashed word 1- and 2-grams, fitted here on notices of each licence family in several wordings
and on ordinary paragraphs as the class ``unknown``: written ones below, and the background, which is every candidate of
every document whose block does not hold ``NEAR`` of a template.  Examples of the same words count once; where the background is more than
the notices, its examples share the weight of as many, so that the balance of the classes does not depend on the size of the table.
The probability that a family needs is calibrated on the whole background as well, by two fits that each leave out half of it and judge
that half: the ``QUANTILE`` of all these, so that a few notices among them don't matter, and ``LEAST`` at least.  A predicted family counts once a
comparison with its templates confirms it: one template must have ``COVERED`` of its
word 2-grams in the paragraph (SPDX tags: all), or the paragraph is a heading or a manifest's licence field and no more.
Amid a block a heading must be written as one, with capitals.  Creative Commons families must
have all of their marks (NC, SA, ND) and no others.  A paragraph has one family: of two
licences offered in one paragraph the likelier is told.
A block counts if no line of it alone is a notice of the same family.

All text is scanned, once: fit and scan read the same table of candidates.  Candidates are the paragraphs that hold a word 2-gram
of a template or heading with one of ``ANCHORS`` in it (``SIGNS``) or begin as a licence field: more than
1 - ``COVERED`` of each template's 2-grams hold an anchor, so nothing could confirm a family elsewhere.

Defined cases: null or empty text has no paragraphs and no licence; a paragraph without
words is none; of an empty table the result is empty.  Rows are judged by their own text,
also if they repeat a ``doc_id``.  No other column than doc_id and text is read.
"""

from __future__ import annotations

import functools
import operator

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

FEATURES, LEAST, COVERED, NEAR = 1 << 14, 0.5, 0.7, 0.5
#: The share of the background, each paragraph left out of the fit that judges it, that stays below the probability a family needs.
QUANTILE = 0.995
UNKNOWN = "unknown"

#: Short notices by licence family, as licensors write them.
TEMPLATES = {
    "AGPL": ["licensed under the gnu affero general public license", "under the terms of the gnu affero general public license as published by the free software foundation"],
    "Apache-2.0": ["licensed under the apache license version 2.0", "you may not use this file except in compliance with the license", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "apache 2.0 license", "licensed under either of apache license version 2.0 or mit license at your option"],
    "BSD": ["licensed under the bsd license", "released under the bsd 3 clause license", "licensed under the bsd 2 clause license", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products"],
    "CC-BY": ["licensed under cc by 4.0", "licensed under a creative commons attribution 4.0 international license"],
    "Boost": ["distributed under the boost software license version 1.0", "licensed under the boost software license"],
    "CC-BY-NC": ["licensed under cc by nc 4.0", "licensed under a creative commons attribution noncommercial 4.0 international license"],
    "CC-BY-NC-ND": ["licensed under cc by nc nd 4.0", "licensed under a creative commons attribution noncommercial noderivatives 4.0 international license"],
    "CC-BY-NC-SA": ["licensed under cc by nc sa 4.0", "licensed under a creative commons attribution noncommercial sharealike 4.0 international license"],
    "CC-BY-ND": ["licensed under cc by nd 4.0", "licensed under a creative commons attribution noderivatives 4.0 international license"],
    "CC-BY-SA": ["licensed under cc by sa 4.0", "licensed under a creative commons attribution sharealike 4.0 international license", "available under the creative commons attribution sharealike license"],
    "CC0": ["released under cc0 1.0 universal", "dedicated to the public domain under cc0", "to the extent possible under law the author has waived all copyright and related rights"],
    "EPL": ["made available under the terms of the eclipse public license"],
    "GPL": ["licensed under the gnu general public license version 3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "released under the gpl", "licensed under gpl v2"],
    "ISC": ["licensed under the isc license", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"],
    "LGPL": ["licensed under the gnu lesser general public license", "under the terms of the gnu lesser general public license as published by the free software foundation"],
    "MIT": ["released under the mit license", "licensed under the mit license", "is mit licensed", "permission is hereby granted free of charge to any person obtaining a copy of this software", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "MPL-2.0": ["this source code form is subject to the terms of the mozilla public license", "licensed under the mozilla public license version 2.0"],
    "Proprietary": ["all rights reserved", "no part of this publication may be reproduced without prior written permission"],
    "Unlicense": ["this is free and unencumbered software released into the public domain"],
    "WTFPL": ["licensed under the wtfpl", "do what the fuck you want to public license"],
    "Zlib": ["licensed under the zlib license", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"],
}

#: SPDX identifiers as words; longer identifiers may begin like them (-only, -or-later).
SPDX = {
    "AGPL": ["agpl"], "Apache-2.0": ["apache 2.0"], "BSD": ["bsd", "0bsd"], "CC-BY": ["cc by 4.0", "cc by 3.0"], "CC-BY-NC": ["cc by nc 4.0", "cc by nc 3.0"], "CC-BY-NC-ND": ["cc by nc nd 4.0", "cc by nc nd 3.0"], "CC-BY-NC-SA": ["cc by nc sa 4.0", "cc by nc sa 3.0"], "CC-BY-ND": ["cc by nd 4.0", "cc by nd 3.0"],
    "CC-BY-SA": ["cc by sa 4.0", "cc by sa 3.0"], "Boost": ["bsl 1.0"], "CC0": ["cc0 1.0"], "EPL": ["epl"],
    "GPL": ["gpl"], "ISC": ["isc"], "LGPL": ["lgpl"], "MIT": ["mit"], "MPL-2.0": ["mpl 2.0"], "Unlicense": ["unlicense"], "WTFPL": ["wtfpl"], "Zlib": ["zlib"],
}
TEMPLATES = {f: [*ts, *(f"spdx license identifier {x}" for x in SPDX.get(f, []))] for f, ts in TEMPLATES.items()}

#: Paragraphs of these words and no others.
HEADINGS = {
    "AGPL": ["gnu affero general public license", "gnu affero general public license version 3"], "Apache-2.0": ["apache license version 2.0", "apache license 2.0"], "BSD": ["bsd license", "bsd 2 clause license", "bsd 3 clause license"],
    "CC-BY": ["creative commons attribution 4.0 international"], "CC-BY-NC": ["creative commons attribution noncommercial 4.0 international"], "CC-BY-SA": ["creative commons attribution sharealike 4.0 international"], "CC0": ["cc0 1.0 universal"], "EPL": ["eclipse public license"],
    "GPL": ["gnu general public license", "gnu general public license version 2", "gnu general public license version 3"], "ISC": ["isc license"], "LGPL": ["gnu lesser general public license", "gnu lesser general public license version 3"], "MIT": ["mit license", "mit license mit"], "MPL-2.0": ["mozilla public license version 2.0"],
    "Boost": ["boost software license version 1.0", "boost software license"], "Zlib": ["zlib license"], "CC-BY-NC-SA": ["creative commons attribution noncommercial sharealike 4.0 international"],
    "CC-BY-NC-ND": ["creative commons attribution noncommercial noderivatives 4.0 international"], "CC-BY-ND": ["creative commons attribution noderivatives 4.0 international"],
}
HEADINGS = {f: [w for t in ts for w in (t, f"the {t}")] for f, ts in HEADINGS.items()}

#: Names that a licence field of a manifest gives, beside the identifiers.
FIELDS = {
    "AGPL": ["gnu affero general public license"], "Apache-2.0": ["apache license 2.0", "apache license version 2.0", "apache software license"], "BSD": ["bsd license", "bsd 2 clause", "bsd 3 clause"], "Boost": ["boost software license"], "CC0": ["cc0"],
    "EPL": ["eclipse public license"], "GPL": ["gnu general public license"], "ISC": ["isc license"], "LGPL": ["gnu lesser general public license"], "MIT": ["mit license"], "MPL-2.0": ["mozilla public license 2.0"], "Unlicense": ["the unlicense"],
}
FIELDS = {f: [*SPDX[f], *FIELDS.get(f, [])] for f in SPDX}
#: What shows a line to be such a field, and its words by family; versions may follow.
FIELD = r"(?i)^[^\p{L}]*licen[sc]e[\"']?[ \t]*(?:::?|=)"
FIELD_WORDS = {f: r"^licen[sc]e (?:osi approved )?(?:the )?(?:" + "|".join(sorted(ns, reverse=True)).replace(".", r"\.") + r")(?: ?v?[0-9]+(?:\.[0-9]+)*)?(?: only| or later| or newer)?(?: license)?(?: [al]?gplv[0-9]\S*)?$" for f, ns in FIELDS.items()}
#: Lines amid a block are headings if no word but these begins with a small letter.
SMALL = r"(?:^|[^\p{L}0-9.])(?!version\b|of\b|and\b)\p{Ll}"
#: What tells the Creative Commons licences apart: each family's marks and no others.
MARKED = {"NC": r"\b(?:by nc|non ?commercial)\b", "SA": r"\b(?:by sa|nc sa|share ?alike)\b", "ND": r"\b(?:by nd|nc nd|no ?deriv\w*)\b"}
#: "All rights reserved" is a notice at the end of a sentence or beside a copyright mark.
RESERVED = r"(?i)all rights reserved[^\p{L}0-9]*$|all rights reserved[.;!]|copyright|\(c\)|\x{A9}"

#: Parts of words, in lower case, that no notice is without.
ANCHORS = (
    "licen", "under", "software", "redistribut", "permi", "public", "reserved", "contributors", "copyright", "applicable", "distribut", "waived", "gpl", "gnu", "foundation", "unencumbered", "creative", "commons", "attribution",
    "compliance", "except", "names", "source", "binary", "conditions", "endorse", "extent", "related", "rights", "cc0", "eclipse", "purpose", "granted", "charge", "obtaining", "substantial", "written", "notice", "altered", "plainly", "misrepresent", "fuck", "identifier",
)

#: Marks that begin and end lines of comments.
MARKS, CLOSING = r"(?m)^[ \t]*(?:/\*+|\*+/|\*+|//+!?|#+|;+|--+|%+|<!--+|>+|(?:rem|REM|dnl)\b)(?=[ \t\r]|$)[ \t]*", r"(?m)[ \t]*(?:\*+/|--+>)[ \t\r]*$"

#: Wordings around a notice for training.
AROUND = ["{}", "{}.", "this work is {}", "this project is {}", "the code is {}.", "{} see license for details", "copyright 2020 the authors {}", "this document is {}", "{} all contributions are welcome"]

IN_FIELDS = ["license {}", "license osi approved {}", "license {} or later"]

#: Ordinary paragraphs that share words with notices.
ORDINARY = [
    "the driver has a license to drive in this state", "she lost her fishing license last year", "the general public was invited to the version premiere", "the work is done and all is well",
    "this work is published weekly", "the terms of the agreement were read aloud", "the software was distributed to all schools", "he was licensed as a pilot under the old rules", "free of charge to any person over sixty",
    "the creative team has many common interests", "the apache helicopter landed", "a public hearing on the foundation of the bridge", "rights and duties of members", "all seats are reserved for guests",
    "copyright law is taught in the second year", "see the notice above the door", "the eclipse was visible to the public", "mit students won the prize", "a mozilla developer wrote to us", "lesser known general stories",
    "all rights reserved seats were sold before noon", "the license of the bar was renewed", "we chose the license as it is short",
]


def _template_pairs(text: str) -> list[str]:
    w = text.replace("-", " ").split()
    return [a + " " + b for a, b in zip(w, w[1:], strict=False)] or w


#: All word 2-grams of templates and headings, and those that hold an anchor.
PAIRS = sorted({p for ts in [*TEMPLATES.values(), *HEADINGS.values()] for t in ts for p in _template_pairs(t)})
SIGNS = [p for p in PAIRS if any(a in p for a in ANCHORS)]


def grams(col):
    """Words of letters, digits and dots within."""
    words = F.filter(F.split(F.regexp_replace(F.lower(col), r"\.(?![0-9])", " "), r"[\x00-\x2D\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")
    return words


def _neighbours(w):
    """Pairs of neighbours among words."""
    n = F.greatest(F.size(w) - 1, F.lit(0))
    return F.zip_with(F.slice(w, 1, n), F.slice(w, 2, n), lambda a, b: F.concat(a, F.lit(" "), b))


def with_grams(df: DataFrame) -> DataFrame:
    """Adds ``grams`` (1- and 2-grams), ``pairs`` (2-grams) and ``words`` (joined) of ``paragraph``."""
    df = df.withColumn("_w", grams(F.col("paragraph"))).withColumn("pairs", _neighbours(F.col("_w")))
    return df.withColumn("grams", F.concat("_w", "pairs")).withColumn("words", F.array_join("_w", " ")).drop("_w")


def anchored(col):
    """Whether a text holds an anchor; it is lowered once."""
    return F.exists(F.array(F.lower(col)), lambda x: functools.reduce(operator.or_, [x.contains(a) for a in ANCHORS]))


def blocks(docs: DataFrame) -> DataFrame:
    """doc_id, mark (of the text), block (its place in the text) and its lines, for each block between blank lines."""
    text = F.coalesce(F.col("text"), F.lit(""))
    clean = F.regexp_replace(F.regexp_replace(text, CLOSING, ""), MARKS, "")
    split = docs.select("doc_id", F.xxhash64("text").alias("mark"), F.posexplode(F.split(clean, r"\n[\x00-\x20]*\n")).alias("block", "_b"))
    lines = F.filter(F.split("_b", "\n"), lambda x: x.rlike(r"[^\x00-\x20]"))
    return split.select("doc_id", "mark", "block", lines.alias("lines")).filter(F.size("lines") > 0)


def paragraphs(found: DataFrame) -> DataFrame:
    """Of each block its lines (``at`` from 0) and, if they are several, the whole (``at`` -1): all columns but lines, at, paragraph."""
    whole = F.when(F.size("lines") > 1, F.array(F.struct(F.lit(-1).alias("at"), F.array_join("lines", " ").alias("paragraph")))).otherwise(F.expr("array()"))
    each = F.transform("lines", lambda x, i: F.struct(i.alias("at"), x.alias("paragraph")))
    return found.withColumn("_p", F.explode(F.concat(each, whole))).select(*[c for c in found.columns if c != "lines"], "_p.at", "_p.paragraph")


def _written_rows(spark: SparkSession) -> DataFrame:
    """Training rows of the notices and the ordinary paragraphs: label and paragraph."""
    names = [UNKNOWN, *sorted(TEMPLATES)]
    notices = F.array(*[F.struct(F.lit(names.index(f)).alias("label"), F.lit(a.format(t)).alias("paragraph")) for f, ts in TEMPLATES.items() for t in ts for a in AROUND],
        *[F.struct(F.lit(names.index(f)).alias("label"), F.lit(a.format(t)).alias("paragraph")) for f, ts in HEADINGS.items() for t in ts for a in AROUND],
        *[F.struct(F.lit(names.index(f)).alias("label"), F.lit(a.format(t)).alias("paragraph")) for f, ts in FIELDS.items() for t in ts for a in IN_FIELDS])
    plain = F.array(*[F.struct(F.lit(0).alias("label"), F.lit(t).alias("paragraph")) for t in ORDINARY])
    return spark.range(1, numPartitions=1).select(F.explode(F.concat(notices, plain)).alias("r")).select("r.label", "r.paragraph")


def hashed(df: DataFrame) -> DataFrame:
    return HashingTF(numFeatures=FEATURES, binary=True, inputCol="grams", outputCol="features").transform(with_grams(df))


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, mark, block, near (whether the block holds NEAR of a template), at and paragraph of each paragraph that a family could be confirmed for."""
    whole = F.array_join("lines", " ")
    found = blocks(docs.filter(anchored(F.col("text")))).filter(anchored(whole))
    # in arrays of one, so that words are made once for test and result
    judged = F.transform(F.transform(F.array(whole), lambda p: F.struct(p.alias("paragraph"), grams(p).alias("w"))), lambda s: F.struct(s["paragraph"].alias("paragraph"), F.array_join(s["w"], " ").alias("words"), F.filter(_neighbours(s["w"]), lambda x: x.isin(PAIRS)).alias("pairs")))
    found = found.withColumn("_s", F.explode(F.filter(judged, lambda s: F.exists(s["pairs"], lambda x: x.isin(SIGNS)) | F.exists("lines", lambda x: x.rlike(FIELD)))))
    found = found.select("doc_id", "mark", "block", "lines", "_s.*").withColumn("heading", F.lit(True))
    found = found.select("doc_id", "mark", "block", (F.greatest(*[_share(f) for f in TEMPLATES]) >= NEAR).alias("near"), "lines")
    sign = F.exists(_neighbours(grams(F.col("paragraph"))), lambda x: x.isin(SIGNS))
    return paragraphs(found).filter(anchored(F.col("paragraph"))).filter(sign | F.col("paragraph").rlike(FIELD))


def background(found: DataFrame) -> DataFrame:
    """paragraph (its words) and fold (0 or 1) of all candidates in blocks that are not near a notice; the same words once."""
    words = with_grams(found.filter(~F.col("near"))).select(F.col("words").alias("paragraph")).distinct()
    return words.withColumn("fold", F.pmod(F.xxhash64("paragraph"), F.lit(2)).cast("int"))


def _share(family: str):
    """The largest share of a template of the family that ``pairs`` holds; 1 for its headings and fields."""
    heading = F.col("heading") & F.col("words").isin(HEADINGS.get(family, []))
    if family in FIELD_WORDS:
        heading = heading | F.col("paragraph").rlike(FIELD) & F.col("words").rlike(FIELD_WORDS[family])
    best = F.when(heading, 1.0).otherwise(0.0)
    for t in TEMPLATES[family]:
        pairs = sorted(set(_template_pairs(t)))
        share = F.size(F.array_intersect("pairs", F.array(*map(F.lit, pairs)))) / F.lit(float(len(pairs)))
        if t == "all rights reserved":
            share = F.when(F.col("paragraph").rlike(RESERVED), share).otherwise(0.0)
        best = F.greatest(best, F.when(share == 1.0, share).otherwise(0.0) if t.startswith("spdx ") else share)
    if family.startswith("CC-BY"):
        for mark, pattern in MARKED.items():
            best = F.when(F.col("words").rlike(pattern) == F.lit(mark in family.split("-")), best).otherwise(0.0)
    return best


def _fitted(rows: DataFrame) -> LogisticRegressionModel:
    """The classifier of label and features; the background, whose label is null, weighs as much as the notices at most."""
    n = rows.agg(F.count_if(F.col("label") > 0).alias("notices"), F.count_if(F.col("label").isNull()).alias("rest")).first()
    weight = F.when(F.col("label").isNull(), min(1.0, n["notices"] / max(n["rest"], 1))).otherwise(1.0)
    rows = rows.select(F.coalesce("label", F.lit(0.0)).alias("label"), weight.alias("weight"), "features")
    return LogisticRegression(maxIter=40, regParam=0.002, family="multinomial", aggregationDepth=2, weightCol="weight").fit(rows).setProbabilityCol("probability")


def fit_on(found: DataFrame) -> tuple[LogisticRegressionModel, float]:
    """The classifier and the least probability of a family, from a table of candidates."""
    spark = found.sparkSession
    every = _written_rows(spark).select(F.col("label").cast("double").alias("label"), "paragraph", F.lit(None).cast("int").alias("fold"))
    every = every.union(background(found).select(F.lit(None).cast("double"), "paragraph", "fold"))
    rows = written(hashed(every).select("label", "fold", "features"), "license-training")
    model, left = _fitted(rows), rows.filter("fold is not null")
    if left.isEmpty():
        return model, LEAST
    best, judged = F.array_max(F.slice(vector_to_array("probability"), 2, len(TEMPLATES))), []
    for fold in (0, 1):
        half = _fitted(rows.filter(F.col("fold").isNull() | (F.col("fold") != fold)))
        judged.append(half.transform(left.filter(F.col("fold") == fold)).select(best.alias("p")))
    # steps of 1e-4, so that the values to be counted are few
    least = judged[0].union(judged[1]).agg(F.percentile(F.ceil(F.col("p") * 10000) / 10000, F.lit(QUANTILE)).alias("p")).first()["p"]
    return model, max(LEAST, least)


def fit(docs: DataFrame) -> tuple[LogisticRegressionModel, float]:
    """The classifier and the least probability of a family, from all documents."""
    return fit_on(written(candidates(docs), "license-candidates"))


def confirmed(family) -> object:
    """The largest share of a template of the predicted family that ``pairs`` holds."""
    best = F.lit(0.0)
    for name in TEMPLATES:
        best = F.when(family == name, _share(name)).otherwise(best)
    return best


def scan(docs: DataFrame, model: LogisticRegressionModel | None = None, least: float = LEAST) -> DataFrame:
    """doc_id, mark, block, at, family, probability and covered of each paragraph that is a licence notice."""
    some = candidates(docs)
    if model is None:
        some = written(some, "license-candidates")
        model, least = fit_on(some)
    names = [UNKNOWN, *sorted(TEMPLATES)]
    found = model.transform(hashed(some)).withColumn("p", vector_to_array("probability"))
    found = found.withColumn("best", F.expr(f"array_max(slice(p, 2, {len(TEMPLATES)}))")).filter(F.col("best") >= least)
    family = F.element_at(F.array(*map(F.lit, names)), F.expr("cast(array_position(p, best) as int)"))
    found = found.withColumn("heading", (F.col("at") <= 0) | ~F.col("paragraph").rlike(SMALL))
    found = found.withColumn("family", family).withColumn("covered", confirmed(F.col("family")))
    return found.filter(F.col("covered") >= COVERED).select("doc_id", "mark", "block", "at", "family", F.col("best").alias("probability"), "covered")


def op8_licenses(spark, sf_dir):
    """Per document: the number of its licence notices and their families, joined by commas."""
    docs = table(spark, sf_dir, "documents")
    lines = F.count_if(F.col("at") >= 0)
    # equal rows find the same places
    found = scan(docs).dropDuplicates(["doc_id", "mark", "block", "at"])
    found = found.groupBy("doc_id", "mark", "block", "family").agg(F.when(lines > 0, lines).otherwise(F.count("*")).alias("n"))
    found = found.groupBy(F.col("doc_id").alias("_d"), F.col("mark").alias("_m")).agg(F.sum("n").alias("n"), F.array_join(F.array_sort(F.collect_set("family")), ",").alias("f"))
    own = docs.select("doc_id", F.xxhash64("text").alias("mark"))
    joined = own.join(found, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("mark") == F.col("_m")), "left")
    return joined.select("doc_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_notices"), F.coalesce("f", F.lit("")).alias("families"), F.col("n").isNotNull().alias("licensed"))
