"""Licence scans: a trained paragraph classifier, in DataFrame operations throughout.

A paragraph is a line, with the lines that a wrapped one goes on in.  Its text
is put in one form (years alike, versions as ``v3``), and a multinomial logistic
regression over word unigrams and bigrams (present or not) tells the family.  It
is fitted on the driver to the fixed notices below and to a bounded sample of
the corpus as the unknown class, less the paragraphs that a template confirms;
the unknown class is then calibrated on texts kept out of the fit, so that of
those no more than the share FALSE_SHARE is taken for any family.  A paragraph
can only be a licence if it holds one of the heaviest words, so many that each
known notice has one: a regular expression of these gates the corpus.  Distinct gated paragraphs are scored by a join with the weights, and a
prediction is confirmed by the share of a template's bigrams that it holds.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import cut, named

#: Fixed texts: notices and opening paragraphs of public licences.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        "SPDX-License-Identifier: Apache-2.0",
        "This project is released under the Apache 2.0 license.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "SPDX-License-Identifier: MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software',
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "Released under the GPL v3.",
    ],
    "GPL-2.0": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-2.0-only",
        "Licensed under the GNU General Public License, version 2.",
    ],
    "LGPL": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "Licensed under the GNU Lesser General Public License.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Released under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License.",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "CC0": [
        "This work is dedicated to the public domain under CC0 1.0 Universal.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License 2.0.",
    ],
    "proprietary": [
        "All rights reserved.",
        "Copyright 2024 Example Corp. All rights reserved.",
        "Copyright (c) 2024",
        "Copyright © 2024",
        "Copyright 2024",
        "© 2024",
        "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher.",
        "Proprietary and confidential. Unauthorized copying of this file, via any medium, is strictly prohibited.",
    ],
}
#: Further notices, as people write them: like TEMPLATES, they are fitted and confirm.
NOTICES = {
    "Apache-2.0": [
        "Apache License Version 2.0, January 2004", "This code is made available under the Apache License 2.0; see the LICENSE file.", "Distributed under the terms of the Apache License, version 2.", "Apache-2.0 licensed",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.", "Covered by the Apache 2.0 licence.",
    ],
    "MIT": [
        "The MIT License (MIT)", "This software is distributed under the terms of the MIT licence.", "MIT licensed, see LICENSE.txt for details.", "Available under the MIT license.", "The code is MIT-licensed.", "License: MIT",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    ],
    "GPL-3.0": [
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "Licensed under the GPLv3.", "Distributed under the GNU GPL version 3 or any later version.", "License: GPL-3.0", "This package is free software under the GNU GPL v3.", "Covered by the GNU General Public License v3.0.",
    ],
    "GPL-2.0": [
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991", "Licensed under the GPLv2.", "Distributed under the GNU GPL version 2 only.", "License: GPL-2.0", "Released under the GPL v2.", "Covered by the GNU General Public License v2.",
    ],
    "LGPL": [
        "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999", "Licensed under the LGPLv3.", "Distributed under the GNU LGPL version 2.1 or later.", "License: LGPL-3.0", "Released under the GNU Library General Public License.", "This library is covered by the LGPL.",
    ],
    "BSD": [
        "BSD 2-Clause License", "Licensed under the BSD license.", "Distributed under the 3-clause BSD licence, see COPYING.", "License: BSD-2-Clause", "This code is BSD licensed.", "The new BSD license applies.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    ],
    "CC-BY-NC": ["Creative Commons Attribution-NonCommercial 3.0 Unported", "This article is distributed under CC BY-NC.", "License: CC-BY-NC-4.0", "Available under the Creative Commons BY-NC 4.0 licence.", "Shared under a Creative Commons Non-Commercial license."],
    "CC-BY-SA": ["Creative Commons Attribution-ShareAlike 3.0 Unported", "This article is distributed under CC BY-SA.", "License: CC-BY-SA-4.0", "Available under the Creative Commons BY-SA 4.0 licence.", "Shared under a Creative Commons Share-Alike license."],
    "CC-BY": ["Creative Commons Attribution 3.0 Unported", "This article is distributed under CC BY.", "License: CC-BY-4.0", "This is an open access article under the terms of the Creative Commons Attribution License.", "Available under the Creative Commons BY 4.0 licence."],
    "CC0": ["CC0 1.0 Universal", "Released into the public domain under CC0.", "License: CC0-1.0", "To the public domain by way of the Creative Commons Zero waiver.", "Dedicated to the public domain with CC0."],
    "MPL-2.0": ["Mozilla Public License Version 2.0", "Distributed under the MPL 2.0.", "License: MPL-2.0", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "Released under the MPLv2.", "Covered by the Mozilla Public License."],
    "proprietary": [
        "All rights are reserved by the author.", "Copyright Some Firm Ltd., all rights reserved.", "This document contains confidential and proprietary information.", "Reproduction without permission is prohibited.",
        "No part of this work may be copied or distributed without written permission.", "Confidential - do not distribute.",
    ],
}
#: Fixed texts that speak of licences and permission without being one.
UNKNOWN = [
    "You need a driving licence to use this vehicle.", "The version of this file is under review.", "Use of the source is free.",
    "The general public may use this work.", "Software is available to any person.", "Released in version 3.", "The license plate was found.",
    "He works under the terms of the contract.", "A copy of the documentation is attached.", "The library is open to the public.", "Apache helicopters landed in the field.",
    "MIT is a university in Cambridge.", "Copyright law protects authors.", "Conditions are met.", "This program is on television.", "It is licensed and insured.",
    "It was founded in 1998.", "Section (c) was added in 2007.", "The software version was released.", "Commons are shared by all.", "The attribution of the painting is in doubt.", "A work without warranty of any kind.",
    "The Mozilla browser opened a page.", "He got his license in 2012.", "The library is free.", "The public domain is a field of law.", "The terms and conditions were discussed.", "She gave her permission.", "Rights and duties of citizens.",
    "The distribution of this species is wide.", "The firm distributed the software to all contributors.",
]
FAMILIES = [*TEMPLATES, "unknown"]
#: Corpus paragraphs used as unknown, half to fit and half to calibrate, and characters of the longest that is sampled.
SAMPLE, SAMPLE_CHARS = 2_000, 2_000
#: Share of the texts kept for calibration that may be taken for a licence.
FALSE_SHARE = 0.001
#: Share of the unknown paragraphs beyond which a word or pair is no feature.
COMMON = 0.005
ROUNDS, RATE, DECAY = 250, 4.0, 3e-4
#: Share of a template's bigrams (of the paragraph's, if that is shorter) that confirms a family.
CONFIRM = 0.5
#: Characters of the longest line that may go on in the next.
WRAPPED = 100
#: Parts into which the rows of one paragraph text are dealt when they meet its verdict.
SALT = 16
KNOWN = {f: [*TEMPLATES[f], *NOTICES[f]] for f in TEMPLATES}
_ALL = [t for texts in KNOWN.values() for t in texts]
_WORD = r"[a-z0-9]+(?:\.[0-9]+)*|©"
#: A word that is a year counts as this one, so that a notice of any year is like the template's.
_YEAR, YEAR = "(?:19|20)[0-9]{2}", "0000"
#: One form for what is written in several ways, on small letters, in order: ``GPLv3``, ``GPL version 3``, ``GPL-3.0``.
_FORMS = [
    ("licence", "license"), ("(?<=[a-z])v(?=[0-9])", " v"), (r"\bv(?:ersion|er)?\.?\s*(?=[0-9])", "v"), ("(?<=[a-z])-(?=[0-9])", " v"), (r"(?<=[0-9])\.0(?![0-9])", ""),
    (r"\b(?=(?:apache|gpl|lgpl|mpl|license) [0-9])(\w+) ", r"\1 v"),
]
_VERSION = re.compile(r"v?[0-9.]+")


def normal(text: str) -> str:
    text = text.lower()
    for pattern, new in _FORMS:
        text = re.sub(pattern, new, text, flags=re.ASCII)
    return text


def normal_column(text: Column) -> Column:
    """:func:`normal` as a column."""
    text = F.lower(text)
    for pattern, new in _FORMS:
        text = F.regexp_replace(text, pattern, new.replace("\\1", "$1"))
    return text


def words_of(text: str) -> list[str]:
    return [YEAR if re.fullmatch(_YEAR, w) else w for w in re.findall(_WORD, normal(text))]


def grams(text: str) -> set[str]:
    words = words_of(text)
    return {*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))}


def gram_columns(text: Column) -> tuple[Column, Column]:
    """Distinct unigrams and bigrams of a text, and its distinct bigrams (unigrams if it has one word)."""
    words = F.transform(F.regexp_extract_all(normal_column(text), F.lit(_WORD), F.lit(0)), lambda w: F.when(w.rlike(f"^{_YEAR}$"), YEAR).otherwise(w))
    pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    pairs = F.slice(pairs, 1, F.greatest(F.size(words) - 1, F.lit(0)))
    return F.array_distinct(F.concat(words, pairs)), F.array_distinct(F.when(F.size(words) > 1, pairs).otherwise(words))


def is_notice(text: str) -> bool:
    """Whether a template confirms a text: it holds the share CONFIRM of the template's bigrams, or of its own
    if those are fewer and two at least are the template's (a plain line of two words is no notice)."""
    own = _pairs(text)
    shared = [(len(own & k), len(k)) for k in map(_pairs, _ALL)]
    return any(n >= CONFIRM * k or n >= max(2, CONFIRM * len(own)) for n, k in shared)


def notice(text: Column) -> Column:
    """:func:`is_notice` as a column."""
    known = F.array(*(F.split(F.lit("|".join(sorted(_pairs(t)))), r"\|") for t in _ALL))

    def confirms(own: Column, template: Column) -> Column:
        n = F.size(F.array_intersect(own, template))
        return (n >= CONFIRM * F.size(template)) | (n >= F.greatest(F.lit(2.0), CONFIRM * F.size(own)))

    # the bigrams as a lambda's variable, so that they are worked out once
    return F.exists(F.array(gram_columns(text)[1]), lambda own: F.exists(known, lambda k: confirms(own, k)))


class Model:
    """``features`` (rows of ``weights``), the bias and the gate."""

    def __init__(self, features: list[str], weights: np.ndarray, bias: np.ndarray) -> None:
        self.features, self.weights, self.bias = features, weights, bias
        self.gate = self._gate()

    def _gate(self) -> str:
        """The heaviest words, as many as it takes for each known notice to hold one."""
        gain = np.maximum(self.weights[:, :-1] - self.weights[:, -1:], 0).max(1)
        words = sorted((w for w in self.features if " " not in w and w != YEAR), key=lambda w: (-gain[self.features.index(w)], w))
        open_texts, taken = [set(words_of(t)) for t in _ALL], []
        for w in words:
            if not open_texts:
                break
            if any(w in t for t in open_texts):
                taken.append(w)
                open_texts = [t for t in open_texts if w not in t]
        raw = {"license": "licen[cs]e"}
        return r"(?i)(?<![a-z0-9])(?:" + "|".join(raw.get(w, re.escape(w)) for w in sorted(taken)) + r")(?![a-uw-z0-9]|v(?![0-9]))"

    def family(self, text: str) -> str:
        """The family of a paragraph, or unknown."""
        return FAMILIES[int(self.scores([text])[0].argmax())] if re.search(self.gate, text) else FAMILIES[-1]

    def scores(self, texts: list[str]) -> np.ndarray:
        at = {f: k for k, f in enumerate(self.features)}
        x = np.zeros((len(texts), len(at)))
        for i, t in enumerate(texts):
            for g in grams(t) & at.keys():
                x[i, at[g]] = 1
        return x @ self.weights + self.bias


def train(unknown: list[str]) -> Model:
    """Fits the templates, their halves and the unknown texts; sorted order, so runs agree."""
    texts, labels = [], []
    for k, family in enumerate(KNOWN):
        for t in KNOWN[family]:
            words = t.split()
            parts = [t] + ([" ".join(words[: len(words) // 2]), " ".join(words[len(words) // 2 :])] if len(words) > 24 else [])
            texts += parts
            labels += [k] * len(parts)
    unknown = [t for t in unknown if not is_notice(t)]
    fit_half, check_half = unknown[::2], unknown[1::2]
    common = Counter(g for t in fit_half for g in grams(t))
    # words that plain text is full of tell nothing, and would have the gate let most paragraphs through
    # a version alone tells nothing
    features = sorted({g for t in texts for g in grams(t) if common[g] <= COMMON * len(fit_half) and not all(map(_VERSION.fullmatch, set(g.split()) - {YEAR})) or g == YEAR})
    at = {f: k for k, f in enumerate(features)}
    negative = UNKNOWN + fit_half
    texts += negative
    labels += [len(FAMILIES) - 1] * len(negative)
    # each class weighs the same; texts of the same features and class are one row of their joint weight
    size, joint = Counter(labels), {}
    for t, label in zip(texts, labels, strict=True):
        key = (label, *sorted(at[g] for g in grams(t) & at.keys()))
        joint[key] = joint.get(key, 0.0) + 1.0 / size[label] / len(size)
    x, y, each = np.zeros((len(joint), len(features))), np.zeros((len(joint), len(FAMILIES))), np.array(list(joint.values()))
    for i, (label, *own) in enumerate(joint):
        x[i, own], y[i, label] = 1, 1
    w, b = np.zeros((len(features), len(FAMILIES))), np.zeros(len(FAMILIES))
    for _ in range(ROUNDS):
        z = x @ w + b
        z -= z.max(1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(1, keepdims=True)
        g = (p - y) * each[:, None]
        w -= RATE * (x.T @ g + DECAY * w)
        b -= RATE * g.sum(0)
    # the unknown class against the others: of the texts kept out, all but the share allowed must fall to it
    z = Model(features, w, b).scores([*UNKNOWN, *check_half])
    held = np.sort((z[:, :-1] - z[:, -1:]).max(1))[::-1]
    b[-1] += held[int(FALSE_SHARE * len(held))] + 0.01
    return Model(features, w, b)


def _paragraphs(text: Column) -> Column:
    wrapped = rf"(?m)^([^\n]{{0,{WRAPPED - 1}}}[^\s.!?:;…])[ \t\r]*\n(?=[ \t]*\S)"
    return F.split(F.regexp_replace(F.coalesce(text, F.lit("")), wrapped, "$1 "), "\n")


def paragraphs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, paragraph (its number), text: lines, a short line without a sentence's end together with the next."""
    return docs.select(named(id_col).alias("doc_id"), F.posexplode(_paragraphs(named(text_col))).alias("paragraph", "text"))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    """The model, with a paragraph of each of the ``sample`` documents of smallest id hash as unknown, the one of
    smallest hash among those that do not speak of licences and that no template confirms.

    The driver gets ``sample`` paragraphs of SAMPLE_CHARS characters at most, whatever the corpus.
    """

    def plain(rows: DataFrame) -> DataFrame:
        speaks = "(?i)licen[cs]|copyright|permission|rights reserved|redistribut"
        fit_for = F.filter(_paragraphs(named(text_col)), lambda t: (F.length(t) <= SAMPLE_CHARS) & t.rlike(r"\S") & ~t.rlike(speaks))
        one = F.array_min(F.transform(fit_for, lambda t: F.struct(F.xxhash64(t).alias("h"), t.alias("t"))))["t"]
        own = rows.select(F.xxhash64(named(id_col)).alias("h"), one.alias("t")).where("t is not null")
        return own.where(~notice(F.col("t"))).orderBy("h", "t").limit(sample)

    # of the documents a part, twice as many as wanted, is looked at: else each partition sends ``sample`` rows to be merged
    share = 2 * sample / max(1, docs.count())
    rows = plain(docs.where(F.xxhash64(named(id_col)) <= int(share * 2**64) - 2**63)).collect() if share < 1 else []
    if len(rows) < sample:
        rows = plain(docs).collect()
    return train([r["t"] for r in rows])


def scan(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each paragraph taken for a licence: doc_id, paragraph, family, probability, containment, confirmed.

    Null and empty texts have no paragraphs of weight.  Repeated rows give
    repeated results; an empty table gives an empty result.  Only distinct gated
    paragraphs are scored, so a notice that a third of all documents carry is
    scored once; its rows meet the verdict as ids and digests, in SALT parts.
    """
    spark = docs.sparkSession
    gated = paragraphs(docs, id_col, text_col).where(F.col("text").rlike(model.gate)).withColumn("key", F.unhex(F.md5("text")))
    gated = cut(gated, "gated")
    n = len(FAMILIES)
    # the weights: a few thousand rows, fixed by the notices
    table = spark.createDataFrame([(f, [float(v) for v in model.weights[k]]) for k, f in enumerate(model.features)], "gram string, w array<double>")
    distinct = cut(gated.groupBy("key").agg(F.first("text").alias("text")), "paragraphs")
    hits = distinct.select("key", F.explode(gram_columns(F.col("text"))[0]).alias("gram")).join(F.broadcast(table), "gram")
    sums = hits.groupBy("key").agg(*(F.sum(F.col("w")[k]).alias(f"z{k}") for k in range(n)))
    z = F.array(*(F.col(f"z{k}") + F.lit(float(model.bias[k])) for k in range(n)))
    scored = sums.select("key", z.alias("z")).withColumn("top", F.array_max("z")).withColumn("k", F.array_position("z", F.col("top")).cast("int"))
    scored = scored.where(F.col("k") < n).withColumn("probability", F.lit(1.0) / F.aggregate("z", F.lit(0.0), lambda a, v: a + F.exp(v - F.col("top"))))
    known = [(k + 1, f, sorted(_pairs(t))) for k, f in enumerate(KNOWN) for t in KNOWN[f]]
    templates = spark.createDataFrame(known, "tk int, family string, known array<string>")
    own = scored.select("key", "k", "probability").join(distinct, "key").select("key", "k", "probability", gram_columns(F.col("text"))[1].alias("own"))
    held = own.join(F.broadcast(templates), F.col("k") == F.col("tk"))
    share = F.size(F.array_intersect("own", "known")) / F.greatest(F.lit(1), F.least(F.size("own"), F.size("known")))
    verdict = cut(held.groupBy("key").agg(F.first("family").alias("family"), F.first("probability").alias("probability"), F.max(share).alias("containment")), "verdicts")
    dealt = gated.select("doc_id", "paragraph", "key", F.pmod(F.xxhash64("doc_id", "paragraph"), F.lit(SALT)).cast("int").alias("part"))
    salted = verdict.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    out = dealt.join(salted, ["key", "part"])
    return out.select("doc_id", F.col("paragraph").cast("int").alias("paragraph"), "family", "probability", "containment", (F.col("containment") >= CONFIRM).alias("confirmed"))


def _pairs(text: str) -> set[str]:
    words = words_of(text)
    return {f"{a} {b}" for a, b in zip(words, words[1:], strict=False)} or set(words)
