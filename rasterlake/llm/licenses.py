"""Licence scans: a trained paragraph classifier, confirmed by comparison with templates.

Paragraphs are the lines of a text, the blocks of lines between lines without words (so that a
wrapped notice is seen whole), and windows of ``WINDOW`` words, each half over the last, of lines
and blocks that are longer. Words are runs of letters and digits, whatever stands between
them, so ``GPL-3.0-or-later`` is five. Features are all runs of one to three words that occur
often enough in the notices of training. A multinomial logistic regression, kept sparse by a penalty on the
size of its weights, gives the family, or ``unknown``. It is trained here, on variations of the
templates below (words left out or added, lines wrapped) and on paragraphs that name no known
licence: made-up sentences about the same words, notices of other licences, mixes of words (for training only), and
a bounded sample of corpus lines (about ``SAMPLE`` of them, whole) that share little with any template. No
other rule comes before it: a paragraph is let go only if it has no feature of non-zero weight.

Probabilities are calibrated on paragraphs that training did not see, among them notices of
licences of which training saw none: a temperature by likelihood, then the least probability
at which at most ``FALSE_RATE`` of the paragraphs without a notice, and ``UNSEEN_RATE`` of the
unseen notices, are given a family; below it, a paragraph is unknown. A prediction is confirmed if the paragraph holds ``SIMILAR`` of
the runs of two words of one of the family's templates.

A line that is given a family is a row. A block or window with a family stands in place of the lines
in it that have the same family, if none of them is confirmed and it is at least as similar;
of a block's windows with one family the most similar, then the first, counts.

Defined cases: null and empty texts have no paragraph; an unconfirmed prediction is reported
as such; rows that repeat a document are each scanned; with no sample (an empty table) the
model learns from the rest; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterlake.llm import common, text

#: Public notices, by family (fixed values).
TEMPLATES = {
    "apache": ["Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "Licensed under the Apache License, Version 2.0.", "This project is released under the Apache 2.0 license.", "Apache License Version 2.0, January 2004"],
    "mit": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "Released under the MIT License.", "Licensed under the MIT license.", "The MIT License (MIT)", "MIT licensed"],
    "gpl": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.", "This work is licensed under the GNU General Public License, version 3.", "Licensed under the GPL, version 2 or later.", "Distributed under the terms of the GNU GPL v3.", "Released under the GPLv3.", "Licensed under GPLv2.", "Licensed under GPLv3.", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "lgpl": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.", "This library is licensed under the GNU Lesser General Public License, version 2.1.", "Licensed under the LGPL, version 3.", "Released under the LGPLv3.", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "agpl": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.", "This work is licensed under the GNU Affero General Public License, version 3.", "Licensed under the AGPL, version 3.", "Released under the AGPLv3.", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", "Released under the BSD 3-Clause License.", "Licensed under the BSD license.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", "Licensed under the Mozilla Public License 2.0.", "Mozilla Public License Version 2.0", "Released under the MPL 2.0."],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "Released under the ISC License.", "Licensed under the ISC license."],
    "boost": ["Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)", "Licensed under the Boost Software License 1.0.", "Boost Software License - Version 1.0 - August 17th, 2003"],
    "epl": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0 which accompanies this distribution.", "Licensed under the Eclipse Public License, version 2.0.", "Released under the EPL 2.0.", "Eclipse Public License - v 2.0"],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0.", "Available under the CC-BY license."],
    "cc-by-sa": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0.", "Text is available under the Creative Commons Attribution-ShareAlike License."],
    "cc-by-nc": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0."],
    "cc-by-nd": ["This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "Licensed under CC BY-ND 4.0."],
    "cc0": ["Released under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "Dedicated to the public domain under CC0 1.0 Universal."],
    "unlicense": ["This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", "Released under the Unlicense."],
    "proprietary": ["All rights reserved.", "Copyright 2020 Example Inc. All rights reserved.", "This document is proprietary and confidential; no license is granted.", "Unauthorized copying of this file, via any medium, is strictly prohibited."],
}
#: Public short identifiers, by family (fixed values).
IDENTIFIERS = {
    "apache": ["Apache-2.0"], "mit": ["MIT"], "gpl": ["GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "GPL-3.0"], "lgpl": ["LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-or-later", "LGPL-2.1"], "agpl": ["AGPL-3.0-only", "AGPL-3.0-or-later"],
    "bsd": ["BSD-2-Clause", "BSD-3-Clause"], "mpl": ["MPL-2.0"], "isc": ["ISC"], "boost": ["BSL-1.0"], "epl": ["EPL-1.0", "EPL-2.0"], "cc-by": ["CC-BY-4.0"], "cc-by-sa": ["CC-BY-SA-4.0"], "cc-by-nc": ["CC-BY-NC-4.0"], "cc-by-nd": ["CC-BY-ND-4.0"], "cc0": ["CC0-1.0"], "unlicense": ["Unlicense"],
}
#: Paragraphs on the same words that grant nothing.
OTHER = ["The driver lost her license after the accident.", "A fishing license costs ten dollars.", "She holds a pilot license and a copyright on two songs.", "The apache helicopter landed near the village.", "The commons were open to all creative people.", "The hotel reserved a room for us.", "All seats are reserved for members.", "The warranty covers two years of use.", "He studied at MIT before he got his license to teach.", "The court ruled on the copyright claim.", "They asked for permission to use the hall.", "Public transport requires a license plate on each bus.", "Human rights are reserved for no one.", "The gnu is an antelope of the plains.", "A licensed electrician must do the work.", "General public health is under review, version two of the plan.", "The software runs without restriction on any person's computer.", "Please include the following conditions in the contract.", "The source of the river is free of charge to visit.", "Copies of the letter were distributed in binary pairs.", "This program is on television at eight.", "An eclipse of the moon is public and free.", "We need a boost of software sales.", "The work is in the public library.", "See the file for more details of the program.", "The author wrote the documentation and other materials."]
#: Notices of licences that are no family: for training, and (kept from training) for calibration.
FOREIGN = ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. zlib License", "Licensed under the Artistic License 2.0.", "Do What The Fuck You Want To Public License, Version 2", "Licensed under the Open Software License version 3.0", "This software is licensed under the Academic Free License", "SPDX-License-Identifier: Zlib", "SPDX-License-Identifier: OSL-3.0", "Licensed under the PostgreSQL License.", "The contents of this file are subject to the Netscape Public License."]
UNSEEN = ["The contents of this file are subject to the terms of the Common Development and Distribution License (CDDL).", "Licensed under the EUPL, Version 1.2 or subsequent versions of the European Union Public Licence.", "Licensed under the SIL Open Font License, Version 1.1.", "Licensed under the Python Software Foundation License Version 2.", "Licensed under the Ruby license.", "SPDX-License-Identifier: OFL-1.1", "SPDX-License-Identifier: CDDL-1.0", "Licensed under the Microsoft Public License (Ms-PL)."]
FILLER = "please note file project the this of our code see text is and for more by authors 2019 2024 contributors example version or any in to under public free copy software source with terms general work".split()
UNKNOWN, SAMPLE, COPIES, FALSE_RATE, UNSEEN_RATE, SIMILAR = "unknown", 2000, 20, 0.01, 0.2, 0.6
WINDOW, LONGEST, SEEN, STEPS, PENALTY = 240, 3, 4, 120, 2e-5


def runs(h: np.ndarray, unit: np.ndarray, words: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Units and hashes of all runs of one to LONGEST words within a unit; with ``words``, of those that are made of these only."""
    ok = np.ones(len(h), dtype=bool)
    if words is not None:
        ok = words[np.minimum(np.searchsorted(words, h), len(words) - 1)] == h if len(words) else ~ok
    units, hashes = [], []
    for n in range(1, LONGEST + 1):
        if n > 1:
            ok = ok[:-1] & ok0[n - 1 :]
        else:
            ok0 = ok
        at = np.flatnonzero(ok)
        at = at[unit[at] == unit[at + n - 1]]
        g = np.zeros(len(at), dtype=np.uint64)
        for j in range(n):
            g += h[at + j] * text._PLACE[j]
        units.append(unit[at])
        hashes.append(text.mix(g + np.uint64(n)))
    return np.concatenate(units), np.concatenate(hashes)


def _pairs(h: np.ndarray) -> np.ndarray:
    return text.distinct(text.kmers(h, 2) if len(h) > 1 else h)


def _hashed(lines: list[str]) -> list[np.ndarray]:
    h, first = text.plain_words(pa.array(lines, pa.string()))
    return [h[a:z] for a, z in zip(first[:-1], first[1:])]


_TEMPLATES = {f: ts + [f"SPDX-License-Identifier: {i}" for i in IDENTIFIERS.get(f, [])] + [i for i in IDENTIFIERS.get(f, []) if "-" in i] for f, ts in TEMPLATES.items()}
_COMPARED = {f: [_pairs(h) for h in _hashed(ts)] for f, ts in _TEMPLATES.items()}


def similarity(h: np.ndarray, family: str) -> float:
    """The largest share of a template's runs of two words that a paragraph (hashes of its words) holds."""
    own = _pairs(h)
    return max(float(np.isin(t, own).mean()) for t in _COMPARED[family])


class Model:
    """``grams``: sorted hashes of features with weights; ``words``: of the words that they are made of."""

    def __init__(self, lines: list[str], seed: int = 5):
        r = random.Random(seed)

        def vary(t: str) -> str:
            w = t.split()
            if len(w) > 8 and r.random() < 0.3:  # a line of a wrapped notice
                a = r.randrange(len(w) // 2)
                w = w[a : a + max(6, len(w) // 2)]
            if len(w) > 6 and r.random() < 0.3:
                del w[r.randrange(len(w))]
            if r.random() < 0.5:
                w = [r.choice(FILLER) for _ in range(r.randrange(1, 9))] + w
            if r.random() < 0.5:
                w += [r.choice(FILLER) for _ in range(r.randrange(1, 9))]
            return " ".join(w)

        self.families = [UNKNOWN, *_TEMPLATES]
        rows = [(vary(t) if c else t, k) for k, f in enumerate(self.families) if k for t in _TEMPLATES[f] for c in range(COPIES)]
        rows += [(vary(t) if c else t, 0) for t in OTHER + FOREIGN for c in range(COPIES)]
        every = text.distinct(np.concatenate([t for ts in _COMPARED.values() for t in ts]))
        close = zip(lines, _hashed(lines))
        plain = [x for x, h in close if len(h) and np.isin(_pairs(h), every).mean() < SIMILAR / 3]
        rows += [(x, 0) for x in plain]
        some = sorted({w for ts in _TEMPLATES.values() for t in ts for w in t.split()})
        r.shuffle(rows)
        fit = np.arange(len(rows)) % 5 != 0
        mixes = [(" ".join(r.choice(FILLER if r.random() < 0.5 else some) for _ in range(r.randrange(1, 16))), 0) for _ in range(20 * COPIES)]
        rows, fit = rows + mixes, np.append(fit, np.ones(len(mixes), dtype=bool))
        rows += [(vary(t), 0) for t in UNSEEN for _ in range(COPIES)]
        fit = np.append(fit, np.zeros(len(rows) - len(fit), dtype=bool))
        y = np.array([k for _, k in rows])
        own = _hashed([t for t, _ in rows])
        h = np.concatenate(own)
        unit, gram = runs(h, np.repeat(np.arange(len(own)), [len(x) for x in own]))
        both = np.unique(np.stack([unit.astype(np.uint64), gram], axis=1), axis=0)
        unit, gram = both[:, 0].astype(np.int64), both[:, 1]
        grams, place = np.unique(gram, return_inverse=True)
        kept = np.bincount(place[y[unit] > 0], minlength=len(grams)) >= SEEN
        at = np.cumsum(kept) - 1
        use = kept[place]
        unit, place, grams = unit[use], at[place[use]], grams[kept]
        weights, bias = self._learn(unit, place, len(grams), y, fit)
        live = np.abs(weights).max(axis=1) > 0
        self.grams, self.weights, self.bias = grams[live], weights[live], bias
        self.words = self._spelt(h, np.repeat(np.arange(len(own)), [len(x) for x in own]))
        z = self._logits(unit, place, weights, bias, len(rows))[~fit]
        held = y[~fit]
        self.heat = min((0.5, 0.7, 1.0, 1.4, 2.0, 3.0), key=lambda t: -np.log(self._soft(z / t)[np.arange(len(held)), held] + 1e-12).mean())
        given = 1 - self._soft(z / self.heat)[:, 0]
        new = np.arange(len(rows))[~fit] >= len(rows) - COPIES * len(UNSEEN)
        self.least = max(0.5, *(float(np.quantile(x, 1 - rate, method="higher")) for x, rate in ((given[(held == 0) & ~new], FALSE_RATE), (given[new], UNSEEN_RATE))))

    def _spelt(self, h: np.ndarray, unit: np.ndarray) -> np.ndarray:
        """Of the training words, those in some feature with weight."""
        out = []
        for n in range(1, LONGEST + 1):
            at = np.flatnonzero(unit[: len(unit) - n + 1] == unit[n - 1 :])
            g = np.zeros(len(at), dtype=np.uint64)
            for j in range(n):
                g += h[at + j] * text._PLACE[j]
            at = at[np.isin(text.mix(g + np.uint64(n)), self.grams)]
            out += [h[at + j] for j in range(n)]
        return text.distinct(np.concatenate(out))

    @staticmethod
    def _logits(unit: np.ndarray, place: np.ndarray, weights: np.ndarray, bias: np.ndarray, n: int) -> np.ndarray:
        z = np.repeat(bias[None], n, axis=0)
        if len(unit):
            start = np.flatnonzero(np.append(True, unit[1:] != unit[:-1]))
            z[unit[start]] += np.add.reduceat(weights[place], start, axis=0)
        return z

    def _learn(self, unit: np.ndarray, place: np.ndarray, n: int, y: np.ndarray, fit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Accelerated gradient steps on sparse rows, each followed by a step of all weights towards zero (the penalty)."""
        own = fit[unit]
        unit, place = (np.cumsum(fit) - 1)[unit[own]], place[own]
        target = np.eye(len(self.families), dtype=np.float32)[y[fit]]
        by = np.argsort(place, kind="stable")
        rows, cols = unit[by], place[by]
        start = np.flatnonzero(np.append(True, cols[1:] != cols[:-1]))
        w = np.zeros((n, len(self.families)), dtype=np.float32)
        b = np.zeros(len(self.families), dtype=np.float32)
        ahead, last, rate = w.copy(), w.copy(), 2.0
        for step in range(STEPS):
            p = (self._soft(self._logits(unit, place, ahead, b, len(target))) - target) / np.float32(len(target))
            grad = np.zeros_like(w)
            grad[cols[start]] = np.add.reduceat(p[rows], start, axis=0)
            w = ahead - rate * grad
            w = np.sign(w) * np.maximum(np.abs(w) - np.float32(rate * PENALTY), 0)
            b = b - rate * p.sum(axis=0)
            ahead, last = w + np.float32(step / (step + 3)) * (w - last), w
        return w, b

    @staticmethod
    def _soft(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def predict(self, h: np.ndarray, unit: np.ndarray) -> list[tuple[int, str, float]]:
        """(unit, family, probability) of the units that are given one; units ascend."""
        if not len(h) or not len(self.grams):
            return []
        own, gram = runs(h, unit, self.words)
        place = np.minimum(np.searchsorted(self.grams, gram), len(self.grams) - 1)
        hit = self.grams[place] == gram
        pair = text.distinct(own[hit] * len(self.grams) + place[hit])
        own, place = pair // len(self.grams), pair % len(self.grams)
        names, at = np.unique(own, return_inverse=True)
        p = self._soft(self._logits(at, place, self.weights, self.bias, len(names)) / self.heat)
        k = p[:, 1:].argmax(axis=1) + 1
        return [(int(names[i]), self.families[k[i]], float(p[i, k[i]])) for i in np.flatnonzero(1 - p[:, 0] >= self.least)]


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """With whole lines of the corpus: some ``sample`` of them, by a range of their hash (so tasks send no more than that)."""
    lines = docs.where("text is not null").select(F.explode(F.split("text", "\n")).alias("line")).where("trim(line) <> ''")
    n = lines.count()
    share = min(1.0, sample / max(n, 1))
    near = F.pmod(F.xxhash64("line", F.lit("licences")), F.lit(1 << 40)) < int(share * (1 << 40))
    # Lines that many rows repeat share a hash: each counts once.
    rows = lines.where(near).select("line").distinct().orderBy(F.xxhash64("line"), "line").limit(2 * sample).collect()
    return Model(sorted(r["line"] for r in rows))


RESULT = "doc_id long, paragraph int, lines int, family string, probability double, similarity double, confirmed boolean"


def found(column: pa.Array, model: Model) -> list[tuple]:
    """(row, first line, lines, family, probability, similarity) of each paragraph of the texts that is given a family."""
    lower = pc.utf8_lower(column)
    data, offsets = text.raw(lower)
    h, begin, _, first = text.spans(lower, text._sign)
    if not len(h):
        return []
    breaks = np.flatnonzero(data == 10)
    doc = np.searchsorted(first, np.arange(len(h)), "right") - 1
    line = np.searchsorted(breaks, begin) + doc  # a new text is a new line
    new_line = np.append(True, line[1:] != line[:-1])
    block = np.cumsum(np.append(True, (doc[1:] != doc[:-1]) | (np.diff(line) > 1))) - 1
    lines = np.cumsum(new_line) - 1
    base = np.searchsorted(breaks, offsets[:-1]) + np.arange(len(offsets) - 1)  # each text's first line

    def spread(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        return at, np.append(at[1:], len(ids))

    held: dict[tuple[int, str], list[tuple]] = {}

    def add(a: int, z: int, family: str, p: float, whole: bool = True) -> None:
        """A paragraph; one beyond a line may stand in place of the lines of its block."""
        d, key = int(doc[a]), (int(block[a]), family)
        row = (d, int(line[a] - base[d]), int(line[z - 1] - line[a]) + 1, family, round(p, 6), round(similarity(h[a:z], family), 6))
        if whole and key in held:
            best = max(x[-1] for x in held[key])
            held[key] = held[key] if best >= SIMILAR or best > row[-1] else [row]
        else:
            held.setdefault(key, []).append(row)

    a, z = spread(lines)
    for u, family, p in model.predict(h, lines):
        add(a[u], z[u], family, p, False)
    a, z = spread(block)
    size = z - a
    several = (lines[z - 1] > lines[a]) & (size <= WINDOW)
    use = several[block]
    for u, family, p in model.predict(h[use], block[use]):
        add(a[u], z[u], family, p)
    # Longer blocks by windows, each half over the last.
    long = np.flatnonzero(size > WINDOW)
    half = WINDOW // 2
    count = -(-(size[long] - half) // half)
    start = np.repeat(a[long], count) + half * (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
    end = np.minimum(start + WINDOW, np.repeat(z[long], count))
    best: dict[tuple[int, str], tuple] = {}
    for i in range(0, len(start), 4096):
        s, e = start[i : i + 4096], end[i : i + 4096]
        at = np.repeat(s - (np.cumsum(e - s) - (e - s)), e - s) + np.arange((e - s).sum())
        for u, family, p in model.predict(h[at], np.repeat(np.arange(len(s)), e - s)):
            x = (similarity(h[s[u] : e[u]], family), -int(s[u]), int(e[u]), p)
            key = (int(block[s[u]]), family)
            best[key] = max(best.get(key, x), x)
    for (_, family), (_, s, e, p) in best.items():
        add(-s, e, family, p)
    return sorted(x for rows in held.values() for x in rows)


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """One row for each paragraph that is given a family."""
    spark = docs.sparkSession
    common.ready(spark)
    sent = spark.sparkContext.broadcast(model)  # weights of the runs of words of the templates: below a MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.float64(), pa.bool_()]
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            rows = [(ids[d], *rest, rest[-1] >= SIMILAR) for d, *rest in found(batch.column("text"), sent.value)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 7, kinds)], names=["doc_id", "paragraph", "lines", "family", "probability", "similarity", "confirmed"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, RESULT)


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan(docs, train(docs))
