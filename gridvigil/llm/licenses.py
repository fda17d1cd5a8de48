"""Licence scan: Dice coefficient of word bigrams against licence templates.

All of it is column expressions. A text is lower-cased (A-Z) and everything but a-z, 0-9
and line feeds becomes a space; its units are its lines, its paragraphs of two or more
lines, and passages of any place and a template's length. A unit of ``a`` distinct bigrams matches a template of ``b`` when twice the number
of common ones is at least ``threshold * (a + b)``. That needs ``a`` within fixed bounds of
``b``, and ``threshold / (2 - threshold)`` of the template's bigrams in the unit; so of any
choice of the template's other bigrams and one more, at least one must be there. Texts and
units without any chosen bigram are left out first; the size bounds prune what remains.

Passages are laid so that a chosen bigram stands in the passage where it stands in its
template. Of passages that overlap, directly or by others between them, the best one counts
(ties: the longer template, the earlier place, the name), so a notice is found inside a longer
line, over several lines, and as part of a licence's whole text.

Defined results: a null or empty text and units of fewer than two words match nothing;
the best template of a unit wins, ties by name; repeated rows are matched one by one; other
columns play no part; a null id stays null; a text of any length is scanned whole. ``number``
is a line's or paragraph's place, or that of a passage's first word.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: words that other text is full of
COMMON = frozenset("a an and any as at be by can either for free in is it later may of on or that the this to under use with you your".split())

# Licence name, and a notice, a standard header, or the start of its text
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("AGPL-3.0", "SPDX-License-Identifier: AGPL-3.0-or-later"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-or-later"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MIT", "This repository is released under the MIT License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "Mozilla Public License Version 2.0 1. Definitions"),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)


def bigrams(text: str) -> set[str]:
    words = re.findall(r"[a-z0-9]+", text.translate(str.maketrans(CAPITALS, SMALL)))
    return {f"{a} {b}" for a, b in zip(words, words[1:])}


def size_bounds(size: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """Fewest and most bigrams of a unit that can match a template of ``size``."""
    return (
        math.ceil(size * threshold / (2 - threshold) - 1e-9),
        math.floor(size * (2 - threshold) / threshold + 1e-9),
    )


def witnesses(templates=TEMPLATES, threshold: float = THRESHOLD) -> list[set[str]]:
    """For each template a choice of bigrams of which every matching unit holds one.

    Bigrams with a long word that is not a common one are taken, of these the ones that most
    templates share: they are rare in other text, and few serve all templates.
    """
    sets = [bigrams(text) for _, text in templates]
    shared = Counter(b for own in sets for b in own)
    found = []
    for own in sets:
        need = len(own) - size_bounds(len(own), threshold)[0] + 1
        found.append(set(sorted(own, key=lambda b: (-len(rare_word(b)), -shared[b], b))[:need]))
    return found


def rare_word(bigram: str) -> str:
    """The longer word of a bigram; common words only if there is no other."""
    words = bigram.split(" ")
    return max([w for w in words if w not in COMMON] or words, key=len)


def normalise(text: Column) -> Column:
    lower = F.translate(F.coalesce(text, F.lit("")), CAPITALS, SMALL)
    return F.regexp_replace(lower, "[^a-z0-9\n]+", " ")


def words_of(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.translate(str.maketrans(CAPITALS, SMALL)))


def seeds(templates=TEMPLATES, threshold: float = THRESHOLD) -> list[tuple[str, int, int]]:
    """(bigram, template, place) of every chosen bigram in its template."""
    found = []
    for number, ((_, text), chosen) in enumerate(zip(templates, witnesses(templates, threshold), strict=True)):
        words = words_of(text)
        found += [(b, number, i) for i, b in enumerate(f"{x} {y}" for x, y in zip(words, words[1:])) if b in chosen]
    return found


def pairs_of(words: Column) -> Column:
    """The bigrams of an array of words, in order."""
    n = F.size(words) - 1
    return F.zip_with(F.slice(words, 1, F.greatest(n, F.lit(0))), F.slice(words, 2, F.greatest(n, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``value`` as a column that is computed once a row, however often it is used."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def listed(values) -> Column:
    return F.array(*map(F.lit, sorted(values)))


def dice(pairs: Column, own: Column) -> Column:
    return 2.0 * F.size(F.array_intersect(pairs, own)) / (F.size(pairs) + F.size(own))


def scan(
    docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per matching unit: id, unit kind, number from 0, licence, Dice coefficient."""
    every = set().union(*witnesses(templates, threshold))
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("raw"))
    # a matching unit holds a chosen bigram, and so its rarer word; Unicode's lower case also lowers
    # A-Z, so no such text is lost
    raw_words = F.split(F.lower("raw"), "[^a-z0-9]+")
    texts = texts.filter(F.arrays_overlap(raw_words, listed(set(map(rare_word, every)))))
    texts = once(texts, "text", normalise(F.col("raw"))).drop("raw")
    texts = once(texts, "words", F.filter(F.split("text", "[ \n]+"), lambda w: w != ""))
    texts = once(texts, "pairs", pairs_of(F.col("words")))
    texts = once(texts, "present", F.array_intersect("pairs", listed(every))).filter(F.size("present") > 0)
    found = whole_units(texts, templates, threshold).unionByName(passages(texts, templates, threshold))
    return found.withColumnRenamed("id", id_col)


def whole_units(texts: DataFrame, templates, threshold: float) -> DataFrame:
    """Lines and paragraphs that match as a whole."""

    def units(kind: str, separator: str) -> Column:
        pieces = F.split(F.col("text"), separator, -1)
        return F.transform(pieces, lambda x, i: F.struct(F.lit(kind).alias("unit"), i.cast("long").alias("number"), x.alias("text")))

    paragraphs = F.filter(
        units("paragraph", "\n(?: *\n)+"), lambda u: F.regexp_replace(u["text"], "^[ \n]+|[ \n]+$", "").contains("\n")
    )
    # a unit that matches holds a chosen bigram that its text holds
    single = texts.select("id", "present", F.explode(F.concat(units("line", "\n"), paragraphs)).alias("u"))
    single = once(single, "words", F.filter(F.split("u.text", "[ \n]+"), lambda w: w != "")).filter(F.size("words") > 1)
    held = once(single, "pairs", F.array_distinct(pairs_of(F.col("words")))).filter(F.arrays_overlap("pairs", "present"))
    held = held.select("id", "u.unit", "u.number", "pairs")
    known = F.array(
        *(
            F.struct(F.lit(name).alias("name"), F.lit(low).alias("low"), F.lit(high).alias("high"), listed(own).alias("own"))
            for name, own in ((name, bigrams(text)) for name, text in templates)
            for low, high in [size_bounds(len(own), threshold)]
        )
    )
    size = F.size("pairs")
    near = F.filter(known, lambda t: size.between(t["low"], t["high"]))
    scores = F.transform(near, lambda t: F.struct((-dice(F.col("pairs"), t["own"])).alias("rank"), t["name"].alias("name")))
    best = F.array_min(F.filter(scores, lambda s: s["rank"] <= -threshold))
    return (
        once(held, "best", best)
        .filter("best is not null")
        .select("id", "unit", "number", F.col("best.name").alias("license"), (-F.col("best.rank")).alias("dice"))
    )


def passages(texts: DataFrame, templates, threshold: float) -> DataFrame:
    """The best matching passages of each text, row by row: nothing is shuffled."""
    known = F.array(
        *(
            F.struct(F.lit(name).alias("name"), F.lit(len(words_of(text))).alias("n"), listed(bigrams(text)).alias("own"))
            for name, text in templates
        )
    )
    every = seeds(templates, threshold)
    anchors = F.create_map(
        *(
            x
            for bigram in sorted({b for b, _, _ in every})
            for x in (F.lit(bigram), F.array(*(F.struct(F.lit(t).alias("t"), F.lit(i).alias("i")) for b, t, i in every if b == bigram)))
        )
    )
    held = F.filter(
        F.transform("pairs", lambda pair, at: F.struct(at.alias("at"), pair.alias("pair"))),
        lambda p: F.array_contains("present", p["pair"]),
    )
    texts = once(texts, "held", held)
    places = F.transform("held", lambda p: F.struct(p["at"].alias("at"), F.element_at(anchors, p["pair"]).alias("hits")))
    laid = F.array_distinct(
        F.flatten(
            F.transform(
                places,
                lambda p: F.transform(
                    p["hits"], lambda h: F.struct(F.greatest(p["at"] - h["i"], F.lit(0)).alias("start"), h["t"].alias("t"))
                ),
            )
        )
    )

    def score(w):
        template = F.element_at(known, w["t"] + 1)
        own = F.slice(F.col("words"), w["start"] + 1, template["n"])
        return F.struct(
            w["start"].alias("start"),
            (w["start"] + F.size(own)).alias("stop"),
            (-dice(F.array_distinct(pairs_of(own)), template["own"])).alias("rank"),
            (-template["n"]).alias("length"),
            template["name"].alias("license"),
        )

    texts = once(texts, "laid", laid)
    scored = F.transform("laid", score)
    order = ("rank", "length", "start", "license")

    def best_of(group: Column, w: Column) -> Column:
        first = F.struct(*[group["best"][c].alias(c) for c in order])
        second = F.struct(*[w[c].alias(c) for c in order])
        return F.struct(
            F.when(second < first, w).otherwise(group["best"]).alias("best"), F.greatest(group["reach"], w["stop"]).alias("reach")
        )

    def fold(groups: Column, w: Column) -> Column:
        alone = F.struct(w.alias("best"), w["stop"].alias("reach"))
        n = F.size(groups)
        return F.when((n > 0) & (w["start"] < F.try_element_at(groups, F.lit(-1))["reach"]),
                      F.concat(F.slice(groups, 1, n - 1), F.array(best_of(F.try_element_at(groups, F.lit(-1)), w)))
        ).otherwise(F.concat(groups, F.array(alone)))

    kind = "struct<start:int,stop:int,rank:double,length:int,license:string>"
    nothing = F.array().cast(f"array<struct<best:{kind},reach:int>>")
    texts = once(texts, "scored", scored.cast(f"array<{kind}>"))
    matches = F.array_sort(F.filter("scored", lambda w: w["rank"] <= -threshold))
    return (
        once(texts, "matches", matches)
        .filter(F.size("matches") > 0)
        .select("id", F.explode(F.aggregate("matches", nothing, fold)).alias("group"))
        .select(
            "id", F.lit("passage").alias("unit"), F.col("group.best.start").cast("long").alias("number"),
            F.col("group.best.license").alias("license"), (-F.col("group.best.rank")).alias("dice"),
        )
    )


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _rows(rows) -> str:
    return ", ".join("(" + ", ".join(x if isinstance(x, str) and x.startswith("[") else _quoted(x) if isinstance(x, str) else str(x) for x in row) + ")" for row in rows)


#: DuckDB: every line and paragraph against every template, and every passage that a seed lays
SQL = f"""
WITH templates(t, name, n, pairs) AS (VALUES {_rows(
    (i, name, len(words_of(text)), "[" + ", ".join(map(_quoted, sorted(bigrams(text)))) + "]") for i, (name, text) in enumerate(TEMPLATES)
)}),
seeds(bigram, t, i) AS (VALUES {_rows(seeds())}),
texts AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_replace(translate(coalesce(text, ''), '{CAPITALS}', '{SMALL}'), '[^a-z0-9\\n]+', ' ', 'g') AS text
  FROM documents),
units AS (
  SELECT r, doc_id, 'line' AS unit, unnest(generate_series(0, len(x) - 1)) AS number, unnest(x) AS text
  FROM (SELECT r, doc_id, string_split(text, chr(10)) AS x FROM texts)
  UNION ALL
  SELECT * FROM (
    SELECT r, doc_id, 'paragraph' AS unit, unnest(generate_series(0, len(x) - 1)) AS number, unnest(x) AS text
    FROM (SELECT r, doc_id, regexp_split_to_array(text, '\\n( *\\n)+') AS x FROM texts))
  WHERE contains(trim(text, ' ' || chr(10)), chr(10))),
worded AS (
  SELECT r, doc_id, unit, number, list_filter(regexp_split_to_array(text, '[ \\n]+'), lambda x: x <> '') AS w FROM units),
paired AS (
  SELECT r, doc_id, unit, number, list_distinct(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])) AS p
  FROM worded WHERE len(w) > 1),
scored AS (
  SELECT r, doc_id, unit, number, name, 2.0::DOUBLE * len(list_intersect(p, pairs)) / (len(p) + len(pairs)) AS dice
  FROM paired JOIN templates
    ON len(p) >= len(pairs) * {THRESHOLD} / (2 - {THRESHOLD}) - 1e-9 AND len(p) <= len(pairs) * (2 - {THRESHOLD}) / {THRESHOLD} + 1e-9),
whole AS (SELECT r, doc_id, list_filter(regexp_split_to_array(text, '[ \\n]+'), lambda x: x <> '') AS w FROM texts),
spots AS (
  SELECT r, doc_id, w, unnest(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])) AS bigram,
    unnest(generate_series(0, len(w) - 2)) AS place FROM whole WHERE len(w) > 1),
laid AS (SELECT DISTINCT r, doc_id, w, t, greatest(place - i, 0) AS start FROM spots JOIN seeds USING (bigram)),
cut AS (
  SELECT r, doc_id, start, name, n, pairs, list_slice(w, start + 1, start + n) AS own FROM laid JOIN templates USING (t)),
passage AS (
  SELECT r, doc_id, start, start + len(own) AS stop, name, n, 2.0::DOUBLE * len(list_intersect(p, pairs)) / (len(p) + len(pairs)) AS dice
  FROM (SELECT *, list_distinct(list_transform(generate_series(1, len(own) - 1), lambda i: own[i] || ' ' || own[i + 1])) AS p FROM cut)),
good AS (SELECT * FROM passage WHERE dice >= {THRESHOLD}),
edges AS (
  SELECT *, start >= coalesce(max(stop) OVER (PARTITION BY r ORDER BY start, stop, dice DESC, n DESC, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS new
  FROM good),
grouped AS (
  SELECT *, sum(new::INT) OVER (PARTITION BY r ORDER BY start, stop, dice DESC, n DESC, name ROWS UNBOUNDED PRECEDING) AS g FROM edges)
SELECT doc_id, unit, number, name AS license, dice FROM (
  SELECT *, row_number() OVER (PARTITION BY r, unit, number ORDER BY dice DESC, name) AS place
  FROM scored WHERE dice >= {THRESHOLD})
WHERE place = 1
UNION ALL
SELECT doc_id, 'passage', start, name, dice FROM (
  SELECT *, row_number() OVER (PARTITION BY r, g ORDER BY dice DESC, n DESC, start, name) AS place FROM grouped)
WHERE place = 1
"""
