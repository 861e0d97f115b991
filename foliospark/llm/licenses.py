"""License scans with a positional index over the rare words of license templates."""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.common import let, long, table

#: Base phrases and labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Public license texts and notices: label, text, and the phrases that must stand in it.
_TEXTS = (
    (
        "mit",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"),
        to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense,
        and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above
        copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.""",
        ("permission is hereby granted", "associated documentation files"),
    ),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted", "associated documentation files")),
    ("mit", "released under the MIT license", ("mit license",)),
    ("mit", "SPDX-License-Identifier: MIT", ("spdx license identifier mit",)),
    (
        "isc",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above
        copyright notice and this permission notice appear in all copies.""",
        ("with or without fee", "this permission notice appear"),
    ),
    (
        "apache-2",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a
        copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed
        under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for
        the specific language governing permissions and limitations under the License.""",
        ("apache license version 2", "in compliance with the license"),
    ),
    ("apache-2", "licensed under the Apache License, Version 2.0", ("apache license version 2",)),
    ("apache-2", "SPDX-License-Identifier: Apache-2.0", ("spdx license identifier apache 2",)),
    (
        "gpl-3",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free
        Software Foundation, either version 3 of the License, or (at your option) any later version.""",
        ("gnu general public license", "version 3 of the license"),
    ),
    ("gpl-3", "licensed under the GNU General Public License version 3", ("gnu general public license", "version 3")),
    ("gpl-3", "SPDX-License-Identifier: GPL-3.0", ("spdx license identifier gpl 3",)),
    (
        "gpl-2",
        """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free
        Software Foundation; either version 2 of the License, or (at your option) any later version.""",
        ("gnu general public license", "version 2 of the license"),
    ),
    ("gpl-2", "licensed under the GNU General Public License version 2", ("gnu general public license", "version 2")),
    ("gpl-2", "SPDX-License-Identifier: GPL-2.0", ("spdx license identifier gpl 2",)),
    (
        "lgpl",
        """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the
        Free Software Foundation""",
        ("gnu lesser general public license",),
    ),
    ("lgpl", "licensed under the GNU Lesser General Public License", ("gnu lesser general public license",)),
    (
        "agpl-3",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the
        Free Software Foundation, either version 3 of the License""",
        ("gnu affero general public license",),
    ),
    ("agpl-3", "licensed under the GNU Affero General Public License version 3", ("gnu affero general public license",)),
    (
        "bsd",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
        Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary
        form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials
        provided with the distribution.""",
        ("redistribution and use in source and binary forms", "must retain the above copyright notice"),
    ),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    (
        "bsd-3",
        """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software
        without specific prior written permission.""",
        ("endorse or promote products", "prior written permission"),
    ),
    ("bsd-3", "SPDX-License-Identifier: BSD-3-Clause", ("spdx license identifier bsd 3",)),
    (
        "mpl-2",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can
        obtain one at https://mozilla.org/MPL/2.0/.""",
        ("mozilla public license", "source code form"),
    ),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla public license",)),
    (
        "epl-2",
        """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at
        https://www.eclipse.org/legal/epl-2.0/""",
        ("eclipse public license",),
    ),
    (
        "zlib",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from
        the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and
        redistribute it freely, subject to the following restrictions""",
        ("permission is granted to anyone", "redistribute it freely"),
    ),
    (
        "bsl-1",
        """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by
        this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software""",
        ("any person or organization", "accompanying documentation"),
    ),
    (
        "unlicense",
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this
        software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
        ("unencumbered software", "public domain"),
    ),
    ("unlicense", "This is free and unencumbered software released into the public domain", ("unencumbered software", "public domain")),
    (
        "wtfpl",
        """Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is
        changed.""",
        ("verbatim or modified copies",),
    ),
    ("cc-by", "licensed under CC BY 4.0", ("cc by 4 0",)),
    ("cc-by-sa", "licensed under CC BY-SA 4.0", ("cc by sa",)),
    ("cc-by-nc", "licensed under CC BY-NC 4.0", ("cc by nc",)),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution 4",)),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ("creative commons attribution sharealike",)),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ("creative commons attribution noncommercial",)),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", ("waived all copyright",)),
)
#: The same as words: label, words with single spaces, phrases.
TEMPLATES = tuple((label, " ".join(re.findall(r"[a-z0-9]+", text.lower())), keys) for label, text, keys in _TEXTS)
#: Least share of a template's IDF weight that an alignment must hold.
LEAST = 0.8


def license_words(text: Column) -> Column:
    """Words of the lower-cased text: runs outside ASCII punctuation, controls and space.

    ``lower`` is used for A-Z; the only other character it would turn into an ASCII letter, the
    kelvin sign, is taken out of its way.
    """
    plain = F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("€"))
    return F.array_remove(F.split(F.lower(plain), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def vocabulary() -> list[str]:
    return sorted({w for t in [*PHRASES, *(t for _, t, _ in TEMPLATES)] for w in t.split()})


def document_frequency(docs: DataFrame) -> tuple[int, dict[str, int]]:
    """Rows of ``docs`` and, for each word of the templates (a fixed list), rows that hold it."""
    own = F.split(F.lit(" ".join(vocabulary())), " ")
    found = docs.select(F.explode(F.array_append(F.array_intersect(own, license_words(F.col("text"))), F.lit(""))).alias("word"))
    counts = {r["word"]: r["count"] for r in found.groupBy("word").count().collect()}
    return counts.pop("", 0), counts


def build_index(n_docs: int, df: dict[str, int]) -> list[dict]:
    """Templates and base phrases with the IDF of each word, the word positions that mandatory
    phrases cover, and an anchor: the mandatory word of highest IDF. It has to stand in its place
    in every alignment that counts, so none is lost, whatever else a text has changed. Words that
    the documents hold alike are ranked by how few templates hold them."""
    idf = {w: round(math.log((n_docs + 1) / (df.get(w, 0) + 1)) + 1, 6) for w in vocabulary()}
    texts = [set(t.split()) for t in [*PHRASES, *(t for _, t, _ in TEMPLATES)]]
    common = {w: sum(w in t for t in texts) for w in idf}
    index = []
    for label, text, keys, base in [(v, k, (k,), True) for k, v in PHRASES.items()] + [(*t, False) for t in TEMPLATES]:
        words = text.split()
        must = set()
        for key in keys:
            k = key.split()
            at = next(i for i in range(len(words)) if words[i : i + len(k)] == k)
            must.update(range(at, at + len(k)))
        place = min(must, key=lambda i: (-idf[words[i]], common[words[i]], i))
        index.append({"label": label, "words": words, "idf": [idf[w] for w in words], "must": sorted(must), "anchors": [(words[place], place)], "base": base})
    return index


def scan(docs: DataFrame, index: list[dict] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of each row.

    The places of a document's rare license words are looked up in the postings of the templates;
    a template's start follows from each pair of positions (intersection by relative position).
    Postings hold the rarest mandatory word of each template, which no alignment can lack.
    At every such start the words are compared in place: a base phrase needs all of them, another
    template its mandatory phrases and LEAST of its IDF weight. The score is the largest share
    found, 0 without any; labels are distinct, sorted and comma-joined, '' without any.

    Everything but the word counts of the fixed vocabulary happens inside a row: no shuffle, and
    no group to be skewed. Texts are read whole, however long; null text counts as empty; equal rows get equal results; no rows give
    none; other columns are ignored.
    """
    index = index or build_index(*document_frequency(docs))
    listed = [{"label": t["label"], "base": t["base"], "words": t["words"], "idf": t["idf"], "must": t["must"]} for t in index]
    templates = F.from_json(F.lit(json.dumps(listed)), "array<struct<label:string,base:boolean,words:array<string>,idf:array<double>,must:array<int>>>")
    places = [{"word": w, "t": n, "at": i} for n, t in enumerate(index) for w, i in t["anchors"]]
    postings = F.from_json(F.lit(json.dumps(places)), "array<struct<word:string,t:int,at:int>>")
    rare = sorted({w for t in index for w, _ in t["anchors"]})

    def starts(w: Column) -> Column:
        places = F.filter(F.transform(w, lambda x, i: F.struct(x.alias("word"), i.alias("i"))), lambda h: h["word"].isin(rare))
        found = F.transform(places, lambda h: F.transform(F.filter(postings, lambda p: p["word"] == h["word"]), lambda p: F.struct(p["t"].alias("t"), (h["i"] - p["at"]).alias("start"))))
        return F.filter(F.array_distinct(F.flatten(found)), lambda c: c["start"] >= 0)

    def judge(w: Column, c: Column) -> Column:
        def one(t: Column) -> Column:
            hit = lambda j: F.coalesce(F.get(w, c["start"] + j) == F.get(t["words"], j), F.lit(False))
            total = lambda keep: F.aggregate(t["idf"], F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("j")), lambda a, x: F.struct((a["s"] + F.when(keep(a["j"]), x).otherwise(0.0)).alias("s"), (a["j"] + 1).alias("j")), lambda a: a["s"])
            share = F.when(F.forall(t["must"], hit), total(hit) / total(lambda j: F.lit(True))).otherwise(F.lit(0.0))
            return F.struct(t["label"].alias("label"), t["base"].alias("base"), c["start"].alias("start"), F.round(share, 6).alias("share"))

        return let(F.get(templates, c["t"]), one)

    def result(w: Column) -> Column:
        hits = F.when(F.arrays_overlap(w, F.split(F.lit(" ".join(rare)), " ")), F.filter(F.transform(starts(w), lambda c: judge(w, c)), lambda x: x["share"] >= F.when(x["base"], 1.0).otherwise(LEAST)))
        empty = F.array().cast("array<struct<label:string,base:boolean,start:int,share:double>>")

        def summary(h: Column) -> Column:
            base = F.filter(h, lambda x: x["base"])
            names = lambda a: F.array_join(F.array_sort(F.array_distinct(F.transform(a, lambda x: x["label"]))), ",")
            at = F.transform(base, lambda x: x["start"])
            return F.struct(
                long(F.size(w)).alias("n_words"),
                long(F.size(base)).alias("n_base"),
                long(F.array_min(at)).alias("first_word"),
                long(F.array_max(at)).alias("last_word"),
                names(base).alias("base_labels"),
                names(h).alias("labels"),
                F.coalesce(F.array_max(F.transform(h, lambda x: x["share"])), F.lit(0.0)).alias("score"),
            )

        return let(F.coalesce(hits, empty), summary)

    return docs.select("doc_id", let(license_words(F.col("text")), result).alias("r")).select("doc_id", "r.*")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _template_rows() -> str:
    rows = []
    for n, t in enumerate(build_index(0, {})):
        rows += [f"({n}, '{t['label']}', {t['base']}, {j}, '{w}', {j in t['must']})" for j, w in enumerate(t["words"])]
    return ", ".join(rows)


#: By brute force: every word of every template against every word of the text.
OP4_SQL = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
w AS (SELECT doc_id, i - 1 AS i, w[i] AS word FROM d, unnest(range(1, len(w) + 1)) AS u(i)),
t0 AS (SELECT * FROM (VALUES {_template_rows()}) AS x(t, label, base, j, word, must)),
df AS (SELECT word, count(DISTINCT doc_id) AS df FROM w WHERE word IN (SELECT word FROM t0) GROUP BY word),
t AS (SELECT t0.*, round(ln(((SELECT count(*) FROM d) + 1) / (coalesce(df, 0) + 1)) + 1, 6) AS idf FROM t0 LEFT JOIN df USING (word)),
tt AS (SELECT t, sum(idf) AS total, count(*) FILTER (must) AS n_must FROM t GROUP BY t),
c AS (
  SELECT doc_id, t.t, label, base, i - j AS start, round(sum(idf) / any_value(total), 6) AS share
  FROM w JOIN t USING (word) JOIN tt ON tt.t = t.t WHERE i >= j
  GROUP BY doc_id, t.t, label, base, i - j HAVING count(*) FILTER (must) = any_value(n_must)),
h AS (SELECT * FROM c WHERE share >= CASE WHEN base THEN 1.0 ELSE {LEAST} END)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(count(*) FILTER (base) AS BIGINT) AS n_base,
       CAST(min(start) FILTER (base) AS BIGINT) AS first_word, CAST(max(start) FILTER (base) AS BIGINT) AS last_word,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base), '') AS base_labels,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels, coalesce(max(share), 0)::DOUBLE AS score
FROM d LEFT JOIN h ON h.doc_id = d.doc_id GROUP BY d.doc_id, len(w)
"""
