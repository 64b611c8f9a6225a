"""License scans: sparse TF-IDF cosine to templates, then inheritance from the nearest directory above.

The parts of a file that are compared with templates are its lines, its blocks of lines without a wordless one between,
its header (the comment it begins with) and, of a file named like a license file, its whole text. Each is a sparse vector
of words and word pairs. The inverse document frequency of a term that templates hold counts all lines of all files; no
template holds any other term, so each of these weighs like one never seen. A part that is too far from every template
by the weight of its own other terms alone is passed over, the rest are scored exactly; no word has to be there.

A file's own license is that of its best part at `LEAST` or more. A file named like a license file, or in which parts
that reach it hold at least half of the words, licenses its directory. Every other file takes the license of the nearest
directory above it: the distinct directories, not the files, are joined with their ancestors, and files then with theirs.

Null text has no words, a null path no directory. Of equal scores the license first in the alphabet wins; of several
license files in a directory the best score, then the first path. Each row is judged by itself, so repeated rows get the
same result once each. Texts of any length are read whole; an empty table gives no rows; only fid, path and text are
looked at, whatever other columns are called.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_batches, distinct, documents, mixed, scratch, stored, word_hashes

LEAST = 0.6
HALF = 0.5

# Notices, standard headers, titles and opening conditions by which licenses are known.
TEMPLATES = (
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License, CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "CC0 1.0 Universal"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work, CC0."),
    ("EPL-2.0", "Eclipse Public License - v 2.0"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "ISC License"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MIT", "The MIT License (MIT)"),
    ("MIT", "Released under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
)
NAMED = r"(?i)(^|/)(licen[sc]e|copying|notice)(\.[a-z]+)?$"
COMMENT = r"^[ \t\r]*(#|//|/\*|\*|;|--|<!--|%)"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = bytes.maketrans(_UPPER.encode(), _LOWER.encode())
_WORD = re.compile(rb"[a-z0-9\x80-\xff]+")
_COMMENT, _NAMED = re.compile(COMMENT.encode()), re.compile(NAMED)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def templates() -> list[tuple[str, str]]:
    """(license, text), sorted; every license also has its short tag."""
    return sorted({*TEMPLATES, *((name, f"SPDX-License-Identifier: {name}") for name, _ in TEMPLATES)})


class Parts:
    """Words of a batch of files in a row, and the ranges of words that are compared: lines, blocks, headers, whole texts."""

    def __init__(self, texts: list[bytes], named: list[bool]):
        words: list[bytes] = []
        lines, blocks, headers, wholes, ends = [], [], [], [], [0]
        for doc, (text, by_name) in enumerate(zip(texts, named, strict=True)):
            begin, open_at, open_lines, worded = len(words), None, 0, 0
            header_end, in_header = begin, True
            for line in text.translate(_FOLD).split(b"\n"):
                at = len(words)
                words += _WORD.findall(line)
                if len(words) > at:
                    worded += 1
                    lines.append((at, len(words), doc))
                    if in_header and _COMMENT.match(line):
                        header_end, header_lines = len(words), worded
                    else:
                        in_header = False
                    if open_at is None:
                        open_at, open_lines = at, 0
                    open_lines += 1
                elif open_at is not None:
                    if open_lines > 1:
                        blocks.append((open_at, at, doc))
                    open_at = None
            if open_at is not None and open_lines > 1:
                blocks.append((open_at, len(words), doc))
            if header_end > begin and header_lines > 1:
                headers.append((begin, header_end, doc))
            if by_name and worded > 1:
                wholes.append((begin, len(words), doc))
            ends.append(len(words))
        self.ends = np.array(ends)
        self.words = word_hashes(words)
        self.pairs = mixed(self.words[:-1] * _GOLD + self.words[1:]) if len(words) else self.words
        self.lines = np.array(lines, dtype=np.int64).reshape(-1, 3)
        self.kinds = [self.lines, *(np.array(x, dtype=np.int64).reshape(-1, 3) for x in (blocks, headers, wholes))]

    def terms(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(term, number of its part) of all words and pairs of neighbours within parts that do not overlap."""
        n = parts[:, 1] - parts[:, 0]
        part = np.repeat(np.arange(len(parts)), n)
        at = np.repeat(parts[:, 0] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(len(part)) if len(part) else part
        inner = at + 1 < np.repeat(parts[:, 1], n)
        return np.concatenate([self.words[at], self.pairs[at[inner]]]), np.concatenate([part, part[inner]])


def _parts(b: pa.RecordBatch) -> Parts:
    texts = [(t.as_py() or "").encode("utf-8", "surrogatepass") for t in b.column("text")]
    return Parts(texts, [bool(p and _NAMED.search(p)) for p in b.column("path").to_pylist()])


def vocabulary(texts: list[str]) -> np.ndarray:
    """Terms that templates hold, sorted."""
    p = Parts([t.replace("\n", " ").encode() for t in texts], [False] * len(texts))
    return distinct(p.terms(p.lines)[0])


def _find(vocabulary: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """Place of each term in the vocabulary, or -1."""
    at = np.searchsorted(vocabulary, terms)
    at[at == len(vocabulary)] = 0
    return np.where(vocabulary[at] == terms, at, -1)


class Model:
    """Weights of terms and unit vectors of templates."""

    def __init__(self, names: list[str], texts: list[str], known: np.ndarray, n_lines: int, holding: np.ndarray):
        self.names, self.known = names, known
        self.unseen = float(np.log1p(n_lines) + 1)
        self.idf = np.log((1.0 + n_lines) / (1.0 + holding)) + 1
        p = Parts([t.replace("\n", " ").encode() for t in texts], [False] * len(texts))
        terms, part = p.terms(p.lines)
        self.vectors = np.zeros((len(known), len(names)))
        np.add.at(self.vectors, (_find(known, terms), part), 1.0)
        self.vectors *= self.idf[:, None]
        self.vectors /= np.sqrt((self.vectors**2).sum(axis=0))

    def score(self, p: Parts, parts: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Best cosine of each part and its template; 0 where it is below `least`."""
        score, which = np.zeros(len(parts)), np.zeros(len(parts), dtype=np.int64)
        terms, part = p.terms(parts)
        at = _find(self.known, terms)
        # squares of counts are no less than counts, nor more than the square of their sum: so much for certain
        weight = np.bincount(part, np.where(at >= 0, self.idf[at], 0.0), len(parts))
        others = np.bincount(part, at < 0, len(parts)) * self.unseen**2
        near = weight**2 * (1 - least**2) >= least**2 * others * (1 - 1e-9)
        keep = near[part]
        terms, part, at = terms[keep], part[keep], at[keep]
        if not len(terms):
            return score, which
        order = np.lexsort((terms, part))
        terms, part, at = terms[order], part[order], at[order]
        new = np.flatnonzero(np.concatenate([[True], (terms[1:] != terms[:-1]) | (part[1:] != part[:-1])]))
        tf = np.diff(np.append(new, len(terms)))
        part, at = part[new], at[new]
        w = tf * np.where(at >= 0, self.idf[at], self.unseen)
        norm = np.bincount(part, w * w, len(parts))
        inside = at >= 0
        near = np.bincount(part, np.where(inside, w * w, 0.0), len(parts)) >= least**2 * norm * (1 - 1e-9)
        keep = np.flatnonzero(inside & near[part])
        part, at, w = part[keep], at[keep], w[keep]
        starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.empty(0, dtype=np.int64)
        for lo in range(0, len(starts), 4096):  # whole parts, so many at a time
            own = starts[lo : lo + 4096]
            end = int(starts[lo + 4096]) if lo + 4096 < len(starts) else len(part)
            dots = np.add.reduceat(w[own[0] : end, None] * self.vectors[at[own[0] : end]], own - own[0], axis=0)
            cos = np.round(dots / np.sqrt(norm[part[own]])[:, None], 9)
            which[part[own]], score[part[own]] = cos.argmax(axis=1), cos.max(axis=1)
        return np.where(score >= least, score, 0.0), which


def _holding(known: np.ndarray):
    """(term, number of lines that hold it) of a task's files; term -1 counts the lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(known) + 1, dtype=np.int64)
        for b in batches:
            p = _parts(b)
            terms, part = p.terms(p.lines)
            at = _find(known, terms)
            pairs = distinct(part[at >= 0] * len(known) + at[at >= 0])
            total[:-1] += np.bincount(pairs % len(known), minlength=len(known))
            total[-1] += len(p.lines)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.where(at == len(known), -1, at), pa.int32()), pa.array(total[at], pa.int64())], names=["term", "n"])

    return run


def _own(model: Model, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = _parts(b)
            best = [(0.0, "")] * b.num_rows
            lit = np.zeros(len(p.words) + 1, dtype=np.int64)
            for parts in p.kinds:
                score, which = model.score(p, parts, least)
                hit = np.flatnonzero(score)
                np.add.at(lit, parts[hit, 0], 1)
                np.add.at(lit, parts[hit, 1], -1)
                for doc, s, k in zip(parts[hit, 2].tolist(), score[hit].tolist(), which[hit].tolist(), strict=True):
                    best[doc] = min(best[doc], (-s, model.names[k]))
            words = np.concatenate([[0], np.cumsum(np.cumsum(lit[:-1]) > 0)])
            covered, n = words[p.ends[1:]] - words[p.ends[:-1]], np.diff(p.ends)
            named = np.array([bool(x and _NAMED.search(x)) for x in b.column("path").to_pylist()], dtype=bool)
            has = np.array([s < 0 for s, _ in best], dtype=bool)
            yield pa.RecordBatch.from_arrays(
                [b.column("fid"), b.column("path"), pa.array([x[1] if s else None for x, s in zip(best, has, strict=True)], pa.string()), pa.array([-x[0] if s else None for x, s in zip(best, has, strict=True)], pa.float64()), pa.array(has & (named | (covered >= HALF * n)))],
                names=["fid", "path", "license", "score", "whole"],
            )

    return run


def scan(files: DataFrame, least: float = LEAST, texts: list[tuple[str, str]] | None = None) -> DataFrame:
    """files (fid, path, text) with own license and score, and the license inherited, from which directory."""
    spark = files.sparkSession
    byte_batches(spark)
    base = scratch(spark)
    names, bodies = map(list, zip(*sorted(texts or templates()), strict=True))
    known = vocabulary(bodies)
    files = files.select("fid", F.col("path").cast("string").alias("path"), F.col("text").cast("string").alias("text"))
    counts = files.select("path", "text").mapInArrow(_holding(known), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # a row per term of the templates
    counts = {r["term"]: r["n"] for r in counts}
    model = Model(names, bodies, known, counts.pop(-1, 0), np.array([counts.get(i, 0) for i in range(len(known))], dtype=float))
    kind = files.select("fid").schema[0].dataType.simpleString()
    own = stored(files.mapInArrow(_own(model, least), f"fid {kind}, path string, license string, score double, whole boolean"), f"{base}/own")

    folder = F.when(F.instr("path", "/") > 0, F.regexp_replace("path", "/[^/]*$", "")).otherwise(F.when(F.col("path").isNotNull(), F.lit("")))
    dirs = own.where("whole AND path IS NOT NULL").select(folder.alias("above"), "license", "score", "path").groupBy("above").agg(F.min(F.struct((-F.col("score")).alias("s"), "path", "license")).alias("b")).select("above", F.col("b.license").alias("inherited"))
    dirs = stored(dirs, f"{base}/dirs")
    all_dirs = own.select(folder.alias("folder")).where("folder IS NOT NULL").distinct()
    parts = F.split("folder", "/")
    up = all_dirs.select("folder", F.explode(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")))).alias("above")).distinct()
    nearest = stored(up.join(dirs, "above").groupBy("folder").agg(F.max_by(F.struct("above", "inherited"), F.length("above")).alias("b")).select("folder", F.col("b.above").alias("inherited_from"), F.col("b.inherited").alias("inherited")), f"{base}/nearest")

    out = own.select("fid", "path", folder.alias("folder"), "license", "score").join(nearest, "folder", "left")
    return out.select("fid", "path", F.col("license").alias("own_license"), "score", "inherited", "inherited_from", F.coalesce("license", "inherited").alias("license"))


def op9_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files source/lang/doc_id."""
    docs = documents(spark, sf_dir).select(F.col("doc_id").alias("fid"), F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"), "text")
    return scan(docs).withColumnRenamed("fid", "doc_id")


def oracle() -> str:
    """The same scan as plain SQL; no path there ends in the name of a license file, so whole texts are no parts."""
    values = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in templates())
    words = f"regexp_extract_all(translate({{x}}, '{_UPPER}', '{_LOWER}'), '([a-z0-9]|[^\\x00-\\x7F])+')"
    terms = "list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))"
    return f"""
WITH f AS (SELECT row_number() OVER () AS r, doc_id, concat_ws('/', source, lang, doc_id) AS path, concat_ws('/', source, lang) AS folder, coalesce(text, '') AS text FROM documents),
s AS (SELECT r, string_split(text, chr(10)) AS xs FROM f),
l0 AS (SELECT r, unnest(xs) AS body, unnest(range(1, len(xs) + 1)) AS i FROM s),
l1 AS (SELECT r, i, {words.format(x="body")} AS ws, regexp_matches(body, '{COMMENT}') AS c FROM l0),
l2 AS (SELECT *, sum((len(ws) = 0)::INT) OVER (PARTITION BY r ORDER BY i) AS blk, sum((len(ws) > 0 AND NOT c)::INT) OVER (PARTITION BY r ORDER BY i) AS body FROM l1),
l AS (SELECT * FROM l2 WHERE len(ws) > 0),
p AS (SELECT r, 'line' AS kind, i AS k, ws FROM l
 UNION ALL SELECT r, 'block', blk, flatten(list(ws ORDER BY i)) FROM l GROUP BY r, blk HAVING count(*) > 1
 UNION ALL SELECT r, 'header', 0, flatten(list(ws ORDER BY i)) FROM l WHERE body = 0 GROUP BY r HAVING count(*) > 1),
v AS (SELECT row_number() OVER () AS key, ws FROM (SELECT DISTINCT ws FROM p)),
tp(license, txt) AS (VALUES {values}),
tw AS (SELECT row_number() OVER (ORDER BY license, txt) AS t, license, {words.format(x="txt")} AS ws FROM tp),
tt AS (SELECT t, license, term, count(*) AS tf FROM (SELECT t, license, unnest({terms}) AS term FROM tw) GROUP BY 1, 2, 3),
c AS (SELECT count(*)::DOUBLE AS n FROM l),
hold AS (SELECT term, count(*) AS n FROM (SELECT DISTINCT r, i, term FROM (SELECT r, i, unnest({terms}) AS term FROM l) SEMI JOIN tt USING (term)) GROUP BY 1),
idf AS (SELECT term, ln((1 + any_value(c.n)) / (1 + coalesce(any_value(hold.n), 0))) + 1 AS idf FROM tt LEFT JOIN hold USING (term), c GROUP BY term),
vw AS (SELECT key, term, count(*) * coalesce(any_value(idf), ln(1 + any_value(c.n)) + 1) AS w FROM (SELECT key, unnest({terms}) AS term FROM v) LEFT JOIN idf USING (term), c GROUP BY key, term),
vn AS (SELECT key, sqrt(sum(w * w)) AS norm FROM vw GROUP BY key),
ow AS (SELECT t, license, term, tf * idf AS w FROM tt JOIN idf USING (term)),
o AS (SELECT t, license, term, w / sqrt(sum(w * w) OVER (PARTITION BY t)) AS w FROM ow),
d AS (SELECT key, license, round(sum(vw.w * o.w) / any_value(norm), 9) AS score FROM vw JOIN o USING (term) JOIN vn USING (key) GROUP BY key, t, license),
best AS (SELECT key, license, score FROM d QUALIFY row_number() OVER (PARTITION BY key ORDER BY score DESC, license) = 1 AND score >= {LEAST}),
hit AS (SELECT p.r, p.kind, p.k, license, score FROM p JOIN v USING (ws) JOIN best USING (key)),
lit AS (SELECT l.r, sum(len(ws)) AS n, coalesce(sum(len(ws)) FILTER (WHERE EXISTS (SELECT 1 FROM hit WHERE hit.r = l.r AND ((kind = 'line' AND k = l.i) OR (kind = 'block' AND k = l.blk) OR (kind = 'header' AND l.body = 0)))), 0) AS covered FROM l GROUP BY l.r),
own AS (SELECT r, arg_min(license, (-score, license)) AS license, max(score) AS score FROM hit GROUP BY r),
dirs AS (SELECT folder AS above, arg_min(license, (-score, path, license)) AS inherited FROM own JOIN lit USING (r) JOIN f USING (r) WHERE covered >= {HALF} * n GROUP BY 1),
up AS (SELECT DISTINCT folder, unnest(['', split_part(folder, '/', 1), folder]) AS above FROM f),
near AS (SELECT folder, arg_max(above, length(above)) AS inherited_from, arg_max(inherited, length(above)) AS inherited FROM up JOIN dirs USING (above) GROUP BY 1)
SELECT f.doc_id, f.path, own.license AS own_license, own.score, near.inherited, near.inherited_from, coalesce(own.license, near.inherited) AS license
FROM f LEFT JOIN own USING (r) LEFT JOIN near ON near.folder = f.folder
"""
