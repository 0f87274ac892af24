"""Licence scans: sparse TF-IDF cosine to templates, then inheritance along paths.

Three sets of templates, each with an idf of its own, and SPDX tags:

* one-line notices (TEMPLATES) against every line of a file, and against the whole text of a
  licence file (by its name);
* titles and standard headers (HEADERS) against every paragraph: lines between lines without
  a letter or digit, so comment signs take no part;
* full texts (``license_texts``, one file a licence) against the whole text of a licence file;
* ``SPDX-License-Identifier:`` counts as 1; its first identifier is taken, without -only,
  -or-later or +.

A block's vector has tf * idf for the templates' terms, with idf = ln((1 + N) / (1 + df)) + 1 over
the N templates; each other word is a dimension of its own with the idf of df = 0. For lines two
filters come before any join, and neither loses a block at the threshold:

* the known terms that a block has at all bound its cosine with any template;
* the share of the known terms in a block's length bounds it too.

What remains is exploded by term and joined with the templates' postings. Paragraphs and full
texts have too many terms for that: their known words are exploded and counted by hash. A file's licence
is its best block's. A file without one inherits from the nearest directory upwards that has a
licence file with a licence: directories are exploded into their ancestors and joined.

All of it is DataFrame expressions.

Defined results: null and empty texts have no licence of their own; a null path inherits
nothing; rows of one path are one file, and its licence is that of the best block of any of
them; ties go to notices, headers, full texts and SPDX tags in this order,
then to the template that is named first, then to the smaller file name; extra
columns take no part; no rows give no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import cache
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored

# Licence notices as their publishers word them.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("GPL-2.0", "This program is licensed under the GNU General Public License, version 2."),
    ("LGPL-2.1", "This library is licensed under the GNU Lesser General Public License, version 2.1."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted."),
    ("ISC", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
_GNU = "This program is free software{c} you can redistribute it and/or modify it under the terms of the GNU {k} as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version."
_CC = "This work is licensed under a Creative Commons {k} 4.0 International License."
# Titles and first paragraphs of standard headers.
HEADERS = (
    ("MIT", "MIT License"),
    ("MIT", "The MIT License (MIT)"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-3.0", _GNU.format(c=":", k="General Public License", v="3")),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-2.0", _GNU.format(c=";", k="General Public License", v="2")),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-3.0", _GNU.replace("program", "library").format(c=":", k="Lesser General Public License", v="3")),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-2.1", _GNU.replace("program", "library").format(c=";", k="Lesser General Public License", v="2.1")),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("AGPL-3.0", _GNU.format(c=":", k="Affero General Public License", v="3")),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("ISC", "ISC License"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("CC0-1.0", "CC0 1.0 Universal"),
    ("CC-BY-4.0", "Attribution 4.0 International"),
    ("CC-BY-4.0", _CC.format(k="Attribution")),
    ("CC-BY-SA-4.0", "Attribution-ShareAlike 4.0 International"),
    ("CC-BY-SA-4.0", _CC.format(k="Attribution-ShareAlike")),
    ("CC-BY-NC-4.0", "Attribution-NonCommercial 4.0 International"),
    ("CC-BY-NC-4.0", _CC.format(k="Attribution-NonCommercial")),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
SPDX = r"SPDX-License-Identifier:[ \t]*\(?[ \t]*([A-Za-z0-9][A-Za-z0-9.-]*)"
#: Ranks of the sets for ties: HEADERS, full texts and SPDX tags come after all notices.
HEADER_RANK, BODY_RANK, SPDX_RANK = 1000, 2000, 3000
LICENSE_FILE = r"(?i)^(licen[cs]e|copying|unlicense)(\.(txt|md|rst))?$"


@cache
def bodies() -> tuple[tuple[str, str], ...]:
    """Identifier and full text of each file of ``license_texts``."""
    return tuple((p.name.removesuffix(".txt"), p.read_text("utf-8")) for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt")))


def words(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def weights(templates) -> tuple[dict[str, float], float, list[dict[str, float]]]:
    """idf of each term, that of unknown words, and each template's terms with their weights over its length."""
    counts = [Counter(words(t)) for _, t in templates]
    n = len(counts)
    df = Counter(t for c in counts for t in c)
    idf = {t: math.log((1 + n) / (1 + k)) + 1 for t, k in df.items()}
    unit = []
    for c in counts:
        w = {t: k * idf[t] for t, k in c.items()}
        length = math.sqrt(sum(x * x for x in w.values()))
        unit.append({t: x / length for t, x in w.items()})
    return idf, math.log(1 + n) + 1, unit


def reach(unit: list[dict[str, float]]) -> dict[str, float]:
    """For each term the most that it adds to the square of a cosine with any template.

    By Cauchy and Schwarz a block's cosine is at most the root of the squares of the unit
    template's weights on the terms that the block has.
    """
    out: dict[str, float] = {}
    for w in unit:
        for t, x in w.items():
            out[t] = max(out.get(t, 0.0), x * x)
    return out


def _named(path: str = "path") -> Column:
    return F.element_at(F.split(path, "/"), -1).rlike(LICENSE_FILE)


def _texts(files: DataFrame) -> DataFrame:
    return files.where("path is not null and text is not null").select("path", F.col("text").cast("string").alias("text"))


def _candidates(scored: DataFrame, templates, threshold: float, rank: int = 0) -> DataFrame:
    """path, score, rank, license of the scores (path, template, score) at the threshold."""
    names = F.array(*[F.lit(k) for k, _ in templates])
    scored = scored.select("path", "template", F.round("score", 6).alias("score")).where(F.col("score") >= threshold)
    return scored.select("path", "score", (F.col("template") + rank).alias("rank"), F.element_at(names, F.col("template") + 1).alias("license"))


def _best(candidates: DataFrame) -> DataFrame:
    best = candidates.groupBy("path").agg(F.max_by("license", F.struct("score", -F.col("rank"))).alias("license"), F.max("score").alias("score"))
    return best.select("path", "license", "score")


def _blocks_scored(lines: DataFrame, templates, threshold: float) -> DataFrame:
    """path, template, score of the blocks (path, line, block) that can reach the threshold."""
    spark = lines.sparkSession
    idf, unknown, unit = weights(templates)
    known = F.array(*[F.lit(t) for t in sorted(idf)])
    table = lambda d: F.create_map(*[F.lit(x) for t in sorted(d) for x in (t, d[t])])
    idf_of, reach_of = table(idf), table(reach(unit))
    # a generator of one row each: what it gives is computed once, and no filter on it is pushed below and computes it again
    lines = lines.select("path", "line", F.explode(F.array(F.split(F.lower("block"), "[^a-z0-9]+"))).alias("words"))
    lines = lines.select("path", "line", "words", F.explode(F.array(F.array_intersect("words", known))).alias("present"))
    enough = F.aggregate("present", F.lit(0.0), lambda a, t: a + reach_of[t]) >= threshold * threshold - 1e-9
    lines = lines.where((F.size("present") > 0) & enough)
    terms = F.transform("present", lambda t: F.struct(t.alias("term"), F.size(F.filter("words", lambda w: w == t)).alias("tf")))
    found = lines.select("path", "line", F.size(F.array_remove("words", "")).alias("n"), F.explode(F.array(terms)).alias("terms"))
    inside = F.aggregate("terms", F.lit(0.0), lambda a, t: a + (t["tf"] * idf_of[t["term"]]) * (t["tf"] * idf_of[t["term"]]))
    outside = (F.col("n") - F.aggregate("terms", F.lit(0), lambda a, t: a + t["tf"])) * F.lit(unknown * unknown)
    found = found.select("path", "line", "terms", inside.alias("inside"), outside.alias("outside"))
    found = found.where(F.col("inside") >= F.lit(threshold * threshold - 1e-9) * (F.col("inside") + F.col("outside")))
    sparse = found.select("path", "line", F.sqrt(F.col("inside") + F.col("outside")).alias("length"), F.explode("terms").alias("t"))
    sparse = sparse.select("path", "line", "length", F.col("t.term").alias("term"), F.col("t.tf").alias("tf"))
    postings = spark.createDataFrame([(t, i, x * idf[t]) for i, w in enumerate(unit) for t, x in w.items()], "term string, template int, share double")
    return sparse.join(F.broadcast(postings), "term").groupBy("path", "line", "template").agg((F.sum(F.col("tf") * F.col("share")) / F.first("length")).alias("score"))  # as long as the templates


def _notices(files: DataFrame, templates, threshold: float) -> DataFrame:
    blocks = F.split("text", "\n", -1)
    whole = F.array(F.translate("text", "\n\r", "  "))
    lines = _texts(files).select("path", F.monotonically_increasing_id().alias("of"), F.posexplode(F.when(_named(), F.concat(blocks, whole)).otherwise(blocks)).alias("nth", "block"))
    lines = lines.select("path", F.struct("of", "nth").alias("line"), "block")
    return _candidates(_blocks_scored(lines, templates, threshold), templates, threshold)


def _counted(blocks: DataFrame, templates) -> DataFrame:
    """path, template, score of long blocks (path, line, block): one row a known word, counted by hash."""
    idf, unknown, unit = weights(templates)
    shares = [(t, idf[t], [w.get(t, 0.0) * idf[t] for w in unit]) for t in sorted(idf)]
    postings = blocks.sparkSession.createDataFrame(shares, "term string, idf double, shares array<double>")
    split = blocks.select("path", "line", F.explode(F.array(F.array_remove(F.split(F.lower("block"), "[^a-z0-9]+"), ""))).alias("words"))
    each = split.select("path", "line", F.size("words").alias("n"), F.explode(F.filter("words", lambda w: w.isin(sorted(idf)))).alias("term"))
    counts = each.groupBy("path", "line", "n", "term").agg(F.count("*").alias("tf")).join(F.broadcast(postings), "term")
    dots = [F.sum(F.col("tf") * F.col("shares")[i]).alias(f"dot{i}") for i in range(len(unit))]
    sums = counts.groupBy("path", "line", "n").agg(F.sum((F.col("tf") * F.col("idf")) ** 2).alias("inside"), F.sum("tf").alias("inner"), *dots)
    length = F.sqrt(F.col("inside") + (F.col("n") - F.col("inner")) * F.lit(unknown * unknown))
    return sums.select("path", F.posexplode(F.array(*[F.col(f"dot{i}") / length for i in range(len(unit))])).alias("template", "score"))


def _headers(files: DataFrame, threshold: float) -> DataFrame:
    texts = _texts(files).select("path", F.monotonically_increasing_id().alias("of"), F.posexplode(F.split("text", r"\n[^a-zA-Z0-9\n]*\n", -1)).alias("nth", "block"))
    return _candidates(_counted(texts.select("path", F.struct("of", "nth").alias("line"), "block"), HEADERS), HEADERS, threshold, HEADER_RANK)


def _bodies(files: DataFrame, threshold: float) -> DataFrame:
    """Whole licence files against the full texts."""
    texts = _texts(files).where(_named()).select("path", F.monotonically_increasing_id().alias("line"), F.col("text").alias("block"))
    return _candidates(_counted(texts, bodies()), bodies(), threshold, BODY_RANK)


def _tags(files: DataFrame) -> DataFrame:
    """SPDX tags; identifiers of no template stand for themselves."""
    ids = {n.lower(): n for n, _ in (*TEMPLATES, *HEADERS, *bodies())}
    known = F.create_map(*[F.lit(x) for k in sorted(ids) for x in (k, ids[k])])
    found = _texts(files).where(F.col("text").contains("SPDX-License-Identifier:")).select("path", F.explode(F.regexp_extract_all("text", F.lit(SPDX), 1)).alias("tag"))
    tag = F.regexp_replace("tag", r"(-only|-or-later|\.+)$", "")
    return found.select("path", F.lit(1.0).alias("score"), F.lit(SPDX_RANK).alias("rank"), F.coalesce(known[F.lower(tag)], tag).alias("license"))


def scan(files: DataFrame, templates=TEMPLATES, threshold: float = 0.7) -> DataFrame:
    """path, license, score: the best notice of each path that has one at the threshold."""
    return _best(_notices(files, templates, threshold))


def scan_all(files: DataFrame, templates=TEMPLATES, threshold: float = 0.7) -> DataFrame:
    """path, license, score: the best of notices, headers, full texts and SPDX tags."""
    return _best(_notices(files, templates, threshold).unionByName(_headers(files, threshold)).unionByName(_bodies(files, threshold)).unionByName(_tags(files)))


def parent(path: Column) -> Column:
    """The directory of a path; that of a bare name is empty."""
    return F.regexp_replace(path, "(^|/)[^/]*$", "")


def inherit(files: DataFrame, own: DataFrame) -> DataFrame:
    """dir, inherited, inherited_from: the nearest licensed directory at or above each directory.

    ``files`` (path) names the directories, ``own`` (path, license, score) the files' licences.
    """
    licensed = own.where(F.element_at(F.split("path", "/"), -1).rlike(LICENSE_FILE))
    licensed = licensed.groupBy(parent(F.col("path")).alias("up")).agg(F.min_by("license", F.struct(-F.col("score"), F.col("path"))).alias("inherited"))
    dirs = files.where("path is not null").select(parent(F.col("path")).alias("dir")).distinct()
    parts = F.split("dir", "/")
    up = dirs.select("dir", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, 1, k), "/").alias("up")))).alias("a")).select("dir", "a.depth", "a.up")
    return up.join(licensed, "up").groupBy("dir").agg(F.max_by(F.struct("inherited", F.col("up").alias("inherited_from")), "depth").alias("x")).select("dir", "x.*")


def licenses(files: DataFrame, templates=TEMPLATES, threshold: float = 0.7) -> DataFrame:
    """Each file (id, path) with its own, its directory's and its effective licence."""
    own = stored(scan_all(files, templates, threshold), "licenses")  # used twice, scanned once
    above = inherit(files, own)
    rows = files.select("id", "path", parent(F.col("path")).alias("dir"))
    rows = rows.join(own.withColumnsRenamed({"license": "own_license", "score": "own_score"}), "path", "left").join(above, "dir", "left")
    origin = F.when(F.col("own_license").isNotNull(), F.col("path")).otherwise(F.col("inherited_from"))
    return rows.select("id", "path", "own_license", "own_score", "inherited", F.coalesce("own_license", "inherited").alias("license"), origin.alias("license_from"))


#: Where a document lies in the test tables: a tree of ten directories of ten of twenty files.
PATH_SQL = """
CASE WHEN doc_id % 2000 = 0 THEN concat('r', {q2000}, '/LICENSE')
     WHEN doc_id % 200 = 0 THEN concat('r', {q2000}, '/d', {q200} % 10, '/LICENSE')
     WHEN doc_id % 20 = 0 THEN concat('r', {q2000}, '/d', {q200} % 10, '/s', {q20} % 10, '/LICENSE')
     ELSE concat('r', {q2000}, '/d', {q200} % 10, '/s', {q20} % 10, '/f', doc_id, '.txt') END"""


def path_sql(divide: str) -> str:
    """The path expression with an engine's integer division."""
    return PATH_SQL.format(**{f"q{k}": f"(doc_id {divide} {k})" for k in (2000, 200, 20)})


def oracle_sql(threshold: float = 0.7, templates=TEMPLATES) -> str:
    """The query over ``documents`` in DuckDB's SQL."""
    rows = ", ".join(f"({i}, '{n}', '{t.replace(chr(39), chr(39) * 2)}')" for i, (n, t) in enumerate(templates))
    return f"""
WITH template(id, name, body) AS (VALUES {rows}),
tt AS (SELECT id, w AS term, count(*) AS tf FROM (SELECT id, unnest(regexp_extract_all(lower(body), '[a-z0-9]+')) AS w FROM template) GROUP BY 1, 2),
idf AS (SELECT term, ln((1.0 + (SELECT count(*) FROM template)) / (1.0 + count(*))) + 1 AS idf FROM tt GROUP BY 1),
tw AS (SELECT id, term, tf * idf AS w, sqrt(sum((tf * idf) * (tf * idf)) OVER (PARTITION BY id)) AS len FROM tt JOIN idf USING (term)),
files AS (SELECT doc_id, text, {path_sql('//')} AS path FROM documents),
cut AS (SELECT path, unnest(string_split(text, chr(10))) AS block, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM files
        UNION ALL SELECT path, replace(replace(text, chr(10), ' '), chr(13), ' '), 0 FROM files WHERE path LIKE '%LICENSE'),
tok AS (SELECT path, line, w AS term, count(*) AS tf FROM (SELECT path, line, unnest(regexp_extract_all(lower(block), '[a-z0-9]+')) AS w FROM cut) GROUP BY 1, 2, 3),
wt AS (SELECT path, line, term, CASE WHEN idf IS NULL THEN NULL ELSE tf * idf END AS w, CASE WHEN idf IS NULL THEN tf * (ln(1.0 + (SELECT count(*) FROM template)) + 1) * (ln(1.0 + (SELECT count(*) FROM template)) + 1) ELSE (tf * idf) * (tf * idf) END AS sq FROM tok LEFT JOIN idf USING (term)),
len AS (SELECT path, line, sqrt(sum(sq)) AS len FROM wt GROUP BY 1, 2),
scored AS (SELECT wt.path, wt.line, tw.id, round(sum(wt.w * tw.w / tw.len) / any_value(len.len), 6) AS score
           FROM wt JOIN tw ON wt.term = tw.term JOIN len ON len.path = wt.path AND len.line = wt.line GROUP BY 1, 2, 3),
best AS (SELECT path, name AS license, score FROM (SELECT path, id, score, row_number() OVER (PARTITION BY path ORDER BY score DESC, id) AS k FROM scored WHERE score >= {threshold}) JOIN template USING (id) WHERE k = 1),
lic AS (SELECT regexp_replace(path, '(^|/)[^/]*$', '') AS up, license AS inherited FROM best WHERE path LIKE '%LICENSE'),
dirs AS (SELECT DISTINCT regexp_replace(path, '(^|/)[^/]*$', '') AS dir FROM files),
near AS (SELECT dir, inherited, up, row_number() OVER (PARTITION BY dir ORDER BY length(up) DESC) AS k
         FROM dirs JOIN lic ON dir = up OR starts_with(dir, up || '/'))
SELECT doc_id, files.path, best.license AS own_license, best.score AS own_score, near.inherited,
       coalesce(best.license, near.inherited) AS license,
       CASE WHEN best.license IS NOT NULL THEN files.path ELSE near.up END AS license_from
FROM files LEFT JOIN best ON best.path = files.path
LEFT JOIN near ON near.k = 1 AND near.dir = regexp_replace(files.path, '(^|/)[^/]*$', '')"""
