import zlib

import numpy as np
import pytest

from claimloom.llm import licenses, quality


def held_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 4 == 2


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.train(docs, labels)
    known = {r["doc_id"]: r["quality"] for r in labels.collect()}
    rows = quality.score(docs, model).collect()
    assert len(rows) == docs.count()
    assert all(r["held_out"] == held_out(r["doc_id"]) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    test = [(r["predicted"], known[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in known]
    assert len(test) > 50 and np.mean([a == b for a, b in test]) >= 0.95
    kept = quality.keep(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] for r in rows)


def test_labels_of_held_out_rows_are_not_learned(spark, documents):
    ids = [r["doc_id"] for r in documents.select("doc_id").collect()]
    rows = [(i, 0 if held_out(i) else 1) for i in ids]
    model = quality.train(documents, spark.createDataFrame(rows, "doc_id long, quality int"))
    assert model.constant == 1.0


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None), (5, 0), (5, 0), (3, 1), (7, 0), (4, 1)], "doc_id long, quality int")
    model = quality.train(odd_docs, labels)
    scores = [r["score"] for r in quality.score(odd_docs, model).collect()]
    assert len(scores) == 10 and all(0 <= s <= 1 for s in scores)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality.score(odd_docs, quality.train(odd_docs, none)).collect()} == {1.0}
    assert quality.score(no_docs, quality.train(no_docs, labels)).count() == 0


def test_pairs_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3)).astype(np.float32)
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x, y, n_pairs=2)
    assert ((model.score(x) > 0.5) == y).mean() > 0.95
    assert {tuple(sorted(p[:2])) for p in model.pairs} >= {(0, 1)}


def test_measures_of_a_text():
    import pyarrow as pa

    got = dict(zip(quality.FEATURES, quality.measures(pa.array(["AB ab ab ab!\nXX", None, ""]))[0], strict=True))
    assert got["upper_share"] == pytest.approx(4 / 10) and got["repeat_share"] == pytest.approx(1 / 5)
    assert got["marked_words"] == pytest.approx(1 / 5) and got["distinct_share"] == pytest.approx(4 / 5)


def test_scan_and_inheritance(spark):
    rows = [
        (1, "LICENSE", "Released under\nthe MIT License."),
        (2, "a/COPYING", "Licensed under the Apache License, Version 2.0."),
        (3, "a/b/c/x.txt", "prose of no licence at all\nmore"),
        (4, "a/b/y.txt", "text\nThis work is licensed under the GNU General Public License, version 3.\nend"),
        (5, "d/z.txt", None),
        (6, None, "Released under the MIT License."),
        (7, "ab/z.txt", ""),
        (8, "a/b/c/x.txt", "prose of no licence at all\nmore"),
        (9, "LICENSE.txt.bak", "no"),
    ]
    files = spark.createDataFrame([(*r, "x") for r in rows], "id long, path string, text string, license string")
    got = {r["id"]: (r["own_license"], r["license"], r["license_from"]) for r in licenses.licenses(files).collect()}
    assert got == {
        1: ("MIT", "MIT", "LICENSE"), 2: ("Apache-2.0", "Apache-2.0", "a/COPYING"), 3: (None, "Apache-2.0", "a"), 4: ("GPL-3.0", "GPL-3.0", "a/b/y.txt"),
        5: (None, "MIT", ""), 6: (None, None, None), 7: (None, "MIT", ""), 8: (None, "Apache-2.0", "a"), 9: (None, "MIT", ""),
    }
    assert licenses.licenses(files.limit(0)).count() == 0


def test_filters_lose_no_block(spark):
    """Cosines by hand for all lines, above and below the threshold."""
    import math
    import random
    from collections import Counter

    idf, unknown, unit = licenses.weights(licenses.TEMPLATES)
    rng = random.Random(1)
    lines = []
    for k in range(300):
        words = rng.choice(licenses.TEMPLATES)[1].split()
        for _ in range(rng.randrange(6)):
            words.insert(rng.randrange(len(words)), rng.choice(["foo", "the", "bar", "version", "public"]))
        lines.append((k, f"d/{k}", " ".join(w for w in words if rng.random() < 0.85)))
    want = {}
    for k, path, text in lines:
        c = Counter(licenses.words(text))
        length = math.sqrt(sum((n * idf[t]) ** 2 if t in idf else n * unknown**2 for t, n in c.items()))
        scores = [(round(sum(c[t] * idf[t] * x for t, x in w.items()) / length, 6) if length else 0, -i) for i, w in enumerate(unit)]
        if max(scores)[0] >= 0.7:
            want[path] = (licenses.TEMPLATES[-max(scores)[1]][0], max(scores)[0])
    got = {r["path"]: (r["license"], r["score"]) for r in licenses.scan(spark.createDataFrame(lines, "id long, path string, text string")).collect()}
    assert got.keys() == want.keys() and 50 < len(got) < 300
    assert all(got[p][0] == want[p][0] and got[p][1] == pytest.approx(want[p][1], abs=2e-6) for p in got)


def test_full_texts_headers_and_tags(spark):
    """Licence files, commented headers and SPDX tags, none of them a one-line notice."""
    gnu = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU {} as published by\nthe Free Software Foundation, either version {} of the License, or\n(at your option) any later version."
    texts = dict(licenses.bodies())
    body = "\n\n".join(texts["MIT"].strip().split("\n\n")[-3:])  # without title and copyright
    comment = lambda t: "/*\n" + "\n".join(f" * {x}" for x in t.split("\n")) + "\n */\nint main() { return 0; }"
    rows = [(f"{k}/LICENSE", t, k) for k, t in texts.items()] + [
        ("body/COPYING", body, "MIT"),
        ("src/mit.c", comment("Copyright (c) 2020 Someone Else\n\n" + body), "MIT"),
        ("src/gpl3.c", comment("Frob the widgets.\n\n" + gnu.format("General Public License", "3")), "GPL-3.0"),
        ("src/gpl2.c", comment(gnu.format("General Public License", "2")), "GPL-2.0"),
        ("src/agpl.c", comment(gnu.format("Affero General Public License", "3")), "AGPL-3.0"),
        ("agpl/LICENSE", texts["GPL-3.0"].replace("GNU GENERAL", "GNU AFFERO GENERAL", 1).replace("29 June", "19 November", 1).replace("GNU General Public License as published", "GNU Affero General Public License as published"), "AGPL-3.0"),
        ("src/apache.py", "# Licensed under the Apache License, Version 2.0 (the \"License\");\n# you may not use this file except in compliance with the License.\n# You may obtain a copy of the License at\n#\n#     http://www.apache.org/licenses/LICENSE-2.0\n#\nimport os", "Apache-2.0"),
        ("src/tag.rs", "// SPDX-License-Identifier: GPL-2.0-or-later\nfn main() {}", "GPL-2.0"),
        ("src/tags.rs", "// SPDX-License-Identifier: (Zlib OR MIT)\nfn main() {}", "Zlib"),
        *[("src/twice.c", comment("Copyright (c) 2021 Someone\n\n" + body), "MIT")] * 3,
        ("plain/x.txt", "A paragraph of prose about the public, a license and\nthe terms of a conversation.\n\nAnother one.", None),
    ]
    files = spark.createDataFrame([(i, p, t) for i, (p, t, _) in enumerate(rows)], "id long, path string, text string")
    got = {r["path"]: r["own_license"] for r in licenses.licenses(files).collect()}
    assert got == {p: k for p, _, k in rows}
    assert len(texts) == 13
