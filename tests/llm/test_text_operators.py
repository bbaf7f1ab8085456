"""Line dedup, license scan, mixing, exact dedup and quality rules against brute force, with odd rows."""
import hashlib
import random
import re
import textwrap
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tarn.llm import exact_dedup, license_scan, line_dedup, mixing, quality_rules
from tests.llm.brute import TO_LOWER, WS

SCHEMA = "doc_id long, text string, lang string, source string, n_lines string, kept string, weight string"
WHITE = " \t\n\x0b\x0c\r"


def corpus(seed=1):
    rng = random.Random(seed)
    lines = ["Common line.", " common LINE.\t", "Été chaud", "été chaud", "", "  ", "ÉTÉ", *[f"line {i}" for i in range(40)]]
    rows = [(i, "\n".join(rng.choices(lines, k=rng.choice([1, 3, 9]))), rng.choice(["en", "de", None]), rng.choice(["a", "b", "", None]), "x", "y", None) for i in range(120)]
    rows += [(200, None, None, None, None, None, None), (201, "", "en", "a", "", "", ""), (None, "Common line.\nown", "en", "a", "", "", "")]
    rows += [rows[0], rows[0], (300, "very long " * 20_000 + "\nCommon line.", "en", "a", "", "", "")]
    return rows


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs"))
    spark.createDataFrame(corpus(), SCHEMA).repartition(3).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def test_line_dedup(docs):
    rows = corpus()
    cut = [(r[0], (r[1] or "").split("\n")) for r in rows]
    key = lambda x: x.strip(WHITE).translate(TO_LOWER)
    count = Counter(k for _, k in {(d, key(x)) for d, ls in cut for x in ls} if k)
    want = []
    for d, ls in cut:
        left = [x for x in ls if not key(x) or count[key(x)] < 10]
        want.append((d, len(ls), len(ls) - len(left), "\n".join(left)))
    out = line_dedup.drop_common_lines(docs)
    assert set(out.columns) == set(docs.columns) | {"n_dropped"}
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in out.collect()) == Counter(want)
    assert line_dedup.drop_common_lines(docs.limit(0)).count() == 0


def test_line_dedup_counts_documents(spark):
    """Rows of one id are one document, also with other texts; rows without id are told apart by their texts."""
    rows = [(1, "same\na"), (1, "b\nsame"), (1, "same\na"), (2, "x\nsame"), (None, "z\nother"), (None, "z\nother"), (3, "y\nother")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.text) for r in line_dedup.drop_common_lines(docs, min_docs=2).collect())
    assert got == Counter([(1, "a"), (1, "b"), (1, "a"), (2, "x"), (None, "z"), (None, "z"), (3, "y")])
    assert all(r.n_dropped == 0 for r in line_dedup.drop_common_lines(docs, min_docs=3).collect())


def test_line_dedup_of_long_documents(spark):
    """Many common lines in one document cost no more than their number."""
    text = "\n".join(f"common {i}" for i in range(60_000))
    docs = spark.createDataFrame([(i, text + f"\nown {i}") for i in range(3)], "doc_id long, text string")
    start = time.perf_counter()
    assert sorted(r.text for r in line_dedup.drop_common_lines(docs, min_docs=3).collect()) == [f"own {i}" for i in range(3)]
    assert time.perf_counter() - start < 60


def test_exact_dedup(spark, docs):
    rows = corpus()
    size = Counter(r[1] or "" for r in rows)
    top = {}
    for r in rows:
        top[r[1] or ""] = max(top.get(r[1] or "", -1), -1 if r[0] is None else r[0])
    out = exact_dedup.groups_of(docs).collect()
    assert len(out) == len(rows) and sum(r.kept for r in out) == len(size)
    assert all((r.keep_id if r.keep_id is not None else -1) == top[r.text or ""] and r.group_size == size[r.text or ""] for r in out)
    left = exact_dedup.deduplicate(docs)
    assert left.columns == docs.columns
    assert Counter(r.text or "" for r in left.collect()) == Counter(set(size))
    made = exact_dedup.deduplicate(spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "doc_id long, text string"))
    assert sorted(r.doc_id for r in made.collect()) == [2, 3]
    assert exact_dedup.deduplicate(docs.limit(0)).count() == 0


def test_exact_dedup_of_rows_that_are_not_a_whole_folder(spark, tmp_path):
    """One file of a folder, a filter, a join and a limit; names that clash; a path of pattern characters."""
    folder = str(tmp_path / "t")
    schema = "doc_id long, text string, keep_id string, _file string, group_size int"
    for rows in ([(1, "x"), (2, "y")], [(3, "x"), (4, "y")]):
        spark.createDataFrame([(*r, "k", "f", 7) for r in rows], schema).coalesce(1).write.mode("append").parquet(folder)
    docs = spark.read.parquet(folder)
    ids = lambda df: sorted(r.doc_id for r in df.collect())
    assert ids(exact_dedup.deduplicate(docs)) == [3, 4]
    one = spark.read.parquet(docs.inputFiles()[0])
    assert ids(exact_dedup.deduplicate(one)) == ids(one)
    assert ids(exact_dedup.deduplicate(docs.where("doc_id < 4"))) == [2, 3]
    twice = docs.join(spark.range(2).withColumnRenamed("id", "n"))
    assert ids(exact_dedup.deduplicate(twice)) == [3, 4]
    out = exact_dedup.deduplicate(docs)
    assert out.columns == docs.columns and {(r.keep_id, r._file, r.group_size) for r in out.collect()} == {("k", "f", 7)}
    odd = str(tmp_path / "a[1]{x}")
    docs.write.parquet(odd)
    assert ids(exact_dedup.deduplicate(spark.read.parquet(odd.replace("[", "\\[").replace("]", "\\]").replace("{", "\\{").replace("}", "\\}")))) == [3, 4]


def test_exact_dedup_tells_texts_of_one_digest_apart(docs, monkeypatch, spark):
    """With a digest that all texts share, whole bytes decide."""
    monkeypatch.setattr(exact_dedup.F, "unhex", lambda c: F.lit(b"\0" * 32))
    monkeypatch.setattr(exact_dedup, "_false_hits", lambda docs, groups, text_col: groups.where("group_size > 1").select("_digest").distinct())
    rows = exact_dedup.deduplicate(docs)
    assert rows.count() == len({r[1] or "" for r in corpus()})


def test_license_scan(spark):
    rows = [
        (1, "Intro.\nLicensed under the Apache License, Version 2.0.\nYou may obtain a copy of the License at: x", "old"),
        (2, "Neither. Released under the  MIT License.", "old"),
        (3, "This is a license text of ours.\nAll rights reserved.", None),
        (4, None, None), (5, "", ""), (6, "Released under the MIT License.\n" * 3000, ""), (6, "nothing", ""),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, license string")
    got = Counter((r.doc_id, r.sentence_ids[:3], r.n_sentences, r.license) for r in license_scan.scan(docs).collect())
    assert got == Counter([(1, "BC", 2, "Apache-2.0"), (2, "E", 1, "MIT"), (3, "Q", 1, "Proprietary"), (4, "", 0, None), (5, "", 0, None), (6, "EEE", 3000, "MIT"), (6, "", 0, None)])
    assert license_scan.scan(docs.limit(0)).count() == 0


APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License."""
GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one."""
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."""
BSD2 = """Copyright (c) 2020 X. All rights reserved.

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
BSD3 = BSD2 + """

3. Neither the name of Some Firm Inc. nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
CC = "This work is licensed under a Creative Commons Attribution{} 4.0 International License."
ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
ZLIB = """This software is provided 'as-is', without any express or implied warranty.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"""
EPL = "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at the address below."
NOTICES = [
    ("Apache-2.0", APACHE, "BCD"), ("GPL-3.0-or-later", GPL, "O"), ("MPL-2.0", MPL, "P"), ("MIT", MIT, "FG"), ("BSD-2-Clause", BSD2, "QKLM"), ("BSD-3-Clause", BSD3, "QKLMN"),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3.", "A"), ("CC-BY-4.0", CC.format(""), "I"), ("CC-BY-NC-4.0", CC.format("-NonCommercial"), "H"),
    ("CC-BY-SA-4.0", CC.format("-ShareAlike"), "J"), ("Unlicense", "This is free and unencumbered software released into the public domain.", "R"), ("Proprietary", "All rights reserved.", "Q"),
    ("GPL-2.0-or-later", GPL.replace("version 3", "version 2"), "S"), ("LGPL-2.1-or-later", GPL.replace("version 3", "version 2.1").replace("GNU G", "GNU Lesser G").replace("program", "library"), "T"),
    ("LGPL-3.0-or-later", GPL.replace("GNU G", "GNU Lesser G"), "U"), ("AGPL-3.0-or-later", GPL.replace("GNU G", "GNU Affero G"), "V"), ("ISC", ISC, "W"), ("Zlib", ZLIB, "Y"), ("EPL-2.0", EPL, "X"),
    ("GPL-2.0-only", "Licensed under the GPL version 2.", "Z"), ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause", "a"), ("MIT", "SPDX-License-Identifier: MIT", "E"),
    ("Apache-2.0|MIT", "Licensed under the Apache License, Version 2.0.\n\nReleased under the MIT License.\n\nAll rights reserved.", "BEQ"),
]


def test_license_scan_of_wrapped_notices(spark):
    """Each rule on its licence's own words, on one line, wrapped, and inside comment marks."""
    rows = []
    for name, text, ids in NOTICES:
        for width in (10_000, 78, 40 if "SPDX" not in text else 78):
            for mark in ("", " * ", "# ", "// "):
                lines = [x for part in text.split("\n\n") for x in [*textwrap.wrap(part, width), ""]]
                rows.append((f"{name} {ids} {width} {mark}", "\n".join((mark + x).rstrip() for x in lines) + "\ncode()", name, ids))
    rows.append(("no", "This is not under\nthe MIT License at all", None, ""))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id string, text string")
    out = license_scan.scan(docs).collect()
    assert {r.doc_id: (r.licenses, r.sentence_ids) for r in out} == {d: (name or "", ids) for d, _, name, ids in rows}
    assert all(r.license == (r.licenses.split("|")[0] or None) for r in out)
    odd = spark.createDataFrame([(1, "All rights  reserved."), (2, "x. All rights-reserved.")], "doc_id long, text string")
    assert {r.license for r in license_scan.scan(odd).collect()} == {"Proprietary"}


def brute_mix(rows):
    """{(source, lang, topic): (weight, probability)} by plain raking."""
    cells = Counter()
    for _, text, lang, source, *_ in rows:
        n = len(re.findall(WS, text or ""))
        cells[source or "", lang or "", "short" if n < mixing.MEDIUM else "medium" if n < mixing.LONG else "long"] += max(n, 1)
    total = sum(cells.values())
    weight = {c: t / total for c, t in cells.items()}
    target = []
    for d in range(3):
        share = Counter()
        for c, t in cells.items():
            share[c[d]] += t / total
        power = {v: s**mixing.POWER for v, s in share.items()}
        target.append({v: p / sum(power.values()) for v, p in power.items()})
    for _ in range(mixing.SWEEPS):
        for d in range(3):
            have = Counter()
            for c, w in weight.items():
                have[c[d]] += w
            weight = {c: w * target[d][c[d]] / have[c[d]] for c, w in weight.items()}
    most = max(w / cells[c] for c, w in weight.items())
    return {c: (w, w / cells[c] / most) for c, w in weight.items()}


def test_mixing(docs):
    want = brute_mix(corpus())
    out = mixing.mixed(docs).collect()
    assert len(out) == len(corpus())
    for r in out:
        weight, probability = want[r.source or "", r.lang or "", r.topic]
        assert r.weight == pytest.approx(weight) and r.probability == pytest.approx(probability)
        u = int(hashlib.md5(("" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()[:13], 16) / 16**13
        assert r.kept == (u < r.probability)
    assert max(r.probability for r in out) == pytest.approx(1)
    assert mixing.mixed(docs.limit(0)).count() == 0


def test_mixing_is_not_starved_by_a_rare_cell(spark):
    """One row of a null source and language must not scale down all others."""
    rows = [(i, "w " * 200, "en", "a" if i % 3 else "b") for i in range(3000)] + [(9000, "w " * 100, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    plain = brute_mix(rows)
    assert sum(plain[s or "", la or "", "medium" if s else "short"][1] for _, _, la, s in rows) < 0.1 * len(rows)
    out = mixing.mixed(docs).collect()
    assert sum(r.probability for r in out) == pytest.approx(mixing.LEAST_SHARE * len(rows))
    assert sum(r.kept for r in out) == pytest.approx(mixing.LEAST_SHARE * len(rows), rel=0.1)
    p = {r.source: (r.probability, r.weight / r.n_tokens) for r in out}
    assert p[None][0] == 1 and all(0 < x <= 1 for x, _ in p.values())
    tokens = {s: sum(200 for r in rows if r[3] == s) for s in "ab"}
    assert p["a"][0] * tokens["a"] / (p["b"][0] * tokens["b"]) == pytest.approx(plain["a", "en", "medium"][0] / plain["b", "en", "medium"][0])


def brute_base(text):
    words = re.findall(WS, text or "")
    at = {}
    for i in range(len(words) - 2):
        at.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {i + k for ps in at.values() if len(ps) > 1 for i in ps for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(WS, x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(spark, docs):
    rng = random.Random(3)
    sound = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "of", "the", "Tau"]) + str(rng.randrange(900)) for _ in range(rng.choice([60, 200]))), "en", rng.choice("ab")) for i in range(300)]
    odd = [(1000 + i, " ".join(f"W{rng.randrange(9999)}***" for _ in range(90)), "en", "a") for i in range(5)]
    some = spark.createDataFrame(sound + odd, "doc_id long, text string, lang string, source string")
    out = {r.doc_id: r for r in quality_rules.judged(some).collect()}
    assert all(out[r[0]].kept for r in sound) and not any(out[r[0]].kept for r in odd)
    got = quality_rules.judged(docs.drop("kept"))
    rows = [tuple(r[c] for c in quality_rules.BASE) for r in got.collect()]
    assert Counter(rows) == Counter(brute_base(r[1]) for r in corpus())
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept) for r in got.collect())
    assert quality_rules.judged(docs.limit(0)).count() == 0


def test_quality_rules_of_small_groups(spark):
    """Junk of a rare source or language is judged by its language's or all rows' estimate, not by itself."""
    rng = random.Random(4)
    prose = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "of", "the", "Tau"]) + str(rng.randrange(900)) for _ in range(rng.choice([60, 200])))
    junk = lambda: " ".join(f"W{rng.randrange(9999)}***" for _ in range(90))
    sound = [(i, prose(), "en", "a") for i in range(200)] + [(300, prose(), "en", "rare"), (301, prose(), "xx", "rare")]
    odd = [(1000, junk(), "en", "one"), (1001, junk(), "yy", None), *[(1100 + i, junk(), "en", "junk") for i in range(20)]]
    out = {r.doc_id: r for r in quality_rules.judged(spark.createDataFrame(sound + odd, "doc_id long, text string, lang string, source string")).collect()}
    assert len(out) == len(sound + odd) and not any(r.base_failed for r in out.values())
    assert all(out[r[0]].kept for r in sound) and not any(out[r[0]].kept for r in odd)


def test_chi_square():
    assert quality_rules.chi2_quantile(0.95, 5) == pytest.approx(11.0705, abs=1e-3)
    assert quality_rules.chi2_quantile(0.5, 3) == pytest.approx(2.36597, abs=1e-4)
