import hashlib
import pathlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import exact, licenses

DOCS = "doc_id long, text string, digest string, kept int"


def expected(rows):
    groups = defaultdict(list)
    for doc, text in rows:
        groups[re.sub("[\x20\x09-\x0d]", "", text or "")].append((-len(text or ""), doc))
    out = []
    for body, members in groups.items():
        keep = min(members)[1]
        out += [(doc, keep, len(members), doc == keep, hashlib.sha256(body.encode()).hexdigest()) for _, doc in members]
    return sorted(out)


ROWS = [(1, "a b"), (2, "ab"), (3, "a\x0b  b"), (4, None), (5, ""), (6, " \n"), (7, "a b"), (8, "z" * 200_000), (9, "z" * 200_000 + " "), (10, "A b"), (11, "z" * 200_000)]


@pytest.mark.parametrize("weak", [False, True])
def test_exact_equals_brute_force_even_with_a_weak_digest(spark, weak):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in ROWS], DOCS)
    # every text has the same key: only the full texts tell them apart
    got = exact.exact_duplicates(df, digest=F.lit("same") if weak else None)
    assert sorted(map(tuple, got.collect())) == expected(ROWS)


def test_state_goes_on_from_batch_to_batch(spark):
    rows = [(i, f"t{i % 7}") for i in range(60)]
    df = spark.createDataFrame([(d, t, "", 0) for d, t in rows], DOCS).repartition(6)
    assert sorted(map(tuple, exact.exact_duplicates(df, files_per_batch=1).collect())) == expected(rows)


def test_exact_empty_and_repeated(spark):
    assert exact.exact_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    got = exact.exact_duplicates(spark.createDataFrame([(3, "q", "", 0)] * 2 + [(None, "r", "", 0)], DOCS)).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got if r.doc_id) == [(3, 3, 2, True)] * 2
    assert len(got) == 3


def test_settings_come_back(spark):
    before = {k: spark.conf.get(k, None) for k in exact._STATE}
    exact.exact_duplicates(spark.createDataFrame([(1, "a", "", 0)], DOCS)).count()
    assert before == {k: spark.conf.get(k, None) for k in exact._STATE}


def test_licenses(spark):
    mit = licenses.KNOWN[0][1]
    varied = "Copyright (c) 2020 Somebody\n\n" + mit.upper().replace(",", "").replace("  ", " ").replace("SUBLICENSE", "SUB-LICENCE".replace("LICENCE", "license"))
    rows = [
        (1, mit, "", 0), (2, varied, "", 0), (3, mit + " And more.", "", 0), (4, None, "", 0), (5, "", "", 0), (6, "first line\nReleased under the MIT Licence.\nLicensed under CC BY-NC 4.0.", "", 0),
        (7, "Released under the MIT License.", "", 0), (7, "Released under the MIT License.", "", 0), (8, "x " * 100_000, "", 0),
    ]
    got = licenses.scan_licenses(spark.createDataFrame(rows, DOCS), licenses.known_digests(spark)).collect()
    assert sorted((r.doc_id, r.license_id, r.line_licenses) for r in got if r.doc_id in (1, 2)) == [(1, "MIT", ""), (2, "MIT", "")]
    assert sorted((r.doc_id, r.license_id or "", r.line_licenses) for r in got if r.doc_id > 2) == [
        (3, "", ""), (4, "", ""), (5, "", ""), (6, "", "CC-BY-NC-4.0,MIT"), (7, "MIT", "MIT"), (7, "MIT", "MIT"), (8, "", ""),
    ]
    assert licenses.scan_licenses(spark.createDataFrame([], DOCS), licenses.known_digests(spark)).count() == 0


def test_head_lines_and_copyright_forms(spark):
    mit = licenses.KNOWN[0][1]
    heads = ["# Copyright (c) 2020 X", "// Copyright 2020 X", " * Copyright John Doe 2020", "Copyright: 2020", "The MIT License\n\nCopyright (C) 2019, 2020 X", "MIT License\n\n(c) X\nAll rights reserved."]
    rows = [(i, f"{h}\n\n{mit}", "", 0) for i, h in enumerate(heads)] + [(90, "We hold the copyright of this text. " + mit, "", 0)]
    got = {r.doc_id: r.license_id for r in licenses.scan_licenses(spark.createDataFrame(rows, DOCS), licenses.known_digests(spark)).collect()}
    assert got == {**{i: "MIT" for i in range(len(heads))}, 90: None}


def test_whole_licence_files(spark):
    folder = pathlib.Path("/usr/share/common-licenses")
    files = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    there = [f for f in files if (folder / f).exists()]
    if not there:
        pytest.skip("no licence files on this system")
    # other line breaks, case and marks
    rows = [(i, re.sub(r"[ \t]+", "  ", (folder / f).read_text()).upper() if f == "MPL-2.0" else (folder / f).read_text().replace("\n", "\r\n"), "", 0) for i, f in enumerate(there)]
    got = {there[r.doc_id]: r.license_id for r in licenses.scan_licenses(spark.createDataFrame(rows, DOCS), licenses.known_digests(spark)).collect()}
    assert got == {f: files[f] for f in there}
