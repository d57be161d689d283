import textwrap
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from tests.llm.conftest import with_clashes

from lumenframe.llm import licenses
from lumenframe.llm.license_texts import KNOWN_LICENSES


def scan(spark, rows):
    return {r["doc_id"]: r for r in licenses.scan_licenses(with_clashes(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}


def test_known_texts_in_other_dress(spark):
    rows = []
    for i, (_, text) in enumerate(KNOWN_LICENSES):
        rows.append((3 * i, text))
        rows.append((3 * i + 1, "Copyright (c) 2020-2024 Jane Doe <jane@example.org>\nAll rights reserved.\n\n" + text.upper().replace(" ", "  ")))
        rows.append((3 * i + 2, "\n".join(f" * {line}" for line in text.replace("License", "Licence").replace("license", "licence").split("\n"))))
    found = scan(spark, rows)
    for i, (name, _) in enumerate(KNOWN_LICENSES):
        assert [found[3 * i + k]["license_id"] for k in range(3)] == [name] * 3


def test_notices_and_near_misses(spark):
    found = scan(
        spark,
        [
            (1, "Some prose.\nReleased under the MIT License.\nMore.\nlicensed under the apache licence, version 2.0"),
            (2, "Released under the MIT License, or so."),
            (3, None),
            (4, ""),
            (5, "!!!\n..."),
            (6, "Released under the MIT License."),
            (6, "Released under the MIT License."),
            (7, "copyright notice and this permission notice shall be kept"),
            (8, "word " * 100_000),
            (None, "Licensed under CC BY 4.0."),
        ],
    )
    assert (found[1]["license_id"], found[1]["notice_lines"], found[1]["notices"]) == (None, 2, "Apache-2.0,MIT")
    assert found[2]["license_id"] is None and found[2]["notice_lines"] == 0
    assert found[3]["digest"] == found[4]["digest"] == found[5]["digest"] and found[3]["license_id"] is None
    assert found[6]["license_id"] == "MIT" and found[6]["notice_lines"] == 0
    assert found[7]["digest"] != found[4]["digest"]
    assert found[None]["license_id"] == "CC-BY-4.0"


def test_native_and_empty(spark, edge_docs, no_docs):
    plan = licenses.scan_licenses(edge_docs)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))
    assert licenses.scan_licenses(no_docs).count() == 0


HEADERS = [
    "Copyright OpenJS Foundation and other contributors",
    "Copyright Jane Doe 2020",
    "Copyright: 2020 X",
    "COPYRIGHT: Jane Doe",
    "Copyright the Example Authors.",
    "// Copyright OpenJS Foundation",
    "Copyright (c) 2020 The Regents of the\n    University of California.",
    "Copyright (c) 2020 Jane Doe,\n              John Roe",
    "Copyright (c) 2020\n  Jane Doe\n",
    "Copyright OpenJS Foundation\nCopyright 2019 Jane Doe and\n  others",
]


def test_copyright_headers_of_many_forms(spark):
    own = [(name, text) for name, text in KNOWN_LICENSES if "\n\n" in text]
    rows, names = [], []
    for name, text in own:
        for header in HEADERS:
            names.append(name)
            rows.append((len(rows), header + "\n\n" + text))
    found = scan(spark, rows)
    assert [found[i]["license_id"] for i in range(len(rows))] == names


def test_sentences_on_copyright_stay_however_wrapped(spark):
    rows, names = [], []
    for name, text in KNOWN_LICENSES:
        for width in (1, 20, 33, 47, 60, 72):
            names.append(name)
            rows.append((len(rows), "\n".join(textwrap.wrap(" ".join(text.split()), width, break_long_words=False, break_on_hyphens=False))))
    found = scan(spark, [*rows, (9000, "Copyright 2020\nReleased under the MIT License.\n\nprose")])
    assert [found[i]["license_id"] for i in range(len(rows))] == names
    assert found[9000]["notices"] == "MIT"


COMMON = Path("/usr/share/common-licenses")
FULL = {"Apache-2.0": "Apache-2.0", "CC0-1.0": "CC0-1.0", "GPL-2": "GPL-2.0-only", "GPL-3": "GPL-3.0-only", "LGPL-2.1": "LGPL-2.1-only", "LGPL-3": "LGPL-3.0-only", "MPL-2.0": "MPL-2.0"}


@pytest.mark.skipif(not COMMON.is_dir(), reason="the system's licence texts are not there")
def test_full_texts_from_outside(spark):
    texts = [(name, (COMMON / file).read_text()) for file, name in FULL.items()]
    rows = [(i, text.upper() if i % 2 else text.replace("\n", "\n # ")) for i, (_, text) in enumerate(texts)]
    found = scan(spark, [*rows, (100, texts[0][1] + "\nand one more condition")])
    assert [found[i]["license_id"] for i in range(len(rows))] == [name for name, _ in texts]
    assert found[100]["license_id"] is None


def test_usual_notices(spark):
    found = scan(spark, [(1, "x\nSPDX-License-Identifier: GPL-2.0\n// spdx-license-identifier: MPL-2.0"), (2, "This project is licensed under the MIT License."), (3, "x\nDistributed under the Boost Software License, Version 1.0.\n")])
    assert found[1]["notices"] == "GPL-2.0-only,MPL-2.0" and found[2]["license_id"] == "MIT" and found[3]["notices"] == "BSL-1.0"


def test_callers_digests_of_any_size(spark, edge_docs, monkeypatch):
    known = edge_docs.where("doc_id is not null").select(licenses.digest(licenses.plain(F.col("text"))).alias("known_digest"), F.col("doc_id").cast("string").alias("license_id")).groupBy("known_digest").agg(F.min("license_id").alias("license_id"))
    small = sorted(map(str, licenses.scan_licenses(edge_docs, known).collect()))
    monkeypatch.setattr(licenses, "BROADCAST_DIGESTS", 0)
    joined = licenses.scan_licenses(edge_docs, known)
    assert "ResolvedHint" not in joined._jdf.queryExecution().analyzed().toString()
    assert sorted(map(str, joined.collect())) == small
