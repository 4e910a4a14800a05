"""Every operator and stage on odd rows, on an empty table, and with columns that clash."""

from __future__ import annotations

import pytest

from tidemark.llm import decontam, html, jaccard, licences, mixing, quality, substring, tokencount, toxicity, warc

VOCABULARY = [("▁a", -1.0), ("a", -2.0), ("ab", -1.5), ("▁", -3.0)]


def bench(spark):
    return spark.createDataFrame([(1, "one two three four five six seven eight nine ten " * 4), (2, None), (3, ""), (None, "x")], "item_id long, text string")


def labels(spark):
    return spark.createDataFrame([(6, 1, 0), (7, 0, 1), (9, 1, 0), (None, 1, 1), (8, None, 1)], "doc_id long, quality int, toxic int")


ROWS = {
    "quality": lambda s, d: quality.quality_verdicts(d),
    "licences": lambda s, d: licences.licence_scan(d),
    "tokens": lambda s, d: tokencount.token_counts(d, VOCABULARY, False),
    "jaccard": lambda s, d: jaccard.jaccard_components(d),
    "mixing": lambda s, d: mixing.mixed_words(d),
    "toxicity": lambda s, d: toxicity.score(d, toxicity.fit_chain(d, labels(s))),
}
STAGES = {
    "quality": lambda s, d: quality.quality_filter(d),
    "jaccard": lambda s, d: jaccard.keep_one(d, 5, 80),
    "substring": lambda s, d: substring.remove_passages(d),
    "decontam": lambda s, d: decontam.clean_documents(d, bench(s)),
}


@pytest.mark.parametrize("name", sorted(ROWS))
def test_a_row_for_each_row(spark, odd_docs, name):
    got = ROWS[name](spark, odd_docs).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r["doc_id"]) for r in odd_docs.collect())


@pytest.mark.parametrize("name", sorted(ROWS))
def test_rows_on_nothing(spark, no_docs, name):
    assert ROWS[name](spark, no_docs).collect() == []


@pytest.mark.parametrize("name", sorted(STAGES))
def test_stage_keeps_columns(spark, clashing_docs, name):
    got = STAGES[name](spark, clashing_docs)
    assert got.columns == clashing_docs.columns
    known = {str(r["doc_id"]) for r in clashing_docs.collect()}
    assert {str(r["doc_id"]) for r in got.collect()} <= known


@pytest.mark.parametrize("name", sorted(STAGES))
def test_stage_on_nothing(spark, no_docs, name):
    assert STAGES[name](spark, no_docs).collect() == []


def test_passages_and_matches_on_odd_rows(spark, odd_docs, no_docs):
    found = {(r.doc_id, r.removed) for r in substring.passages(odd_docs).collect()}
    assert found == {(9, False), (10, True)}
    assert substring.passages(no_docs).collect() == []
    # An item of one letter is searched as a whole word; an item without an id matches as others do.
    assert [(r.doc_id, r.item_id, r.exact) for r in decontam.contaminated(odd_docs, bench(spark)).collect()] == [(8, None, True)]
    assert decontam.contaminated(no_docs, bench(spark)).collect() == []


def test_blocks_on_odd_rows(spark, odd_docs, clashing_docs, no_docs):
    words = sum(len((r.text or "").split()) for r in odd_docs.collect())
    for docs in (odd_docs, clashing_docs):
        got = mixing.mixed_blocks(docs, 1024).collect()
        assert all(len(b.text.split(" ")) == b.n_words <= 1024 and b.doc_ids for b in got)
        assert abs(sum(b.n_words for b in got) - 1.5 * words) <= 4 * 1024
    assert mixing.mixed_blocks(no_docs, 1024).collect() == []


def test_odd_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "v", "<p>x</p>"), (3, "w", "<p>x</p>"), (3, "w", "<p>x</p>"), (4, "z", "<div>" * 20_000 + "deep")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {(r.page_id, r.text) for r in html.extract_text(pages).collect()} == {
        (1, ""), (2, ""), (None, "x"), (3, "x"), (4, "deep"),
    }
    got = warc.archived_pages(pages).collect()
    assert len(got) == len(rows)
    kinds = sorted((str(r.page_id), r.record_type, r.refers_to) for r in got)
    assert kinds == [("1", "revisit", 2), ("2", "response", None), ("3", "response", None), ("3", "response", None), ("4", "response", None), ("None", "revisit", 3)]
    none = pages.where("false")
    assert html.extract_text(none).collect() == [] and warc.archived_pages(none).collect() == []


MIT = """MIT License

Copyright (c) 2020 A B

Permission is hereby granted, free of charge, to any person
obtaining a copy of this software.

The above copyright notice and this permission notice shall be
included in all copies.

THE SOFTWARE IS PROVIDED "AS
IS", WITHOUT WARRANTY OF ANY KIND."""
BSD = """Copyright (c) 2020 A B
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
 * Redistributions of source code must retain the above
   copyright notice.
 * Redistributions in binary form must reproduce the above
   copyright notice.
 * Neither the name of A nor the names of its contributors may be
   used to endorse or promote products."""
GPL = """/*
 * This program is free software under the terms of the GNU
 * General Public License as published by the FSF, either version 3
 * of the License, or (at your option) any later version.
 */"""


def test_licences_wrapped_tagged_and_without_cues(spark):
    texts = {
        MIT: "MIT", BSD: "BSD-3-Clause", GPL: "GPL-3.0-or-later", "Use Apache-2.0": "Apache-2.0", "It has MPL-2.0 terms.": "MPL-2.0",
        "BSD-3-Clause": "BSD-3-Clause", "A 3-clause BSD text": "BSD-3-Clause", "Proprietary and confidential": "proprietary",
        "// SPDX-License-Identifier: MIT\nint a;": "MIT", "# SPDX-License-Identifier: GPL-2.0-or-later": "GPL-2.0-or-later",
        "SPDX-License-Identifier: (MIT OR Apache-2.0)": "Apache-2.0 OR MIT", "SPDX-License-Identifier: ISC": "ISC",
        "SPDX-License-Identifier: X-Own": "unknown", "Under the Apache License, Version 2.0\nor licensed under the MIT license": "Apache-2.0 OR MIT",
    }
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.licence for r in licences.licence_scan(docs).collect()}
    assert [got[i] for i in range(len(texts))] == list(texts.values())
