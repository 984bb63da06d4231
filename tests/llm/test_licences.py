"""Whole licences in the layouts they are found in."""

import textwrap

from spanloom.llm import licence_list, licences


def _found(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = licences.scan_licences(docs, licences.known_digests(spark)).collect()
    return [r.license_id for r in sorted(rows, key=lambda r: r.doc_id)]


def test_licences_are_known_at_every_wrap_width(spark):
    long = [(i, t) for i, t in licences.NOTICES if len(t) > 500]
    cases = [(i, "\n\n".join(textwrap.fill(p, width) for p in t.split("\n\n"))) for i, t in long for width in range(40, 110)]
    assert _found(spark, [t for _, t in cases]) == [i for i, _ in cases]


def test_notices_of_copyright_do_not_count(spark):
    text = dict((i, t) for i, t in licences.NOTICES if len(t) > 500)["ISC"].split("\n", 1)[1]
    heads = ("Copyright (c) 2020 A", "(C) Copyright 2020 A", "# © A", "Copyright: 2020 A", "(c) 2020 A\nAll rights reserved.")
    assert _found(spark, [f"{h}\n{text}" for h in heads]) == ["ISC"] * len(heads)


def test_listed_licences_are_known_as_whole_texts(spark):
    known = licence_list.more_known(licences.NOTICES)
    whole = [(i, t) for i, t in known if len(t) > 500]
    assert {i for i, _ in whole} >= {*licence_list.TITLES, *licence_list.LONG.values()}
    assert _found(spark, [t for _, t in known]) == [i for i, _ in known]
