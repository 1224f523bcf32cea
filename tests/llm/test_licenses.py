"""Notices of files and of their directories."""

import pytest

from sparkprof.llm import licenses

SCHEMA = "doc_id bigint, path string, text string, license string, dir string"
APACHE = "Licensed under the Apache License, Version 2.0."
MIT = "Released under the MIT License."


def scan(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    return {r["doc_id"]: (r["license"], r["origin"], r["license_dir"]) for r in licenses.scan(df).collect()}


def test_own_notices_win_over_those_of_directories(spark):
    filler = "some words that say nothing\nmore of them here\n"
    found = scan(spark, [
        (1, "a/LICENSE", APACHE), (2, "a/b/c/file.txt", filler), (3, "a/b/own.txt", filler + MIT + "\n" + filler),
        (4, "a/b/c/LICENSE.md", filler + "This work is licensed under the GNU General Public License, version 3."),
        (5, "a/b/c/d/e.py", filler), (6, "other/file", filler), (7, "top", filler), (8, None, filler),
        (9, "a/b/c/COPYING", MIT), (10, "ab/file", filler), (11, "long/f", (filler * 20_000) + "Licensed under CC BY-NC 4.0."),
        (None, "a/none", None), (12, "a/empty", ""), (12, "a/empty", ""),
    ])
    assert found[1] == ("Apache-2.0", "own", None) and found[3] == ("MIT", "own", None)
    assert found[4][0] == "GPL-3.0" and found[11] == ("CC-BY-NC-4.0", "own", None)
    # Both files of a/b/c state one; the more similar counts.
    assert found[2][1:] == ("inherited", "a/b/c") and found[5] == found[2]
    assert found[None] == found[12] == ("Apache-2.0", "inherited", "a")
    for alone in (6, 7, 8, 10):
        assert found[alone] == (None, None, None)


def test_a_license_file_at_the_top_covers_all(spark):
    found = scan(spark, [(1, "LICENSE", MIT), (2, "x/y/z", "text"), (3, "w", "text")])
    assert found[2] == found[3] == ("MIT", "inherited", "")


@pytest.mark.parametrize("license, text", licenses.TEMPLATES)
def test_every_notice_is_its_own(license, text):
    """No two licences have a notice of the same words."""
    words = set(licenses.template_words(text))
    same = {other for other, t in licenses.TEMPLATES if set(licenses.template_words(t)) == words}
    assert same == {license}


def test_short_notices_count_and_single_words_do_not(spark):
    filler = "all of this says nothing\nnor does that\n" * 30
    found = scan(spark, [
        (1, "a/x", filler + "All rights reserved."), (2, "b/x", filler + "\u00a9 all rights reserved\n"),
        (3, "c/x", filler + "Reserved\nRights\nMIT\n"), (4, "d/x", filler + MIT),
    ])
    assert found[1] == found[2] == ("Proprietary", "own", None)
    assert found[3] == (None, None, None) and found[4][0] == "MIT"


def test_empty_table(spark):
    assert scan(spark, []) == {}
