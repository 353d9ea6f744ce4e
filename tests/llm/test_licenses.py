"""Licence rules against plain regular expressions, text by text."""

import re

from pagespark.llm import licenses
from pagespark.llm.licenses import CERTAINTY, FAMILY, STATED, TAG, TITLE, Rule

COLUMNS = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
SEPARATORS = "".join(map(chr, [*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
WORD = re.compile(f"[^{re.escape(SEPARATORS)}]+")
RULES = licenses.rules()


def brute(rows, rules=RULES):
    out = []
    for doc_id, text in rows:
        words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        spaced = "".join(f" {w} " for w in words)
        found = []
        for k, r in enumerate(rules):
            if r.keyword in words:
                for m in re.finditer(licenses.compiled(r), spaced):
                    found.append((spaced[: m.start()].count(" ") // 2, spaced[: m.end()].count(" ") // 2, k))
        kept = []
        for i, j, k in found:
            over = [e for e in found if rules[e[2]].priority <= rules[k].priority and e[0] <= i and j <= e[1] and (e[:2] != (i, j) or (rules[e[2]].priority, e[2]) < (rules[k].priority, k))]
            if rules[k].base or not over:
                kept.append(k)
        base = [i for i, _, k in found if rules[k].base]
        names = [",".join(sorted({rules[k].label for k in some})) for some in ([k for *_, k in found if rules[k].base], kept)]
        out.append((doc_id, len(words), len(base), min(base, default=None), max(base, default=None), *names, max((CERTAINTY[rules[k].priority] for k in kept), default=0.0)))
    return sorted(out, key=repr)


def scanned(spark, rows, rules=None):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as Labels", "1 as row", "2 as kept")
    found = licenses.scan(docs, rules)
    assert found.columns == COLUMNS
    return sorted(map(tuple, found.collect()), key=repr)


ROWS = [
    (1, None), (2, ""), (3, "..."), (4, "Released under the MIT License."), (5, "under-the.mit\nLICENSE, under the MIT license"),
    (6, "Licensed under the Apache License, Version 2.0."), (7, "cc by nc cc by nc CC BY-NC 4.0"), (8, "SPDX-License-Identifier: GPL-2.0-or-later"),
    (9, "GNU Lesser General Public License, version 2.1 or later; the GNU General Public License version 3"), (10, "Kommt mit. By the license? nc"),
    (11, "under the mit licenses"), (12, "under the Kmit license LİCENSE under the mİt license Ünder under the mit license"), (13, "the mit license é9 ñ"),
    (None, "mit license"), (4, "Released under the MIT License."), (4, "Released under the MIT License."), (14, "the modified BSD license, or the zlib/libpng license. All rights reserved"),
    (15, "Neither the name of the Example Group nor the names of its contributors may be used to endorse or promote products derived from this software"),
    (16, "word " * 3000 + "MPL 2.0 " * 400), (17, "GNU Affero General Public License v3.0"), (18, "available under Creative Commons Attribution-ShareAlike 4.0 International"),
]


def test_equals_brute_force(spark):
    assert scanned(spark, ROWS) == brute(ROWS)


def test_empty_table(spark):
    assert scanned(spark, []) == []


def test_priority_and_containment(spark):
    rules = (
        Rule("b", STATED, "x", "x y", True), Rule("long", FAMILY, "y", "x y z"), Rule("title", TITLE, "y", "x y"), Rule("same", TITLE, "y", "x y"),
        Rule("tag", TAG, "z", "z"), Rule("over", STATED, "w", "y z w"),
    )
    rows = [(1, "x y z"), (2, "x y"), (3, "x y z w"), (4, "z x y x y z w z")]
    got = scanned(spark, rows, rules)
    assert got == brute(rows, rules)
    assert got[0][6] == "b,long,tag" and got[1][6] == "b"


def test_rules_are_sound():
    assert len(RULES) >= 300 and [r.priority for r in RULES[3:]] == sorted(r.priority for r in RULES[3:])
    for r in RULES:
        # the keyword cannot be left out of a match: without optional parts it still stands there
        plain = r.pattern
        while (less := re.sub(r"\((?:\?:)?[^()]*\)\?|\(\?:[^()]*\)\{0,\d+\}", "", plain)) != plain:
            plain = less
        assert re.search(rf"(?<![a-z0-9]){r.keyword}(?![a-z0-9])", plain), r


def test_no_python_on_executors(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    plan = licenses.scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|InArrow", plan) and plan.count("Exchange hashpartitioning") == 1


def test_many_matches_in_one_text(spark):
    rows = [(1, "mit license gpl " * 20_000)]
    assert scanned(spark, rows)[0][1:3] == (60_000, 0)
