"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from pagespark.llm import spelling

COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def counted(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                i = h % len(run)
                run = run[:i] + run[i + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def brute(rows):
    n = counted(rows)
    close = {w: [v for v in n if near(w, v)] for w in n}
    form = {}
    for w, some in close.items():
        best = min(some, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(close[w]), n.get(form[w])))
    return sorted(out, key=repr)


def found(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as Word", "1 as n", "2 as form")
    got = spelling.variants(docs)
    assert got.columns == COLUMNS
    return sorted(map(tuple, got.collect()), key=repr)


def made_up(letters, seed, n=300):
    pick = random.Random(seed)
    stems = ["".join(pick.choices(letters, k=pick.randint(4, 14))) for _ in range(25)]
    rows = []
    for k in range(n):
        words = []
        for _ in range(40):
            w = pick.choice(stems)
            for _ in range(pick.choice((0, 0, 1, 2))):
                i = pick.randrange(len(w) + 1)
                w = pick.choice((w[:i] + pick.choice(letters) + w[i:], w[:i] + w[i + 1 :], w[:i] + pick.choice(letters) + w[i + 1 :]))
            words.append(w.upper() if pick.random() < 0.1 else w)
        rows.append((k, " ".join(words)))
    return rows


@pytest.mark.parametrize("letters", ["ab", "abc", "abcdefgh", "éñaÿÀ"])
@pytest.mark.parametrize("limit", [1, 64])
def test_equals_all_pairs(spark, monkeypatch, letters, limit):
    monkeypatch.setattr(spelling, "LEAST_LIMIT", limit)
    rows = made_up(letters, seed=len(letters))
    want = brute(rows)
    assert len(want) > 50 and found(spark, rows) == want


def test_odd_rows(spark):
    long = "ab" * 3000
    rows = [(1, None), (2, ""), (3, "12 ..."), (None, "abcde abcde abcdf"), (4, f"{long} {long} {long}"), (4, f"{long}x {long}x {long}x ABCDE"), (5, "abcdf ABCDF Àbcde àbcde"), (5, "abcdf ABCDF Àbcde àbcde"), (5, "abcdf ABCDF Àbcde àbcde"),
            (6, "a×bcd a×bcd a×bcd"), (7, "thirteen" * 2 + " " + ("thirteen" * 2 + "s ") * 3), (8, ("thirteen" * 2 + " ") * 9)]
    assert found(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert found(spark, []) == []


def test_small_batches_change_nothing(spark, monkeypatch):
    rows = made_up("abc", seed=9)
    for name in ("HELD", "ROWS", "PAIRS"):
        monkeypatch.setattr(spelling, name, 7)
    words = spelling.count_words(spark.createDataFrame(rows, "doc_id long, text string"))
    some = [(r["word"], r["n"]) for r in words.collect()]
    import pyarrow as pa

    grams = type("Held", (), {"value": {"ab": 900, "abc": 100, "ca": 70}})
    lists = pa.Table.from_batches(spelling._lists(grams)(iter([pa.RecordBatch.from_pydict({"word": [w for w, _ in some], "n": [n for _, n in some]})])))
    lists = lists.sort_by("key")
    got = Counter()
    for batch in spelling._merged(iter(lists.to_batches(max_chunksize=11))):
        for word, n in zip(batch["word"].to_pylist(), batch["n_near"].to_pylist()):
            got[word] += n
    assert got == {w: k for w, k in ((w, sum(near(w, v) for v, _ in some)) for w, _ in some) if k}


@pytest.mark.parametrize("a, b, lead", [("abcde", "abcde", -1), ("abcde", "abxde", 2), ("abcde", "abcdef", 5), ("abcde", "xabcde", 0), ("abcde", "abdce", -1), ("aabb", "aaabb", 2)])
def test_one_edit(a, b, lead):
    assert spelling.one_edit(a.encode(), b.encode()) == lead


def test_chosen_grams_share_no_edit():
    grams = {"ab": 500, "abc": 90, "bc": 200, "cd": 70}
    for word in ("abcde", "abcabc", "bcbcbcbc", "abcdabcdabcd", "zzzzzzzzzzzzzzzzzzzz"):
        for length in (len(word), len(word) + 1):
            (p, e), (q, f) = spelling.probes(word, length, grams)
            assert 0 <= p < e <= q < f <= len(word)
