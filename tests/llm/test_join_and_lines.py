"""Near-duplicate join and line dedup against brute force, on small tables with odd rows."""

import re

import numpy as np
import pytest

from pagespark.llm import line_dedup, ngram_join
from pagespark.llm.components import components

DOCS = "doc_id long, text string, row string, gone int, cls string"


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(rows):
    sets, parent = [shingles(r[1]) for r in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    out = []
    for members in groups.values():
        ids = [rows[i][0] for i in members if rows[i][0] is not None]
        out += [(rows[i][0], len(sets[i]), min(ids, default=None)) for i in members]
    return sorted(out, key=repr)


def odd_rows():
    base = [f"w{i}" for i in range(80)]
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "One"), (6, "a b c d"), (7, "A  b\nc d")]
    for k in range(30):  # a group of near copies, each with changes of its own
        words = list(base)
        words[k] = f"x{k}"
        words += ["tail"] * (k % 3)
        rows.append((10 + k, " ".join(words)))
    chain = [f"c{i}" for i in range(60)]
    for k in range(6):  # each is close to the next only
        rows.append((50 + k, " ".join(chain[2 * k :] + [f"d{i}" for i in range(2 * k)])))
    rows += [(70, " ".join(base)), (70, " ".join(base)), (70, "another text under the same id here"), (None, " ".join(base)), (None, "nobody knows this one at all")]
    rows += [(80, "same same same same same same same same"), (81, "same " * 40), (90, "long " + " ".join(f"l{i}" for i in range(30000)))]
    return rows


@pytest.mark.parametrize("group", [20_000, 3])
def test_join_equals_brute_force(spark, monkeypatch, group):
    """With groups of three, frequent shingles are dealt to several groups."""
    monkeypatch.setattr(ngram_join, "GROUP", group)
    monkeypatch.setattr(ngram_join, "ORDER_BITS", 14)
    rows = odd_rows()
    docs = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], DOCS)
    got = sorted((tuple(r) for r in ngram_join.join(docs).select("doc_id", "n_shingles", "component_id").collect()), key=repr)
    assert got == brute_components(rows)


def test_one_of_each_keeps_the_smallest_id(spark):
    rows = odd_rows()
    docs = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], DOCS)
    left = ngram_join.one_of_each(docs)
    assert left.columns == docs.columns
    ids = sorted(r["doc_id"] for r in left.collect() if r["doc_id"] is not None)
    want = {r[2] for r in brute_components(rows) if r[1] and r[2] is not None}
    assert set(ids) == want | {1, 2, 3}
    assert ids.count(70) == 1  # only the other text under that id


def test_join_of_an_empty_table(spark):
    assert ngram_join.join(spark.createDataFrame([], DOCS)).collect() == []


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 200)] + [(5, 5), (500, 501)], "u long, v long")
    got = {r["u"]: r["v"] for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(1, 201)}, 501: 500}


def brute_lines(rows):
    found = {}
    for d, text in sorted({r for r in rows if r[1] is not None}, key=lambda r: (r[0] is not None, r[0] or 0)):
        lines = [(k, tuple(re.findall(r"[^\x20\x09-\x0D]+", x))) for k, x in enumerate(text.split("\n"))]
        lines = [x for x in lines if x[1]]
        for a, b, c in zip(lines, lines[1:], lines[2:]):
            found.setdefault((a[1], b[1], c[1]), []).append((d, text, a[0], c[0]))
    gone = {}
    for places in found.values():
        for d, text, a, c in places[1:]:
            gone.setdefault((d, text), set()).update(range(a, c + 1))
    out = []
    for d, text in rows:
        cut = gone.get((d, text), set())
        out.append((d, text and "\n".join(x for k, x in enumerate(text.split("\n")) if k not in cut), 0 if text is None else text.count("\n") + 1, len(cut)))
    return sorted(out, key=repr)


def test_lines_equal_brute_force(spark):
    rows = [(1, "a\nb\nc\nd\ne"), (2, "x\nb\nc\n\nd\ny"), (3, " b \nc\td\nc\nd"), (4, None), (5, ""), (6, "\n\n"), (7, "only\ntwo"), (8, "r\nr\nr\nr\nr"), (9, "a\nb\nc\nd\ne"),
            (None, "q\nw\nz"), (10, "q\nw\n  z\n"), (11, "a b\nc\nd"), (12, "a\nb c\nd"), (13, "same\nrows\nhere"), (13, "same\nrows\nhere"), (14, "\n".join(f"l{i}" for i in range(3000)))]
    docs = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], DOCS)
    got = line_dedup.dedup_lines(docs)
    assert got.columns == [*docs.columns, "n_lines", "n_removed"]
    assert sorted((tuple(r) for r in got.select("doc_id", "text", "n_lines", "n_removed").collect()), key=repr) == brute_lines(rows)
    assert line_dedup.dedup_lines(docs.limit(0)).collect() == []


def test_cells_hold_every_pair_under_the_filters(spark):
    """No pair that passes the length and positional filters is lost, and a cell holds few that don't."""
    rng = np.random.default_rng(3)
    rows = [(k % 2, k, k, int(n), int(p)) for k, (n, p) in enumerate(zip(rng.integers(1, 300, 400), rng.integers(0, 20, 400))) if p < n]
    frame = spark.createDataFrame(rows, "members long, cls long, part long, n long, place long")
    x, y = ngram_join._cells(frame, "members", 75)
    met = [(r.cls_x, r.cls_y) for r in x.join(y, ["members", "low", "high"]).select("cls_x", "cls_y").collect()]
    got, fit = {(min(m), max(m)) for m in met}, set()
    n, p = (np.array([r[c] for r in rows]) for c in (3, 4))
    for i, (members, a, *_) in enumerate(rows):
        fits = ngram_join._allowed(np.full(len(n), n[i]), n, np.full(len(n), p[i]), p, 75)
        fit |= {(min(a, r[1]), max(a, r[1])) for r, f in zip(rows, fits) if f and r[0] == members}
    assert fit <= got and len(got) < 2 * len(fit)


def test_texts_that_share_a_passage_do_not_all_meet(spark):
    """A passage of most of each text, too little for a link: the join's key keeps its texts apart."""
    rows = [(0, k, k, 98, 18) for k in range(2000)]
    frame = spark.createDataFrame(rows, "members long, cls long, part long, n long, place long")
    x, y = ngram_join._cells(frame, "members", 75)
    assert x.join(y, ["members", "low", "high"]).count() == 0


@pytest.mark.parametrize("flush", [1 << 20, 5])
def test_packed_postings_come_back(monkeypatch, flush):
    monkeypatch.setattr(ngram_join, "FLUSH", flush)
    rng, packer = np.random.default_rng(1), ngram_join._Packer(4)
    rows = [(rng.integers(0, 9, k).astype(np.uint64), np.zeros(k, np.int32), np.arange(k), np.arange(k) * 7) for k in (3, 1, 8, 6)]
    batches = [b for r in rows for b in packer.add(*r)] + list(packer.flush())
    back, home = [], {}
    for b in batches:
        for i, bucket in enumerate(b["bucket"].to_pylist()):
            columns = [np.frombuffer(b[c][i].as_buffer(), kind) for c, kind in ngram_join._COLUMNS.items()]
            back += zip(*(c.tolist() for c in columns))
            assert {home.setdefault(t, bucket) for t in columns[0].tolist()} == {bucket}
    assert sorted(back) == sorted(x for r in rows for x in zip(*(c.tolist() for c in r)))
    assert list(packer.flush()) == []
