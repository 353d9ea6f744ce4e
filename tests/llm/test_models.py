"""Language ID and quality on held-out rows; quality rules, packing and search against brute force."""

import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagespark.llm import language_id, line_dedup, ngram_join, ngrams, packing, quality, quality_rules, queries, topk

SYLLABLES = {"en": ["the", "ing", "wh", "tion", "er"], "fr": ["eau", "ou", "é", "elle", "ment"], "de": ["sch", "ung", "ü", "keit", "ei"]}


def prose(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang], rng.integers(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(3)
    rows, labels = [], []
    for k in range(900):
        lang = ("en", "fr", "de")[k % 3]
        good = k % 4 != 0
        text = prose(rng, lang, int(rng.integers(20, 120)))
        if not good:
            text = (" ".join(w + "***" for w in text.split()), " ".join(w + " " + w + " " + w for w in text.split()), text.upper().replace(" ", "!! "))[k % 3]
        rows.append((k, text, lang, f"src{k % 5}", len(text), 1))
        if k % 2 == 0 or k % 5 == 0:
            labels.append((k, int(good), 0))
    odd = [(2000, None, None, None, None, 1), (2001, "", "en", "s", 0, 1), (2002, "12 34 !!", "xx", None, 8, 1), (None, prose(rng, "en", 30), "en", "s", 1, 1), (2003, prose(rng, "fr", 30000), "fr", "s", 1, 1), (3, "again under another id", "en", "s", 1, 1)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, source string, n_chars long, score int").repartition(3).cache()
    return docs, spark.createDataFrame(labels + [(2, 1, 0), (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int"), {r[0]: k % 4 != 0 for k, r in enumerate(rows)}


def test_languages_of_held_out_rows(corpus):
    docs, _, _ = corpus
    model = language_id.fit(docs)
    assert model.languages[:3] == ("de", "en", "fr")
    rows = language_id.predict(docs.withColumn("held", language_id.held_out()), model).collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r["held"] and r["doc_id"] is not None and r["doc_id"] < 900]
    assert all(r["held"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows if r["doc_id"] is not None)
    assert len(held) > 100 and sum(r["lang"] == r["lang_pred"] for r in held) >= 0.99 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)
    by = {r["doc_id"]: r for r in rows}
    for odd in (2000, 2001, 2002):
        assert (by[odd]["lang_pred"], by[odd]["score"], by[odd]["lang_rejected"]) == ("und", 0.0, True)
    assert by[2003]["lang_pred"] == "fr" and by[None]["lang_pred"] == "en"


def test_unlearned_languages_and_random_letters_are_rejected(spark, corpus):
    docs, _, _ = corpus
    rng = np.random.default_rng(8)
    letters = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz   "), 400)) for _ in range(50)]
    odd = spark.createDataFrame([(k, t, "letters") for k, t in enumerate(letters)], "doc_id long, text string, lang string")
    rows = docs.select("doc_id", "text", "lang").where("doc_id < 900")
    model = language_id.fit(rows.where("lang <> 'de'"))  # two languages: no score is under 0.5
    assert model.temperature >= 1 and model.least_score > 0.5
    got = language_id.predict(rows.where(language_id.held_out()).union(odd), model).toPandas().groupby("lang")["lang_rejected"].mean()
    assert got["letters"] >= 0.9 and got["de"] >= 0.9
    assert got["en"] <= 0.05 and got["fr"] <= 0.05


def test_each_language_keeps_rows(spark):
    rows = spark.createDataFrame([(k, f"l{k % 9}") for k in range(900)] + [(9000, "rare")], "doc_id long, lang string")
    got = ngrams.stratified(rows, "doc_id", "lang", 100, 50).groupBy("lang").count().toPandas()
    assert got["count"].sum() == 50 and len(got) == 10 and got.set_index("lang")["count"].drop("rare").min() >= 5


def test_language_model_learns_from_nothing_held_out(corpus):
    docs, _, _ = corpus
    other = docs.withColumn("lang", F.when(language_id.held_out(), F.lit("zz")).otherwise(F.col("lang")))
    a, b = language_id.fit(docs), language_id.fit(other)
    assert a.languages == b.languages and (a.logits == b.logits).all()


def test_languages_without_labels(corpus):
    docs, _, _ = corpus
    rows = language_id.predict(docs, language_id.fit(docs.withColumn("lang", F.lit(None).cast("string")))).collect()
    assert {(r["lang_pred"], r["score"], r["lang_rejected"]) for r in rows} == {("und", 0.0, True)}
    assert language_id.predict(docs.limit(0), language_id.fit(docs.limit(0))).collect() == []


def test_quality_of_unlabelled_rows(corpus):
    docs, labels, good = corpus
    model = quality.fit(docs, labels)
    found = quality.score(docs, model)
    assert found.columns == [*docs.columns, "content_score", "metadata_score", "quality_score", "kept"]
    rows = found.collect()
    assert len(rows) == docs.count() and all(r["kept"] == (r["quality_score"] >= quality.KEEP_FROM) for r in rows)
    seen = {r["doc_id"] for r in labels.collect()}
    unseen = [r for r in rows if r["doc_id"] in good and r["doc_id"] not in seen and r["doc_id"] != 3]
    assert len(unseen) > 200 and sum(r["kept"] == good[r["doc_id"]] for r in unseen) >= 0.95 * len(unseen)


def test_views_hand_each_other_labels(corpus):
    docs, labels, _ = corpus
    assert min(quality.fit(docs, labels).handed) > 0


def test_labels_come_from_all_unlabelled_documents(corpus, monkeypatch):
    """Many copies of one text take one of the places, and what is judged is the whole table."""
    docs, labels, good = corpus
    monkeypatch.setattr(quality, "HANDED", 20)
    monkeypatch.setattr(quality, "kept", lambda df: df.cache())
    judged, asked = [], quality._handed

    def watch(views, label, *rest):
        judged.append({r["doc_id"] for r in views.join(label, "doc_id", "left_anti").collect()})
        got = asked(views, label, *rest)
        assert all(len({r["key"] for r in got if (r["pupil"], r["label"]) == k}) <= 20 for k in ((0, 0), (0, 1), (1, 0), (1, 1)))
        assert len({(r["pupil"], r["key"]) for r in got}) == len(got)
        return got

    monkeypatch.setattr(quality, "_handed", watch)
    copy = docs.where("doc_id = 9").withColumn("doc_id", F.explode(F.sequence(F.lit(5000).cast("long"), F.lit(5300).cast("long"))))
    model = quality.fit(docs.union(copy.select(docs.columns)), labels)
    labelled = {r["doc_id"] for r in labels.where("quality is not null and doc_id is not null").collect()}
    assert judged and all(j == ({*good, *range(2000, 2004), *range(5000, 5301)} - labelled) for j in judged)
    assert min(model.handed) > 20  # more than one round's copies


def naive_quality(text, source, lang, model):
    """The score of one document, its features counted one by one."""
    data = (text or "").encode()
    views = [np.zeros(quality.TEXT), np.zeros(quality.META)]
    for i in range(len(data) - 2):
        views[0][ngrams.ngram_ids(np.frombuffer(data[i : i + 3], np.uint8), 3, quality.BITS)[0]] += 1 / (len(data) - 2)
    views[0] = np.sqrt(views[0])
    w = re.findall(rb"[^\x20\x09-\x0D]+", data)
    if len(w) > 1:
        runs = [tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
        views[0][-3:] = sum(a == b for a, b in zip(w, w[1:])) / (len(w) - 1), len(set(w)) / len(w), len(set(runs)) / len(runs)
    for at, value in ((0, source), (quality.HASHED, lang)):
        views[1][at + (0 if value is None else zlib.crc32(value.encode()) % quality.HASHED)] = 1
    kinds = [0] * 7
    for b in data:
        c = chr(b)
        kinds[5 if b > 127 else 1 if c.isupper() else 2 if c.isdigit() else 3 if c in ".,;:'\"-()?!" else 6 if c in " \t\n\x0b\x0c\r" else 4 if 32 < b < 127 and not c.isalpha() else 0] += 1
    n, lines = len(data), data.count(b"\n") + 1
    views[1][2 * quality.HASHED :] = [np.log1p(n) / 10, np.log1p(lines) / 5, np.log1p(n / lines) / 8, *(k / max(1, n) for k in kinds[1:]), len(w) / max(1, n), 1]
    z = [float(np.clip(v.slope * (((x - v.mean) / v.scale) @ v.weights[:-1] + v.weights[-1]) + v.shift, -12, 12)) for x, v in zip(views, (model.content, model.meta))]
    return [1 / (1 + np.exp(-t)) for t in (*z, z[0] * model.combine[0] + z[1] * model.combine[1] + model.combine[2])]


def test_scores_equal_naive_ones(corpus):
    docs, labels, _ = corpus
    model = quality.fit(docs, labels)
    for r in quality.score(docs.where("doc_id < 150 or doc_id >= 2000 or doc_id is null").where("doc_id is null or doc_id <> 2003"), model).collect():
        want = naive_quality(r["text"], r["source"], r["lang"], model)
        assert np.allclose([r["content_score"], r["metadata_score"], r["quality_score"]], want, atol=2e-3), r["doc_id"]


def test_output_names_in_any_case(spark, corpus):
    docs, labels, _ = corpus
    rows = docs.select("doc_id", "text", "source", "lang", F.lit("old").alias("x")).limit(50)

    def outputs(make, *names):
        for name in names:
            frame = rows.withColumnRenamed("x", name.upper())
            got = make(frame)
            assert [c.lower() for c in got.columns].count(name) == 1 and name in got.columns
            assert got.count() == 50 and not any("old" in map(str, r) for r in got.select(f"`{name}`").collect())

    model, lang = quality.fit(docs, labels), language_id.fit(docs)
    outputs(lambda d: quality.score(d, model), "kept", "quality_score")
    outputs(lambda d: quality.score(d, None), "kept")
    outputs(lambda d: language_id.predict(d, lang), "score", "lang_pred")
    outputs(lambda d: quality_rules.cascade(d, figures=("n_words",)), "rejected_by", "n_words")
    outputs(line_dedup.dedup_lines, "n_removed", "n_lines")


def test_quality_without_both_classes(corpus):
    docs, labels, _ = corpus
    rows = quality.score(docs, quality.fit(docs, labels.where("quality = 1"))).collect()
    assert {(r["quality_score"], r["kept"]) for r in rows} == {(None, True)}
    assert quality.score(docs.limit(0), quality.fit(docs, labels)).collect() == []


def brute_figures(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def test_rules_equal_brute_force(spark):
    texts = [None, "", " \n ", "é " * 60, "a b c\na b c\n\n\nx\n x\nx", "one two three four five six " * 20, "w" * 3000, " ".join(f"Word{i}" for i in range(200)), "### $$$ " * 40 + " ".join(map(str, range(100))), "SHOUT " + " ".join(f"UP{i}" for i in range(80)),
             "\n".join(f"same line {i // 9}" for i in range(90)), "x\n\n\ny", "\n", "tail\n", " ".join(f"z{i}" for i in range(40000))]
    docs = spark.createDataFrame([(k if k else None, t, k) for k, t in enumerate(texts)], "doc_id long, text string, n_words int").union(spark.sql("select 5L, 'again', 1"))
    figures = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    rows = quality_rules.cascade(docs, figures=figures).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        assert tuple(r[c] for c in figures) == brute_figures(r["text"]), (r["text"] or "")[:40]
        if r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]:
            assert r["rejected_by"]
    assert any(r["rejected_by"] is None for r in rows)
    assert quality_rules.cascade(docs.limit(0)).collect() == []


def test_dear_rules_equal_brute_force(spark):
    texts = ["", None, "a b a b a b c", "é" * 30 + "日本" * 30, "one", "x" * 500 + " y", " ".join(f"w{i % 7}" for i in range(200)), "\U0001f600 ok " * 9]
    part = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    found = quality_rules._Texts(part)
    for g in ("pairs", "letters"):
        found.need(g, np.arange(len(texts)))
    for k, t in enumerate(texts):
        w, letters = re.findall(r"[^\x20\x09-\x0D]+", t or ""), Counter(t or "")
        pairs = Counter(zip(w, w[1:]))
        want = max(pairs.values(), default=0), len(t or ""), sum(n * n for n in letters.values())
        assert tuple(int(found.figures[c][k]) for c in ("n_top_pair", "n_chars", "n_same")) == want


def test_rejected_texts_never_reach_dear_rules(monkeypatch):
    reached = Counter()

    def counting(group):
        make, names = quality_rules.GROUPS[group]
        return (lambda data, offsets: (reached.update({group: len(offsets) - 1}), make(data, offsets))[1]), names

    monkeypatch.setattr(quality_rules, "GROUPS", {g: counting(g) for g in quality_rules.GROUPS})
    good = [" ".join(f"word{i * j % 97}" for i in range(80)) for j in range(1, 5)]
    part = pa.RecordBatch.from_arrays([pa.array(["few words"] * 50 + good), pa.array(range(54))], names=["text", "id"])
    out = list(quality_rules._cascade(quality_rules.RULES, ("n_words", "n_repeat_words"))(iter([part])))
    assert out[0].num_rows == 54 and set(out[0].columns[-1].to_pylist()[:50]) == {"too_few_words"}
    assert reached["counts"] == 54 and reached["repeats"] == 54  # asked for as figures
    assert reached["pairs"] == reached["letters"] == 4 and reached["lines"] == 4


def test_order_does_not_change_verdicts(spark, monkeypatch):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(["a b", "x " * 100, " ".join(f"q{i}" for i in range(90)), "# " * 60 + " ".join(f"q{i}" for i in range(60))])], "doc_id long, text string")
    verdicts = set()
    for rules in (quality_rules.RULES, quality_rules.RULES[::-1]):
        monkeypatch.setattr(quality_rules, "order_rules", lambda docs, r, n=0, rules=rules: rules)
        verdicts.add(tuple(sorted((r["doc_id"], r["rejected_by"] is None) for r in quality_rules.cascade(docs).collect())))
    assert len(verdicts) == 1


def test_cheap_rules_that_reject_come_first(spark):
    docs = spark.createDataFrame([(k, "few words") for k in range(50)] + [(100 + k, " ".join(f"q{i}" for i in range(90))) for k in range(50)], "doc_id long, text string")
    assert quality_rules.order_rules(docs)[0].name == "too_few_words"


def brute_pack(items, capacity):
    """Best fit by looking at every bin."""
    bins, out = [], []
    for length, source, cluster in items:
        fits = [b for b in bins if b["room"] >= length and source not in b["s"] and cluster not in b["c"]]
        best = min(fits, key=lambda b: b["room"], default=None)
        if best is None:
            best = {"room": capacity, "s": set(), "c": set()}
            bins.append(best)
        best["room"] -= length
        best["s"] |= {source} - {0}
        best["c"] |= {cluster} - {0}
        out.append(best["room"])
    return out, len(bins)


@pytest.mark.parametrize("seed", range(4))
def test_bins_are_the_tightest_compatible(seed):
    rng = np.random.default_rng(seed)
    items = sorted(((int(rng.integers(0, 100)), int(rng.choice([0, 1, 1, 1, 65, 3, 4, 200])), int(rng.choice([0, 0, 7, 8, 71, 9]))) for _ in range(600)), reverse=True)
    bins, rooms = packing.Bins(100), []
    for length, source, cluster in items:
        number, start = bins.put(length, source, cluster)
        rooms.append(100 - start - length)
    assert (rooms, bins.count) == brute_pack(items, 100)


def test_pack(spark):
    rows = [(k, (k * 37) % 90, f"s{k % 3}", k % 11) for k in range(300)] + [(None, 30, None, None), (400, None, "s1", 1), (401, 0, "s1", 1), (402, 1000, "s2", 2), (402, 1000, "s2", 2), (403, -5, None, None)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, length int, source string, cluster int, bin string").withColumn("text", F.lit("t"))
    got = packing.pack(docs, capacity=100, part_rows=64).toPandas()
    length = pd.Series([max(0, r[1] or 0) for r in rows])
    assert got["length"].sum() == length.sum() and got.groupby("bin")["length"].sum().max() <= 100
    spans = got.sort_values(["bin", "start", "length"])
    assert (spans["start"] == spans.groupby("bin")["length"].cumsum() - spans["length"]).all()
    by = {r[0]: r for r in rows}
    for _, one in got.groupby("bin"):
        for c in (2, 3):
            values = [by[int(d)][c] for d in one["doc_id"] if not pd.isna(d) and by[int(d)][c] is not None]
            assert len(values) == len(set(values))
    assert (got["doc_id"] == 402).sum() == 20 and got["doc_id"].isna().sum() == 1
    assert packing.pack(docs.limit(0)).collect() == []


def test_near_copies_part(spark):
    words = [f"w{i}" for i in range(60)]
    near = [" ".join([*words[:-1], f"end{k}"]) for k in range(6)]
    rows = [(k, t, f"s{k}") for k, t in enumerate(near)] + [(10 + k, t, f"t{k}") for k, t in enumerate([None, None, "", " ", None])]
    rows += [(20, near[0], "u"), (20, near[0], "u"), (30, " ".join(f"v{i}" for i in range(60)), "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = packing.pack(queries.clustered(ngram_join.Join(docs, carry="source")), row="row").toPandas()
    assert sorted(got["doc_id"]) == sorted(r[0] for r in rows)
    copies = got[(got["doc_id"] < 10) | (got["doc_id"] == 20)]
    assert len(copies) == 8 and copies["bin"].nunique() == 8  # near copies of different sources
    assert got["bin"].nunique() == 8  # texts without words conflict with nothing
    empty = docs.limit(0)
    assert packing.pack(queries.clustered(ngram_join.Join(empty, carry="source")), row="row").collect() == []


def brute_top(rows, k, every):
    ok = [(i, [int(np.floor(np.float64(np.float32(x)) * 256)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, v in {(i, tuple(v)) for i, v in ok if i % every == 0}:
        found = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in ok if j != i and len(w) == len(v))[:k]
        out += [(i, rank, j, -score) for rank, (score, j) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize("block", [2048, 7])
def test_search_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK_ROWS", block)
    monkeypatch.setattr(topk, "GROUP_ROWS", block)
    monkeypatch.setattr(topk, "LEFT", 1)
    rng = np.random.default_rng(5)
    rows = [(k, rng.normal(size=8).astype(np.float32).tolist()) for k in range(90)]
    rows += [(200 + k, rows[10][1]) for k in range(40)]  # many equal vectors
    rows += [(300, None), (301, []), (302, [1.0, None]), (303, [float("nan")] * 8), (304, [float("inf")] * 8), (None, rows[0][1]), (310, [1.0, 2.0]), (320, [3.0, -1.0]), (330, [0.0] * 8), (330, [0.0] * 8), (340, rows[3][1])]
    vectors = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, block int")
    got = sorted(tuple(r) for r in topk.search(vectors, F.col("vec_id") % 10 == 0, 3).collect())
    assert got == brute_top(rows, 3, 10)
    assert topk.search(vectors.limit(0), F.col("vec_id") % 10 == 0).collect() == []


@pytest.mark.parametrize("largest", [2e4, 4e5])
def test_scores_of_large_components_are_exact(spark, largest):
    rng = np.random.default_rng(6)
    rows = [(k, (largest * rng.normal(size=8)).astype(np.float32).tolist()) for k in range(60)]
    rows += [(100 + k, rows[10][1]) for k in range(9)] + [(200, [1e-3] * 8), (201, [largest * 3] * 8), (202, [largest * 3.5] * 8)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in topk.search(vectors, F.col("vec_id") % 10 == 0, 3).collect())
    assert got == brute_top(rows, 3, 10)


def test_sums_beyond_float64_are_exact():
    vectors = np.array([[2.0**30, 1.0, 0.0], [2.0**30, 2.0, 0.0], [2.0**30, 0.0, 0.0], [2.0**30, 2.0, 0.0], [-1.0, 0.0, 5.0]])
    rows, picked, score = topk.search_large(vectors, np.arange(5), np.array([[2.0**30, 1.0, 7.0]]), np.array([3]), 3)
    assert (rows.tolist(), picked.tolist(), score) == ([0, 0, 0], [1, 0, 2], [2**60 + 2, 2**60 + 1, 2**60])


def test_queries_stop_early():
    """A list's order lets clear answers stop before its end."""
    rng = np.random.default_rng(1)
    vectors = np.floor(256 * rng.normal(size=(512, 4)))
    got = topk.search_block(vectors, np.arange(512), vectors[:5] * 3, np.arange(5), 2)
    for q in range(5):
        score = vectors @ vectors[q] * 3
        score[q] = -np.inf
        assert got[1][got[0] == q].tolist() == np.argsort(-score, kind="stable")[:2].tolist()


def test_signs_and_numbers_are_no_letters(spark):
    rows = [(k, f"le la et mot{k} un", "fr") for k in range(60)] + [(100 + k, f"the of and word{k} a", "en") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    odd = spark.createDataFrame([(1, "½ ② Ⅷ ²"), (2, "_ 12"), (3, "½ é")], "doc_id long, text string")
    got = {r.doc_id: r.lang_pred for r in language_id.predict(odd, language_id.fit(docs)).collect()}
    assert got[1] == got[2] == "und" and got[3] in ("fr", "en")


def test_vectors_beyond_all_bounds(spark):
    big, top = 1e307, (1 << 63) - 1
    rows = [(0, [1e30, 1.0]), (1, [big, 0.0]), (2, [1e30, 0.0]), (3, [-1e30, 0.0]), (4, [1.0, 2.0]), (5, [0.0, 1.0])]
    found = topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, 5)
    got = {r.vec_id: r.score for r in found.collect()}
    assert got[2] == top and got[3] == -top - 1 and got[5] == 65536 and 1 not in got and len(got) == 4
