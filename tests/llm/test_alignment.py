"""Alignment of two tokenizers against the definition, text by text."""

import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest

from pagespark.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def tokens(a, b, text):
    """(id, start, end) of the tokens of both, or nothing."""
    letters, raw, out = alignment.byte_level(), (" " + text).encode(), []
    for ids, of in (
        (a.encode(" " + text, add_special_tokens=False).ids, lambda k: bytes(letters[c] for c in a.id_to_token(k))),
        (b.encode(text), lambda k: bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode()),
    ):
        pieces = [of(k) for k in ids]
        if b"".join(pieces) != raw:
            return None
        at, some = 0, []
        for k, piece in zip(ids, pieces):
            some.append((k, at, at + len(piece)))
            at += len(piece)
        out.append(some)
    return out


def brute(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    found, held = [], Counter()
    for doc_id, text in rows:
        both = tokens(a, b, text) if text else None
        links = groups = None
        if both:
            x, y = both
            links = [(k, q) for k, i, j in x for q, s, e in y if i < e and s < j]
            held.update(set(links))
            cuts = sorted({t[2] for t in x} & {t[2] for t in y})
            groups = [[[str(k) for k, i, j in side if lo < j <= hi] for side in both] for lo, hi in zip([0, *cuts], cuts)]
        found.append((doc_id, both, links, groups))
    best = defaultdict(int)
    for (k, _), n in held.items():
        best[k] = max(best[k], n)
    out = []
    for doc_id, both, links, groups in found:
        if not both:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
            continue
        shown = ";".join("|".join(",".join(side) for side in g) for g in groups)
        counts = [held[x] for x in links]
        n_best = sum(n == best[x[0]] for x, n in zip(links, counts))
        out.append((doc_id, len(both[0]), len(both[1]), len(groups), len(links), n_best, sum(counts), hashlib.sha256(shown.encode()).hexdigest()))
    return out


ODD = [
    (1, None), (2, ""), (3, " "), (4, "a  b"), (5, "\nfoo bar\n\nbaz \n"), (6, "x▁y z"), (7, "x▁y z"), (8, "<|endoftext|> <s> </s> a\tb"),
    (9, "  é　 ü ñ  a"), (10, "it's we'll 12.5 3,4 ab12 \x1c x. Next, last."), (11, "日本語 テスト 😀 😀"), (12, "x\x00y \x85 z \x00.x"), (None, "a b c"),
    (13, "a b c"), (13, "a b c"), (14, "\n"), (15, "\n a"), (16, " a."), (17, "a "), (18, ".a\n"), (19, "a \nb\n c\r\nd\r\n\r\ne"), (20, "  \n\n x"),
    (21, "\n\nx..., y"), (22, "  'tis   'll"), (23, "z" * 700 + " " + "q " * 300), (24, "Word, word. Word.\nWord, é. ß.ñ,"), (25, "\0.x ,y"),
]


def result(spark, rows, path_b=B):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as N_A", "2 as digest", "3 as block")
    found = alignment.align(docs, A, path_b)
    assert found.columns == [*COLUMNS[:-1], "groups_sha256"]
    return sorted(map(tuple, found.collect()), key=repr)


def test_equals_brute_force(spark):
    assert result(spark, ODD) == sorted(brute(ODD), key=repr)


def test_empty_table(spark):
    assert result(spark, []) == []


@pytest.mark.parametrize("limit", ["KEEP", "BLOCK_BYTES", "SLICE_BYTES"])
def test_small_limits_change_nothing(limit, monkeypatch):
    import pyarrow as pa

    class Context:
        get = staticmethod(lambda: Context)
        partitionId = staticmethod(lambda: 3)

    monkeypatch.setattr(alignment, "TaskContext", Context)
    rows = [(k, t) for k, t in ODD if t] * 2

    def measured():
        batch = pa.RecordBatch.from_arrays([pa.array([str(k).encode() for k in range(len(rows))]), pa.array([t for _, t in rows]), pa.array([1] * len(rows))], names=["digest", "text", "times"])
        alignment._aligners.clear()
        out = []
        for block in alignment._blocks(A, B)(iter([batch])):
            per_text, step, times = alignment._unpack(block["links"][0].as_py(), 3)
            out += zip(*(block[c][0].as_py() for c in (*alignment.MEASURES, "groups_sha256")), per_text.tolist())
        return out

    whole = measured()
    monkeypatch.setattr(alignment, limit, 1)
    assert measured() == whole


def test_models_that_cannot_be_cut_are_encoded_whole():
    cut, whole = alignment.Aligner(A, B), alignment.Aligner(A, B)
    whole.apart = False
    import sentencepiece

    whole.b = sentencepiece.SentencePieceProcessor(model_file=B)
    texts = [t for _, t in ODD if t]
    a, b = cut.align(texts), whole.align(texts)
    assert (a[0] == b[0]).all() and a[1] == b[1] and (a[2] == b[2]).all() and (a[4].sum() == b[4].sum())


def test_each_distinct_text_is_aligned_once(spark):
    rows = [(k, f"text {k % 3}") for k in range(60)]
    one = {r["groups_sha256"] for r in alignment.align(spark.createDataFrame(rows, "doc_id long, text string"), A, B).collect()}
    assert len(one) == 3
    plan = alignment.align(spark.createDataFrame(rows, "doc_id long, text string"), A, B)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
