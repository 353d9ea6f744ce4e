"""Files of token ids, WARC archives and SentencePiece models: exact round trips and parity."""

import base64
import hashlib
import json
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagespark.llm import files, queries, sentencepiece_files, simple8b, token_files, warc
from pagespark.llm.queries import PIECES, TOKENIZER, tokenizer_path

TEXTS = ["", None, "The cat, sat. On the MAT!", "don't, it's. ’tis 'tis <|endoftext|>x", "Ünï,̇ Á \x01 \x01a  ", "日本語 🙂", "  two\n\nlines  ", "ΟΔΟΣ, ½ 3.14 a...", "word " * 5000]


@settings(deadline=None, max_examples=60)
@given(st.lists(st.one_of(st.just(0), st.integers(0, 40), st.integers(0, 60000), st.integers(0, 2**64 - 1)), max_size=3000))
def test_simple8b_round_trip(values):
    values = np.array(values, np.uint64)
    words, offsets = simple8b.encode(values)
    assert (simple8b.decode(words, offsets, len(values)) == values).all()


def test_simple8b_is_small():
    words, _ = simple8b.encode(np.zeros(102_400, np.uint32))
    assert len(words) <= 600
    words, _ = simple8b.encode(np.full(102_400, 32767, np.uint32))
    assert len(words) <= 102_400 / 4 + 100


def test_words_encode_like_whole_texts():
    code = token_files.WordEncoder(tokenizer_path(TOKENIZER))
    texts = [t or "" for t in TEXTS]
    want = code.encode_whole(texts)
    for _ in range(2):  # the second time all words are known
        ids, counts = code.encode(*token_files.words.buffers(pa.array(texts)))
        assert counts.tolist() == [len(x) for x in want]
        assert ids.tolist() == [y for x in want for y in x]


def test_token_files(spark, monkeypatch):
    monkeypatch.setattr(token_files, "SECTION", simple8b.BLOCK)
    rows = [(100 - k, t, "x") for k, t in enumerate(TEXTS)] + [(None, "no id", "x"), (7, "same", "x"), (7, "same", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part string")
    manifest = token_files.write(docs, tokenizer_path(TOKENIZER))
    got = token_files.digests(manifest).collect()
    code = token_files.WordEncoder(tokenizer_path(TOKENIZER))
    start, want = 0, []
    for d, t, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*code.encode_whole([t or ""])[0], 2]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert token_files.digests(token_files.write(docs.limit(0), tokenizer_path(TOKENIZER))).collect() == []


PAGES = [(5, "u5", "same"), (2, "u2", "same"), (9, None, "same"), (3, "a b\r\nc", None), (4, "é", ""), (6, "u", "x" * 3_000_000), (None, "n", "same"), (7, "u", "twice"), (7, "u", "twice"), (8, "u", "HTTP/1.1\r\n\r\nWARC/1.1\r\n\r\n")]


@pytest.mark.parametrize("roll", [1, 1 << 20])
def test_warc(spark, roll):
    pages = spark.createDataFrame([(*r, "x") for r in PAGES], "page_id long, url string, html string, digest string")
    got = warc.read_members(warc.normalise(warc.write_monolithic(pages, roll))).collect()
    want = []
    for page, _, html in PAGES:
        payload = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        first = min(p for p, _, h in PAGES if (h or "") == (html or "") and p is not None)
        want.append((page, len(payload), digest, "response" if page == first else "revisit", None if page == first else first))
    want.remove((7, 5, want[7][2], "response", None))  # one of the two rows of page 7 refers to the other
    want.append((7, 5, want[7][2] if want[7][0] == 7 else next(w[2] for w in want if w[0] == 7), "revisit", 7))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert warc.read_members(warc.normalise(warc.write_monolithic(pages.limit(0)))).collect() == []


def test_members_stand_alone_and_small_payloads_stay(spark):
    pages = spark.createDataFrame([(1, "u", "abc"), (2, "u", "abc"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id long, url string, html string")
    archives = warc.normalise(warc.write_monolithic(pages), least_bytes=4)
    assert sorted((r["page_id"], r["record_type"]) for r in warc.read_members(archives).collect()) == [(1, "response"), (2, "response"), (3, "response"), (4, "revisit")]
    for row in archives.collect():
        with files.reader(row["uri"]) as f:
            data = f.read()
        with files.reader(row["uri"] + ".idx") as f:
            index = [json.loads(x) for x in f.read().decode().splitlines()]
        assert [e["offset"] for e in index] == [0, *np.cumsum([e["length"] for e in index])[:-1].tolist()] and index[-1]["offset"] + index[-1]["length"] == len(data)
        assert all(zlib.decompress(data[e["offset"] : e["offset"] + e["length"]], 31).startswith(b"WARC/1.1\r\n") for e in index)


def test_broken_archives_are_told():
    with pytest.raises(ValueError):
        list(warc.records(iter([b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc"])))
    with pytest.raises(ValueError):
        list(warc.records(iter([b"nonsense\r\n\r\n"])))


def test_sentencepiece_parity_on_whole_texts(spark):
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate([*TEXTS, " ▁mark", "\n\n x\t y", "   ", " a  b "])] + [(None, "no id", "x")], "doc_id long, text string, parity string")
    rows = sentencepiece_files.encode(docs, tokenizer_path(PIECES), 2).collect()
    code = sentencepiece_files.Encoder(tokenizer_path(PIECES))
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in rows:
        ids = code.peer.encode(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_crc32"], r["parity"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), True)
        assert code.whole.encode(texts[r["doc_id"]], add_special_tokens=False).ids == ids
        assert code.whole.decode(ids) == code.peer.decode(ids)
        assert r["round_trip"] == ("▁" not in texts[r["doc_id"]])
    assert sentencepiece_files.encode(docs.limit(0), tokenizer_path(PIECES)).collect() == []


@pytest.mark.parametrize("texts", [["the cat sat on the mat", "a b"], ["▁ whole texts", "the mat"]])
def test_ids_are_those_of_the_rebuilt_tokenizer(monkeypatch, texts):
    monkeypatch.setattr(sentencepiece_files, "merges", lambda model: [])  # a wrong rebuild
    code = sentencepiece_files.Encoder(tokenizer_path(PIECES))
    ids, counts, same = code.encode(pa.array(texts))
    want = [e.ids for e in code.whole.encode_batch(texts, add_special_tokens=False)]
    assert counts.tolist() == [len(x) for x in want] and ids.tolist() == [y for x in want for y in x]
    assert not same.any() and want != code.peer.encode(texts)
    assert [b.decode() for b in code.decode(ids, counts)] == [t.replace("▁", " ") for t in texts]


def test_the_query_encodes_on_threads(monkeypatch):
    class Session:
        conf = {}

    asked = []
    monkeypatch.setattr(queries, "table", lambda *a: None)
    monkeypatch.setattr(queries.sentencepiece_files, "encode", lambda docs, path, threads: asked.append(threads))
    queries.op6_sentencepiece(Session, "")
    assert asked[0] > 1


def unigram_model(remove_extra: bool) -> bytes:
    """A unigram model written field by field."""

    def number(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    def put(field, value):
        return number(field << 3 | 2) + number(len(value)) + value if isinstance(value, bytes) else number(field << 3) + number(value)

    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{b:02X}>", -20.0, 6) for b in range(256)]
    pieces += [(p, -1.0 - k / 7, 1) for k, p in enumerate(["▁", "▁the", "▁a", "a", "b", "c", "ab", "abc", "▁ab", "the", "t", "h", "e", "▁▁"])]
    model = b"".join(put(1, put(1, p.encode()) + number(2 << 3 | 5) + struct.pack("<f", s) + put(3, k)) for p, s, k in pieces)
    return model + put(2, put(3, 1) + put(35, 1)) + put(3, put(1, b"identity") + put(3, 1) + put(4, int(remove_extra)) + put(5, 1))


@pytest.mark.parametrize("remove_extra", [False, True])
def test_unigram_models(tmp_path, remove_extra):
    path = tmp_path / "small.model"
    path.write_bytes(unigram_model(remove_extra))
    code = sentencepiece_files.Encoder(str(path))
    assert code.model.model_type == sentencepiece_files.UNIGRAM and code.model.falls_apart != remove_extra
    texts = ["the abc abab cabthe", "", "zé the", " ab  c ", "abcabcabc the the"]
    ids, counts, same = code.encode(pa.array(texts))
    want = code.peer.encode(texts)
    assert same.all() and counts.tolist() == [len(x) for x in want] and ids.tolist() == [y for x in want for y in x]
