"""SentencePiece models run by the tokenizers library, with parity checked against sentencepiece.

The model's protobuf is read field by field (``parse``) and rebuilt in the tokenizers library
(``build``): normaliser (character map, extra white space), the metaspace marker for a space and
before a text, unigram scores or, for a BPE model, the merges that its scores imply, and byte
fallback for characters without a piece.

Where a model keeps a text's characters as they are and no piece has the marker after another
character, pieces never cross into a run of spaces from the left. Texts then fall into chunks (a run of
spaces and what follows it) that are encoded apart with the same result: each distinct chunk is encoded once
by the library, in batches on ``threads`` threads, and by sentencepiece, which should agree. Other models, and
texts that hold the marker itself, are encoded whole by both. All that is returned comes from the library's
ids; where sentencepiece's differ the document is marked. Decoding joins the pieces' bytes, and is compared
with the text.

Defined results: null and empty texts have no ids and decode to the empty text. Null and repeated ids pass
through. An empty table gives no rows. Extra columns are left out.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pagespark.llm import words

MARK = "▁"
KEEP = 1_500_000
SLICE_BYTES = 2 << 20
# Fixed values of the format: kinds of pieces and of models.
UNKNOWN, CONTROL, BYTE = 2, 3, 6
UNIGRAM, BPE = 1, 2


@dataclass
class Model:
    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    kinds: list[int] = field(default_factory=list)
    model_type: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    add_prefix: bool = True
    remove_extra: bool = True

    @property
    def unknown(self) -> int:
        return self.kinds.index(UNKNOWN)

    @property
    def falls_apart(self) -> bool:
        """Texts may be encoded by chunks."""
        return not self.charsmap and not self.remove_extra and self.add_prefix and not any(MARK in p.lstrip(MARK) for p in self.pieces)


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protobuf message."""

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    at = 0
    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(kind)
        size = number() if size is None else size
        yield key >> 3, data[at : at + size]
        at += size


def parse(proto: bytes) -> Model:
    """What encoding needs of a serialised model."""
    model = Model()
    for number, value in _fields(proto):
        if number == 1:
            piece = dict(_fields(value))
            model.pieces.append(piece.get(1, b"").decode())
            model.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
            model.kinds.append(piece.get(3, 1))
        elif number == 2:
            trainer = dict(_fields(value))
            model.model_type, model.byte_fallback = trainer.get(3, UNIGRAM), bool(trainer.get(35, 0))
        elif number == 3:
            spec = dict(_fields(value))
            model.charsmap, model.add_prefix, model.remove_extra = spec.get(2, b""), bool(spec.get(3, 1)), bool(spec.get(4, 1))
    if model.model_type not in (UNIGRAM, BPE):
        raise ValueError(f"model type {model.model_type} is neither unigram nor BPE")
    return model


def merges(model: Model) -> list[tuple[str, str]]:
    """Pairs of pieces that make a piece, the best piece first, as SentencePiece joins them."""
    usable = {p: k for k, p in enumerate(model.pieces) if model.kinds[k] not in (UNKNOWN, CONTROL, BYTE)}
    found = []
    for piece, k in usable.items():
        splits = [(piece[:i], piece[i:]) for i in range(1, len(piece)) if piece[:i] in usable and piece[i:] in usable]
        found += [(-model.scores[k], k, usable[a], usable[b], a, b) for a, b in splits]
    return [x[4:] for x in sorted(found)]


def build(model: Model, prefix: bool = True):
    """The tokenizers library's form of a model; without ``prefix`` no marker is put before a text."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    if model.model_type == UNIGRAM:
        core = models.Unigram(list(zip(model.pieces, model.scores)), unk_id=model.unknown, byte_fallback=model.byte_fallback)
    else:
        core = models.BPE({p: k for k, p in enumerate(model.pieces)}, merges(model), unk_token=model.pieces[model.unknown], fuse_unk=True, byte_fallback=model.byte_fallback)
    out = Tokenizer(core)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.remove_extra:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if prefix and model.add_prefix:
        steps.append(normalizers.Prepend(MARK))
    out.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
    out.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*"), "isolated")
    out.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), decoders.Strip(" ", 1, 0)])
    return out


class Encoder:
    """Ids of texts with the chunks that are known; see the module."""

    def __init__(self, path: str, threads: int = 1) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        os.environ["RAYON_NUM_THREADS"] = str(threads)
        import sentencepiece

        with open(path, "rb") as f:
            proto = f.read()
        self.model, self.threads = parse(proto), threads
        self.whole, self.part = build(self.model), build(self.model, prefix=False)
        self.peer = sentencepiece.SentencePieceProcessor(model_proto=proto)
        bytes_ = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else p.replace(MARK, " ").encode() for p, k in zip(self.model.pieces, self.model.kinds)]
        bytes_[self.model.unknown] = " ⁇ ".encode()
        self.piece_size = np.array([len(b) for b in bytes_])
        self.piece_start = np.cumsum(self.piece_size) - self.piece_size
        self.piece_bytes = np.frombuffer(b"".join(bytes_), np.uint8)
        self.clear()

    def clear(self) -> None:
        self.known, self.slot = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.start, self.count, self.good, self.pool = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool), np.empty(0, np.uint32)

    def both(self, texts: list[str], chunks: bool) -> tuple[list[list[int]], list[bool]]:
        """The library's ids of texts, and whether sentencepiece gives the same."""
        mine = [e.ids for e in (self.part if chunks else self.whole).encode_batch_fast(texts, add_special_tokens=False)]
        # a chunk begins with the space that sentencepiece puts there by itself
        peer = self.peer.encode([t[1:] for t in texts] if chunks else texts, num_threads=self.threads) if texts else []
        if chunks:  # but not before an empty text: a lone space is the marker alone
            peer = [[self.peer.piece_to_id(MARK)] if t == " " else ids for t, ids in zip(texts, peer)]
        return mine, [a == b for a, b in zip(mine, peer)]

    def _learn(self, new: np.ndarray, texts: list[str]) -> None:
        ids, good = self.both(texts, chunks=True)
        count = np.array([len(x) for x in ids])
        at = np.searchsorted(self.known, new)
        self.slot = np.insert(self.slot, at, np.arange(len(self.start), len(self.start) + len(new)))
        self.known = np.insert(self.known, at, new)
        self.start = np.append(self.start, len(self.pool) + np.cumsum(count) - count)
        self.count, self.good = np.append(self.count, count), np.append(self.good, good)
        self.pool = np.concatenate([self.pool, *(np.array(x, np.uint32) for x in ids)])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids one after another, number of each text's ids, and parity of each text."""
        data, offsets = words.buffers(texts)
        n = len(offsets) - 1
        if not self.model.falls_apart or data.tobytes().find(MARK.encode()) >= 0:
            ids, good = self.both([t or "" for t in texts.to_pylist()], chunks=False)
            return np.array([x for y in ids for x in y], np.uint32), np.array([len(x) for x in ids], np.int64), np.array(good, bool)
        # the marker before a text is a space put before its bytes
        filled = np.flatnonzero(offsets[1:] > offsets[:-1])
        data = np.insert(data, offsets[:-1][filled], np.uint8(32))
        offsets = offsets + np.r_[0, np.cumsum(offsets[1:] > offsets[:-1])]
        if not len(data):
            return np.empty(0, np.uint32), np.zeros(n, np.int64), np.ones(n, bool)
        space = data == 32
        new = space.copy()
        new[1:] &= ~space[:-1]
        new[offsets[:-1][filled]] = True
        starts = np.flatnonzero(new)
        ends = np.r_[starts[1:], len(data)]
        first = np.searchsorted(starts, offsets)
        distinct, where, inverse = np.unique(words.span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.known) > KEEP:
            self.clear()
        at = np.minimum(np.searchsorted(self.known, distinct), max(0, len(self.known) - 1))
        missing = np.flatnonzero(self.known[at] != distinct) if len(self.known) else np.arange(len(distinct))
        if len(missing):
            raw = data.tobytes()
            self._learn(distinct[missing], [raw[starts[i] : ends[i]].decode() for i in where[missing]])
            at = np.searchsorted(self.known, distinct)
        slot = self.slot[at][inverse]
        count = self.count[slot]
        total, bad = np.r_[0, np.cumsum(count)], np.r_[0, np.cumsum(~self.good[slot])]
        take = np.repeat(self.start[slot] - total[:-1], count) + np.arange(total[-1])
        return self.pool[take], total[first[1:]] - total[first[:-1]], bad[first[1:]] == bad[first[:-1]]

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """Bytes of each text: those of its pieces, without the marker before it."""
        size = self.piece_size[ids]
        total = np.r_[0, np.cumsum(size)]
        take = np.repeat(self.piece_start[ids] - total[:-1], size) + np.arange(total[-1])
        raw, ends = self.piece_bytes[take].tobytes(), total[np.r_[0, np.cumsum(counts)]]
        skip = 1 if self.model.add_prefix else 0
        return [raw[i + skip : j] if raw[i : i + 1] == b" " else raw[i:j] for i, j in zip(ends[:-1].tolist(), ends[1:].tolist())]


_encoders: dict[tuple[str, int], Encoder] = {}


def _encode(path: str, threads: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (path, threads)
        if key not in _encoders:
            _encoders[key] = Encoder(path, threads)
        code = _encoders[key]
        for batch in batches:
            for part in words.slices(batch, limit=SLICE_BYTES):
                ids, counts, same = code.encode(part["text"])
                ends = np.cumsum(counts)
                raw = ids.astype("<u4").tobytes()
                sums = [zlib.crc32(raw[4 * (e - c) : 4 * e]) for c, e in zip(counts.tolist(), ends.tolist())]
                data, offsets = words.buffers(part["text"])
                text = data.tobytes()
                back = [b == text[i:j] for b, i, j in zip(code.decode(ids, counts), offsets[:-1].tolist(), offsets[1:].tolist())]
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(counts), pa.array(sums, pa.int64()), pa.array(same), pa.array(back)], names=["doc_id", "n_tokens", "ids_crc32", "parity", "round_trip"])

    return run


def encode(docs: DataFrame, path: str, threads: int = 1) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, parity (both libraries agree) and round_trip (decoding gives the text)."""
    return docs.select("doc_id", "text").mapInArrow(_encode(path, threads), "doc_id long, n_tokens long, ids_crc32 long, parity boolean, round_trip boolean")
