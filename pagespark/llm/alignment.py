"""Two tokenizers' tokens of the same texts, aligned by their bytes, with corpus-wide counts of linked ids.

1. *Distinct texts*: rows are grouped by their whole text (one shuffle, combined in each task first), with
   their number as multiplicity. Each distinct text is tokenised and aligned once.
2. *Alignment*: byte offsets at which tokens of both end cut a text into groups. The offsets at which
   a token of either ends cut it into pieces, each in one token of either: the pieces are the links, in linear time.
   Neither tokenizer reads across a lone space or line break between other characters, nor from a letter into
   a stop, so texts fall into chunks there, and a worker tokenises and aligns each distinct chunk once.
3. *Blocks*: about BLOCK_BYTES of text give one row: measures of its texts, a dictionary of the id
   pairs linked in it, each with the number of documents (multiplicities added), and, packed, which
   pairs each text links how often. The table of blocks is written to the shared folder.
4. *Counts*: dictionaries are summed for each pair, and a window over each id of A finds its highest; both
   return to the blocks as rows (block, place in the dictionary), where a kernel weighs each text's links.
   What moves is a block's dictionary, not its texts' links.
5. *Return*: measures are joined to doc_ids by the SHA-256 of the text.

Defined results: null and empty texts, and texts whose tokens' bytes are not those of space + text, have
zeros and an empty string. Repeated rows and ids each give a row and count each. Special tokens' strings are text.
A text of any length is one row of one block. An empty table gives no rows. Other columns are not read, so their
names cannot clash.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagespark.llm.sentencepiece_files import BYTE, MARK, parse
from pagespark.llm.store import kept
from pagespark.llm.words import slices

BLOCK_BYTES = 16 << 20
SLICE_BYTES = 1 << 20
#: Distinct chunks, and links of theirs, that a worker remembers.
KEEP, KEEP_LINKS = 400_000, 4_000_000
#: Characters of chunks that are encoded in one call.
_RUN = 1 << 15
MEASURES = ("n_a", "n_b", "n_groups", "n_links")
_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
#: A stop that follows no letter.
_LOOSE = re.compile(rf"[.,](?<![{_LETTER}][.,])")
_CUT = re.compile(rf"(?<=\S)(?=[ \n]\S)|(?<=[{_LETTER}])(?=[.,])")
#: A protobuf field that, put after a model, sets "add a space before a text" to false.
_NO_PREFIX = b"\x1a\x02\x18\x00"


def byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: visible ones for themselves, others from 256 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}


class _Ids:
    """Bytes of each id of a vocabulary."""

    def __init__(self, pieces: list[bytes]) -> None:
        self.size = np.array([len(p) for p in pieces], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.pool = np.frombuffer(b"".join(pieces), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        total = np.r_[0, np.cumsum(size)]
        return self.pool[np.repeat(self.start[ids] - total[:-1], size) + np.arange(total[-1])]


def _decimal(ids: np.ndarray, after: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Ids in decimal, each followed by its byte of ``after``; and where each ends."""
    width = len(str(int(ids.max(initial=0))))
    scale = 10 ** np.arange(width - 1, -1, -1)
    digits = np.empty((len(ids), width + 1), np.uint8)
    digits[:, :-1] = ids[:, None] // scale % 10 + 48
    digits[:, -1] = after
    used = np.ones(digits.shape, bool)
    used[:, :-1] = ids[:, None] >= scale
    used[:, -2] = True
    return digits[used].tobytes(), np.cumsum(used.sum(axis=1))


class Aligner:
    """Measures and links of texts by their distinct chunks; see the module."""

    def __init__(self, path_a: str, path_b: str) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        letters, vocabulary = byte_level(), self.a.get_vocab(with_added_tokens=True)
        pieces = [b""] * (max(vocabulary.values()) + 1)
        for token, k in vocabulary.items():
            pieces[k] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.ids_a = _Ids(pieces)
        with open(path_b, "rb") as f:
            proto = f.read()
        model = parse(proto)
        self.ids_b = _Ids([bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(MARK, " ").encode() for p, k in zip(model.pieces, model.kinds)])
        config = json.loads(self.a.to_str())
        splitter = config["pre_tokenizer"] or {}
        plain = not config["normalizer"] and splitter.get("type") == "ByteLevel" and splitter.get("use_regex") and not splitter.get("add_prefix_space")
        self.apart = bool(plain and model.falls_apart and not any("\n" in p or re.search(f"[{_LETTER}][.,]", p) for p in model.pieces))
        self.b = sentencepiece.SentencePieceProcessor(model_proto=proto + _NO_PREFIX if self.apart else proto)
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.pairs: dict[int, int] = {}
        self.codes = np.empty(0, np.int64)
        self.good, self.shown = np.empty(0, bool), []
        self.measures = np.empty((0, len(MEASURES)), np.int64)
        self.start, self.pool = np.empty(0, np.int64), np.empty(0, np.int32)

    @property
    def full(self) -> bool:
        return len(self.known) > KEEP or len(self.pool) > KEEP_LINKS or not self.apart and len(self.known) > 0

    def chunks(self, text: str) -> list[str]:
        """Keys of the chunks of space + text: without a lone space before them, with a zero before a stop."""
        if not self.apart:
            return [" " + text]
        # lone spaces and line breaks between other characters, stops after letters
        if " ".join(text.split()) == text.replace("\n", " ") and not _LOOSE.search(text) and "\0" not in text:
            return text.replace("\n", " \n").replace(".", " \0.").replace(",", " \0,").split(" ")
        return [c[1:] if c[0] == " " and c[1] not in " \n\0" else "\0" + c if c[0] in ".," else c for c in _CUT.split(" " + text)]

    @staticmethod
    def chunk(key: str) -> str:
        return key[1:] if key[0] == "\0" else key if key[0] in " \n" else " " + key

    def _together(self, raw: bytes, ends: np.ndarray) -> tuple | None:
        """Ids of chunks that stand one after another, with the number of each chunk's; nothing if bytes differ."""
        text, sides, counts = raw.decode(), [], []
        for ids, vocabulary in ((self.a.encode(text, add_special_tokens=False).ids, self.ids_a), (self.b.encode(text), self.ids_b)):
            side = np.array(ids, np.int64)
            token_ends = np.cumsum(vocabulary.size[side])
            last = np.searchsorted(token_ends, ends)
            if not len(side) or vocabulary.joined(side).tobytes() != raw or (token_ends[last] != ends).any():
                return None
            sides.append(side)
            counts.append(np.diff(last, prepend=-1))
        return sides, counts, np.ones(len(ends), bool)

    def _singly(self, raw: list[bytes]) -> tuple:
        """Ids of chunks by themselves, their numbers, and whether the bytes are the chunk's."""
        texts = [x.decode() for x in raw]
        listed = [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)], self.b.encode(texts if self.apart else [t[1:] for t in texts], num_threads=1)
        counts = [np.array([len(x) for x in ids], np.int64) for ids in listed]
        sides = [np.array([y for x in some for y in x], np.int64) for some in listed]
        good = np.ones(len(raw), bool)
        for side, n, vocabulary in zip(sides, counts, (self.ids_a, self.ids_b)):
            ends = np.r_[0, np.cumsum(vocabulary.size[side])][np.r_[0, np.cumsum(n)]]
            joined = vocabulary.joined(side).tobytes()
            good &= np.array([joined[i:j] == x for i, j, x in zip(ends[:-1].tolist(), ends[1:].tolist(), raw)])
        return sides, counts, good

    def _learn(self, keys: list[str]) -> None:
        loose = [not self.apart or t[0] not in " \n" or t[1].isspace() or t[-1].isspace() for t in map(self.chunk, keys)]
        lists: list[list] = [[], []]
        tallies: list[list] = [[], []]
        sound, sizes, order, run = [], [], [], []

        def out(some: list[str], together: bool) -> None:
            raw = [self.chunk(k).encode() for k in some]
            size = np.array([len(x) for x in raw], np.int64)
            found = self._together(b"".join(raw), np.cumsum(size)) if together else None
            sides, counts, good = found or self._singly(raw)
            for k in (0, 1):
                lists[k].append(sides[k])
                tallies[k].append(counts[k])
            sound.append(good)
            sizes.append(size)
            order.extend(some)

        held = 0
        for key, alone in zip(keys, loose):
            if alone:
                continue
            run.append(key)
            held += len(key)
            if held >= _RUN:
                out(run, True)
                run, held = [], 0
        for some, together in ((run, True), ([k for k, alone in zip(keys, loose) if alone], False)):
            if some:
                out(some, together)
        keys, size, good = order, np.concatenate(sizes), np.concatenate(sound)
        ids, counts = [np.concatenate(x) for x in lists], [np.concatenate(x) for x in tallies]
        ids = [side[np.repeat(good, n)] for side, n in zip(ids, counts)]
        ends_a, ends_b = np.cumsum(self.ids_a.size[ids[0]]), np.cumsum(self.ids_b.size[ids[1]])
        cuts, both = np.union1d(ends_a, ends_b), np.intersect1d(ends_a, ends_b, assume_unique=True)
        code = ids[0][np.searchsorted(ends_a, cuts)] << 32 | ids[1][np.searchsorted(ends_b, cuts)]
        # decimal groups: tokens of A, then of B, group by group
        group_a, group_b = np.searchsorted(both, ends_a), np.searchsorted(both, ends_b)
        at_a = np.arange(len(group_a)) + np.searchsorted(group_b, group_a, "left")
        at_b = np.arange(len(group_b)) + np.searchsorted(group_a, group_b, "right")
        order, after = np.empty(len(at_a) + len(at_b), np.int64), np.empty(len(at_a) + len(at_b), np.uint8)
        order[at_a], order[at_b] = ids
        after[at_a] = np.where(both[group_a] == ends_a, ord("|"), ord(","))
        after[at_b] = np.where(both[group_b] == ends_b, ord(";"), ord(","))
        shown, shown_ends = _decimal(order, after) if len(order) else (b"", np.empty(0, np.int64))
        # back to chunks
        chunk_ends = np.cumsum(np.where(good, size, 0))
        edges = [np.r_[0, np.searchsorted(some, chunk_ends, "right")] for some in (ends_a, ends_b, both, cuts)]
        measures = np.stack([np.diff(e) for e in edges], axis=1)
        text_ends = np.r_[0, shown_ends][edges[0] + edges[1]]
        self.shown += [shown[i : max(i, j - 1)] for i, j in zip(text_ends[:-1].tolist(), text_ends[1:].tolist())]
        distinct, inverse = np.unique(code, return_inverse=True)
        new = [c for c in distinct.tolist() if c not in self.pairs]
        self.pairs.update(zip(new, range(len(self.pairs), len(self.pairs) + len(new))))
        self.codes = np.append(self.codes, np.array(new, np.int64))
        place = np.fromiter(map(self.pairs.__getitem__, distinct.tolist()), np.int32, len(distinct))
        self.start = np.append(self.start, len(self.pool) + edges[3][:-1])
        self.pool = np.append(self.pool, place[inverse])
        self.measures, self.good = np.concatenate([self.measures, measures]), np.append(self.good, good)
        self.known.update(zip(keys, range(len(self.known), len(self.known) + len(keys))))

    def align(self, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Of texts that are not empty: measures, digest of the groups, and (text, pair, times) of distinct links."""
        parts = [self.chunks(t) for t in texts]
        missing = set(chain.from_iterable(parts)).difference(self.known)
        if missing:
            self._learn(list(missing))
        first = np.r_[0, np.cumsum([len(p) for p in parts])]
        at = np.fromiter(map(self.known.__getitem__, chain.from_iterable(parts)), np.int64, first[-1])
        # the bytes of a chunk can only shrink, so a chunk that differs makes its text differ
        good = np.minimum.reduceat(self.good[at], first[:-1])
        measures = np.add.reduceat(self.measures[at], first[:-1]) * good[:, None]
        shown, each = self.shown, at.tolist()
        digests = [hashlib.sha256(b";".join([shown[k] for k in each[i:j]])).hexdigest() if ok else "" for i, j, ok in zip(first[:-1].tolist(), first[1:].tolist(), good.tolist())]
        at, n_chunks = at[np.repeat(good, np.diff(first))], np.diff(first)[good]
        count = self.measures[at, MEASURES.index("n_links")]
        total = np.r_[0, np.cumsum(count)]
        linked = self.pool[np.repeat(self.start[at] - total[:-1], count) + np.arange(total[-1])]
        text = np.repeat(np.repeat(np.flatnonzero(good), n_chunks), count)
        key, times = np.unique(text * len(self.codes) + linked, return_counts=True)
        return measures, digests, (key // max(1, len(self.codes))).astype(np.int32), (key % max(1, len(self.codes))).astype(np.int32), times.astype(np.int32)


_aligners: dict[tuple[str, str], Aligner] = {}
_PACK = "zstd"
_BLOCK = ", ".join(["block long", "digest array<binary>", *(f"{m} array<long>" for m in MEASURES), "groups_sha256 array<string>", "links binary", "code array<long>", "documents array<long>"])


def _pack(*columns: np.ndarray) -> bytes:
    """Numbers of 32 bits, their bytes of equal weight side by side."""
    planes = [c.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes() for c in columns]
    data = b"".join([*(len(p).to_bytes(8, "little") for p in planes), *planes])
    return len(data).to_bytes(8, "little") + pa.compress(data, codec=_PACK, asbytes=True)


def _unpack(data: bytes, n: int) -> list[np.ndarray]:
    raw, at, out = pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec=_PACK, asbytes=True), 8 * n, []
    for k in range(n):
        size = int.from_bytes(raw[8 * k : 8 * k + 8], "little")
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, size, at).reshape(4, -1).T).view("<i4").ravel())
        at += size
    return out


class _Block:
    """What a block's texts have so far."""

    def __init__(self, number: int) -> None:
        self.number, self.bytes = number, 0
        self.digest, self.times, self.measures, self.groups, self.links = [], [], [], [], []

    def add(self, part: pa.RecordBatch, found: tuple) -> None:
        measures, groups, text, pair, times = found
        self.links.append((text + len(self.digest), pair, times))
        self.digest += part["digest"].to_pylist()
        self.times += part["times"].to_pylist()
        self.measures.append(measures)
        self.groups += groups

    def row(self, codes: np.ndarray) -> pa.RecordBatch:
        text, pair, times = (np.concatenate(x) for x in zip(*self.links))
        distinct, inverse, count = np.unique(pair, return_inverse=True, return_counts=True)
        # frequent pairs first: steps between a text's places are small then
        order = np.argsort(-count, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        documents = np.bincount(inverse, np.array(self.times, np.float64)[text], len(distinct)).astype(np.int64)[order]
        place = place[inverse]
        sort = np.lexsort((place, text))
        text, place, times = text[sort], place[sort], times[sort]
        new = np.r_[True, text[1:] != text[:-1]][: len(text)]
        step = np.where(new, place, np.diff(place, prepend=0))
        per_text = np.bincount(text, minlength=len(self.digest))
        measures = np.concatenate(self.measures)
        lists = [pa.array([self.digest], pa.list_(pa.binary())), *(pa.array([measures[:, k]]) for k in range(len(MEASURES))), pa.array([self.groups], pa.list_(pa.string()))]
        tail = [pa.array([_pack(per_text, step, times)], pa.binary()), pa.array([codes[distinct][order]], pa.list_(pa.int64())), pa.array([documents], pa.list_(pa.int64()))]
        names = ["block", "digest", *MEASURES, "groups_sha256", "links", "code", "documents"]
        return pa.RecordBatch.from_arrays([pa.array([self.number], pa.int64()), *lists, *tail], names=names)


def _blocks(path_a: str, path_b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (path_a, path_b) not in _aligners:
            _aligners[path_a, path_b] = Aligner(path_a, path_b)
        work, number = _aligners[path_a, path_b], TaskContext.get().partitionId() << 32
        block = _Block(number)
        for batch in batches:
            for part in slices(batch, limit=SLICE_BYTES):
                if block.digest and (work.full or block.bytes >= BLOCK_BYTES):
                    yield block.row(work.codes)
                    number += 1
                    block = _Block(number)
                if work.full:
                    work.clear()
                block.add(part, work.align(part["text"].to_pylist()))
                block.bytes += part["text"].nbytes
        if block.digest:
            yield block.row(work.codes)

    return run


_MEASURED = ", ".join(["digest binary", *(f"{m} long" for m in MEASURES), "groups_sha256 string", "n_best long", "count_sum long"])


def _weigh(block: pa.Table, counts: pa.Table) -> pa.Table:
    """Measures of a block's texts, with the sums over their links."""
    n = len(block["code"][0].values)
    total, best = np.zeros(n, np.int64), np.zeros(n, bool)
    at = counts["place"].to_numpy()
    total[at], best[at] = counts["total"].to_numpy(), counts["best"].to_numpy()
    per_text, step, times = _unpack(block["links"][0].as_py(), 3)
    first = np.r_[0, np.cumsum(per_text)]
    along = np.r_[0, np.cumsum(step, dtype=np.int64)]
    # steps start anew with each text
    place = along[1:] - np.repeat(along[first[:-1]], per_text)
    sums = [np.r_[0, np.cumsum(x)] for x in (times * best[place], times * total[place])]
    sums = [x[first[1:]] - x[first[:-1]] for x in sums]
    lists = [block[c].combine_chunks().flatten() for c in ("digest", *MEASURES, "groups_sha256")]
    return pa.Table.from_arrays([*lists, *map(pa.array, sums)], names=["digest", *MEASURES, "groups_sha256", "n_best", "count_sum"])


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each row of ``docs`` (doc_id, text)."""
    digest = F.unhex(F.sha2("text", 256))
    texts = docs.select("text").where("text <> ''").groupBy("text").agg(F.count("*").alias("times")).select(digest.alias("digest"), "text", "times")
    blocks = kept(texts.mapInArrow(_blocks(path_a, path_b), _BLOCK))
    entries = blocks.select("block", F.posexplode(F.arrays_zip("code", "documents")).alias("place", "entry")).select("block", "place", "entry.code", "entry.documents")
    of_a = Window.partitionBy(F.shiftright("code", 32))
    totals = entries.groupBy("code").agg(F.sum("documents").alias("total"))
    totals = totals.withColumn("best", F.col("total") == F.max("total").over(of_a))
    counts = entries.select("block", "place", "code").join(totals, "code").select(F.col("block").alias("of"), "place", "total", "best")
    measured = blocks.drop("documents").groupBy("block").cogroup(counts.groupBy("of")).applyInArrow(_weigh, _MEASURED)
    rows = docs.select("doc_id", F.when(F.col("text") != "", digest).alias("digest")).join(measured, "digest", "left")
    zeros = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in (*MEASURES, "n_best", "count_sum")]
    return rows.select("doc_id", *zeros, F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
