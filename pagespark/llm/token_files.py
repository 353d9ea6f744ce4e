"""Token ids of documents in files of Simple-8b blocks, written and read by tasks.

Documents are dealt to tasks by ranges of (doc_id, hash of text), so files follow one another in
ascending order of doc_id and a repeated id does not fall to one task alone. A task encodes texts in
slices and writes blocks as they fill; it holds one slice and the file's tables of documents and
blocks.

File: ``S8B1``; then sections of at most SECTION ids: words of all its blocks. At the end, the
footer, compressed: per section its place, ids and words; per block its first word in the section;
per document its id, whether it is known, and its number of ids; and the footer's size in 8 bytes.

Encoding: the tokenizer reads nothing across white space (its normaliser and splitter work word by
word) and lowers A-Z, so each distinct word of a slice is encoded once by the library, and known words are
kept for the following slices, up to KEEP words. Words that end in signs which the splitter takes apart
anyway are cut there. ``encode_whole`` is the plain call on whole texts that tests compare with.

Defined results: null and empty texts have the end id alone. Null ids come first. Rows that repeat
an id follow each other by the hash of their text. An empty table gives no rows. Extra columns are left out.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagespark.llm import files, simple8b, words
from pagespark.llm.store import kept, shared

END_ID = 2
SECTION = 512 * simple8b.BLOCK
#: Distinct words that a worker remembers.
KEEP = 1_500_000
#: Large slices have each distinct word looked up less often.
SLICE_BYTES = 2 << 20
_MAGIC = b"S8B1"
_LOOSE = np.zeros(256, bool)
_LOOSE[[ord(c) for c in ".,;:!?*#$%&"]] = True
_PLAIN = np.zeros(256, bool)
_PLAIN[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
#: Stands between words that are encoded in one call; it is a word of its own.
_MARK = "\x01"


class WordEncoder:
    """Ids of texts by their distinct words, the same as the library gives for whole texts."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.mark = self.library.encode(_MARK, add_special_tokens=False).ids
        self.clear()

    def clear(self) -> None:
        self.known, self.slot = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.start, self.count, self.pool = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint32)

    def encode_whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch(texts, add_special_tokens=False)]

    def _learn(self, new: np.ndarray, texts: list[str]) -> None:
        """Encode words of which none is known; ``new`` are their hashes, sorted."""
        counts, pools = [], []
        for i in range(0, len(texts), 1024):
            some = texts[i : i + 1024]
            joined = f" {_MARK} ".join(some)
            ids = np.array(self.library.encode(joined, add_special_tokens=False).ids, np.uint32)
            marks = np.flatnonzero(ids == self.mark[0]) if len(self.mark) == 1 else []
            if len(marks) == len(some) - 1 == joined.count(_MARK):
                counts.append(np.diff(np.r_[-1, marks, len(ids)]) - 1)
                pools.append(np.delete(ids, marks))
            else:  # a word holds the mark
                single = [e.ids for e in self.library.encode_batch_fast(some, add_special_tokens=False)]
                counts.append(np.array([len(x) for x in single]))
                pools.append(np.array([y for x in single for y in x], np.uint32))
        count = np.concatenate(counts)
        start = len(self.pool) + np.cumsum(count) - count
        at = np.searchsorted(self.known, new)
        self.slot = np.insert(self.slot, at, np.arange(len(self.start), len(self.start) + len(new)))
        self.known = np.insert(self.known, at, new)
        self.start, self.count = np.append(self.start, start), np.append(self.count, count)
        self.pool = np.concatenate([self.pool, *pools])

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the number of each text's ids."""
        starts, ends, _ = words.spans(data, offsets)
        if not len(starts):
            return np.empty(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        # where a word's signs begin, if a letter or digit stands before them
        tail = ends.copy()
        loose = np.flatnonzero(_LOOSE[data[ends - 1]])
        while len(loose):
            tail[loose] -= 1
            loose = loose[(tail[loose] > starts[loose])]
            loose = loose[_LOOSE[data[tail[loose] - 1]]]
        cut = np.flatnonzero((tail < ends) & (tail > starts))
        cut = cut[_PLAIN[data[tail[cut] - 1]]]
        extra = tail[cut]
        # both lists stay in order: cut-off signs start after their word and before the next
        starts, tails = np.sort(np.r_[starts, extra]), np.sort(np.r_[ends, extra])
        first = np.searchsorted(starts, offsets)
        # the normaliser lowers A-Z, but the special tokens' strings stand before it
        raw = data.tobytes()
        hashes = words.span_hashes(data, starts, tails, lower=b"<|" not in raw)
        distinct, where, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known) > KEEP:
            self.clear()
        at = np.minimum(np.searchsorted(self.known, distinct), max(0, len(self.known) - 1))
        missing = np.flatnonzero(self.known[at] != distinct) if len(self.known) else np.arange(len(distinct))
        if len(missing):
            self._learn(distinct[missing], [raw[starts[i] : tails[i]].decode() for i in where[missing]])
            at = np.searchsorted(self.known, distinct)
        slot = self.slot[at][inverse]
        count = self.count[slot]
        total = np.r_[0, np.cumsum(count)]
        take = np.repeat(self.start[slot] - total[:-1], count) + np.arange(total[-1])
        return self.pool[take], total[first[1:]] - total[first[:-1]]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One for each worker, which keeps the words it knows from task to task."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


class Writer:
    """One file: ids go in by documents, blocks go out as sections fill."""

    def __init__(self, uri: str) -> None:
        self.out, self.at, self.waiting, self.n = files.writer(uri), 4, [], 0
        self.sections, self.blocks, self.docs = [], [], []
        self.out.write(_MAGIC)

    def add(self, ids: np.ndarray, doc_ids: list[int | None], counts: np.ndarray) -> None:
        self.docs.append((np.array([x or 0 for x in doc_ids], np.int64), np.array([x is not None for x in doc_ids], np.uint8), counts.astype(np.int64)))
        self.waiting.append(ids)
        self.n += len(ids)
        while self.n >= SECTION:
            self._section(SECTION)

    def _section(self, n: int) -> None:
        every = np.concatenate(self.waiting) if self.waiting else np.empty(0, np.uint32)
        coded, offsets = simple8b.encode(every[:n])
        self.out.write(coded.tobytes())
        self.sections.append((self.at, len(every[:n]), len(coded)))
        self.blocks.append(offsets)
        self.at += 8 * len(coded)
        self.waiting, self.n = [every[n:]], len(every) - n if len(every) > n else 0

    def close(self) -> tuple[int, int]:
        """Number of documents and of ids."""
        if self.n:
            self._section(self.n)
        docs = [np.concatenate(c) if self.docs else np.empty(0, np.int64) for c in (zip(*self.docs) if self.docs else ((), (), ()))]
        tables = [np.array(self.sections, np.int64).reshape(-1), np.concatenate([np.empty(0, np.int64), *self.blocks]), docs[0], docs[1].astype(np.int64), docs[2]]
        head = json.dumps([len(t) for t in tables]).encode()
        body = zlib.compress(b"".join(t.astype(np.int64).tobytes() for t in tables), 1)
        self.out.write(struct.pack("<I", len(head)) + head + body)
        self.out.write(struct.pack("<Q", 4 + len(head) + len(body)))
        self.out.close()
        return len(docs[0]), int(docs[2].sum())


def read(uri: str) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """Documents' ids, numbers of token ids, and those token ids, section by section."""
    with files.reader(uri) as source:
        size = source.size()
        source.seek(size - 8)
        (footer,) = struct.unpack("<Q", source.read(8))
        source.seek(size - 8 - footer)
        raw = source.read(footer)
        (n,) = struct.unpack("<I", raw[:4])
        flat = np.frombuffer(zlib.decompress(raw[4 + n :]), np.int64)
        sections, blocks, doc_ids, known, counts = np.split(flat, np.cumsum(json.loads(raw[4 : 4 + n]))[:-1])
        ends, carry, d, block = np.cumsum(counts), np.empty(0, np.uint32), 0, 0
        seen = 0
        for at, ids, coded in sections.reshape(-1, 3).tolist():
            source.seek(at)
            offsets = blocks[block : block + -(-ids // simple8b.BLOCK) + 1]
            block += len(offsets)
            carry = np.r_[carry, simple8b.decode(np.frombuffer(source.read(8 * coded), np.uint64), offsets, ids).astype(np.uint32)]
            seen += ids
            last = int(np.searchsorted(ends, seen, "right"))
            if last > d:
                take = int(counts[d:last].sum())
                yield [int(x) if k else None for x, k in zip(doc_ids[d:last], known[d:last])], counts[d:last], carry[:take]
                carry, d = carry[take:], last


def _write(folder: str, tokenizer: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out, uri = TaskContext.get().partitionId(), None, ""
        code = encoder(tokenizer)
        for batch in batches:
            for some in words.slices(batch, limit=SLICE_BYTES):
                if out is None:
                    uri = files.new_name(folder, part, ".s8b")
                    out = Writer(uri)
                ids, counts = code.encode(*words.buffers(some["text"]))
                ids = np.insert(ids, np.cumsum(counts), np.uint32(end_id))
                out.add(ids, some["doc_id"].to_pylist(), counts + 1)
        if out is not None:
            docs, n = out.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "uri": [uri], "n_docs": [docs], "n_ids": [n]})

    return run


def write(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Write files; returns the table of them: part, uri, n_docs, n_ids and start (ids of all parts before)."""
    spark = docs.sparkSession
    folder = f"{shared(spark)}/tokens"
    files.make_folder(folder)
    tie = F.xxhash64("text")
    rows = docs.select("doc_id", "text", tie.alias("tie")).repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    found = kept(rows.select("doc_id", "text").mapInArrow(_write(folder, tokenizer, end_id), "part long, uri string, n_docs long, n_ids long"))
    # one row for each file
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return found.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for uri, start in zip(batch["uri"].to_pylist(), batch["start"].to_pylist()):
            for doc_ids, counts, ids in read(uri):
                ends = np.cumsum(counts)
                raw, own = ids.astype("<u4").tobytes(), start + ends - counts
                sums = [zlib.crc32(raw[4 * (e - c) : 4 * e]) for c, e in zip(counts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(own), pa.array(counts), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                start += int(counts.sum())


def digests(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read back from the files."""
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("part", "uri", "start").repartition(n, "part").mapInArrow(_digest, "doc_id long, start long, n_tokens long, ids_crc32 long")
