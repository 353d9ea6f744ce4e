"""Removal of repeated passages by overlapping windows of three lines.

A document's lines (split at line feeds) that hold a word are compared by their words, whatever the
white space between them. Every three consecutive such lines are a window, hashed to 128 bits. A
window found more than once in the table keeps its first occurrence, by (doc_id, position); every
later one covers its three lines, covered lines are merged and removed, and the rest of the text
stands as it was. A line without a word forms no window; it goes only inside a covered window.

Plan: one pass hashes windows (numbers, no text); counting them combines before the shuffle, so a
window in a third of all documents is one row from each task; later occurrences are joined to the
firsts, which Spark can split for a frequent window; covered lines come back to the texts by one
join on the row's key.

Defined results: null text stays null, empty text empty, fewer than three lines with words stay.
Null ids sort first. Rows that repeat an id and a text are one document: they keep or lose the same
lines. Rows that repeat an id with other texts are told apart by their text, in order of its hash.
A text whose lines all go is empty. Other columns pass through; one that bears an output's name, in any
case of its letters, is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagespark.llm import words
from pagespark.llm.store import fresh, kept, others, row_key

WINDOW = 3
_OTHER = np.uint64(0xA5A5B6B6C7C7D8D9)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in words.slices(batch):
            data, offsets = words.buffers(part["text"])
            starts, ends, _ = words.spans(data, offsets)
            hashes = words.span_hashes(data, starts, ends)
            # a line is known by (document, line feeds before it in the document)
            feeds = np.flatnonzero(data == 10)
            doc = np.searchsorted(offsets, starts, "right") - 1
            line = np.searchsorted(feeds, starts) - np.searchsorted(feeds, offsets[:-1])[doc]
            new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (line[1:] != line[:-1])]) if len(starts) else np.empty(0, int)
            if len(new) >= WINDOW:
                size = np.diff(np.r_[new, len(starts)])
                place = np.arange(len(starts)) - np.repeat(new, size)
                of_line = []
                for seed in (np.uint64(0), _OTHER):
                    # a word's place is mixed in, so the sum stands for the order of words too
                    value = words.mix(words.mix(hashes ^ seed) + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                    of_line.append(words.mix(np.add.reduceat(value, new) + size.astype(np.uint64)))
                doc, line = doc[new], line[new]
                whole = np.flatnonzero(doc[WINDOW - 1 :] == doc[: len(doc) - WINDOW + 1])
                first, second = (words.shingles(h, WINDOW)[whole] for h in of_line)
                rows = pa.array(doc[whole])
                lines = np.stack([line[whole + k] for k in range(WINDOW)], axis=1).astype(np.int32)
                flat = pa.array(lines.reshape(-1))
                at = pa.FixedSizeListArray.from_arrays(flat, WINDOW).cast(pa.list_(pa.int32()))
                ids, keys, one, two = part["doc_id"].take(rows), part["row"].take(rows), pa.array(first.view(np.int64)), pa.array(second.view(np.int64))
                yield pa.RecordBatch.from_arrays([ids, keys, at, one, two], names=["doc_id", "row", "lines", "h1", "h2"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns text, gone and others to the others, the text that is left, its lines before, and those gone."""
    for batch in batches:
        for part in words.slices(batch):
            texts, counts, removed = [], [], []
            for text, gone in zip(part["text"].to_pylist(), part["gone"].to_pylist()):
                counts.append(0 if text is None else text.count("\n") + 1)
                removed.append(len(gone or ()))
                if gone:
                    gone = set(gone)
                    text = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)
                texts.append(text)
            made = [pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(removed, pa.int64())]
            columns = [*part.columns[2:], *made]
            yield pa.RecordBatch.from_arrays(columns, names=[str(i) for i in range(len(columns))])


def dedup_lines(docs: DataFrame, removed: str = "n_removed", lines: str = "n_lines") -> DataFrame:
    """All columns of ``docs``, the text without later occurrences of repeated windows, and two counts."""
    base = docs.select("doc_id", "text").withColumn("row", row_key())
    # occurrences are read twice, to find the first and then the later ones
    found = kept(base.select("doc_id", "row", "text").mapInArrow(_windows, "doc_id long, row long, lines array<int>, h1 long, h2 long"))
    found = found.withColumn("place", F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "row", F.col("lines")[0].alias("line")))
    repeated = found.groupBy("h1", "h2").agg(F.min("place").alias("first"), F.count("*").alias("times")).where("times > 1")
    later = found.join(repeated.drop("times"), ["h1", "h2"]).where("place > first")
    covered = later.select("row", F.explode(F.sequence(F.col("lines")[0], F.col("lines")[WINDOW - 1])).alias("line"))
    gone = covered.groupBy("row").agg(F.collect_set("line").alias("gone"))
    key, cut = fresh(docs, "row", "gone")
    rows = docs.withColumn(key, row_key()).join(gone.toDF(key, cut), key, "left")
    keep = others(docs, removed, lines)
    rest = [c for c in keep if c != "text"]
    inner = rows.select("text", F.col(cut).alias("gone"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)))
    fields = [T.StructField(str(i), docs.schema[c].dataType) for i, c in enumerate(rest)]
    fields += [T.StructField(str(len(rest) + i), t) for i, t in enumerate((T.StringType(), T.LongType(), T.LongType()))]
    out = inner.mapInArrow(_cut, T.StructType(fields)).toDF(*rest, "text", lines, removed)
    return out.select(*(f"`{c}`" for c in keep), lines, removed)
