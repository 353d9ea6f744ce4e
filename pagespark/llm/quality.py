"""Quality classification by co-training on two views of a document.

* **Content view**: hashed byte 3-grams of the text (square roots of shares), and how far words
  repeat: share of words equal to the one before, of distinct words, of distinct 3-word runs.
* **Metadata view**: what a crawl records about a page and its layout: source and language
  (hashed), length, number and length of lines, shares of kinds of characters. No word is read.

Each view has its own logistic classifier. In each round both are fitted, both judge every unlabelled
document, and each hands its ``HANDED`` most confident answers of each class to the *other* as labels.
Then each view is calibrated (Platt scaling) and the two are combined by a logistic model, both on
labelled rows that took no part in fitting, and the mix of classes is put back to that of all labels.

Plan: features of all documents are made once and kept as a table; they never move. A round is one pass
over the table: tasks judge their rows, the confident answers (five numbers each) leave out the labelled
documents, equal contents combine (a group of copies hands over one label), and limits ranked in ``SALTS`` parts
leave four short lists, whose features alone reach the driver. Labelled rows are a bounded sample (``PER_CLASS``); unlabelled ones are all of the table.
One pass without a shuffle then scores every document's whole text.

Defined results: a null or empty text has an empty content view and is scored by both views like
any other; null source or language is a value of its own. Several labels of one id: the lowest
counts. Several rows of one id: one is used to fit, all are scored. A null id is scored only. Without labels of both classes
nothing can be learned: scores are null and every document is kept. An empty table gives no rows.
Other columns pass through; one that bears an output's name, in any case of its letters, is replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagespark.llm import ngrams, words
from pagespark.llm.store import kept, others

BITS = 11
TEXT = (1 << BITS) + 3
HASHED, LAYOUT = 64, 11
META = 2 * HASHED + LAYOUT
#: Bound of the labelled sample, for each class.
PER_CLASS = 1500
#: Rounds, and the labels of each class that a view hands over in one: a step of the method, whatever the table's size.
ROUNDS, HANDED = 4, 200
#: Parts in which answers are ranked before the last ranking, which so reads at most ``SALTS * HANDED`` rows of a list.
SALTS = 16
#: Rows judged at a time.
_ROWS = 1024
#: A pseudo-label is handed over only from this probability on.
CONFIDENT = 0.97
KEEP_FROM = 0.5

_KIND = np.zeros(256, np.int64)  # 0 other, 1 upper case, 2 digit, 3 .,;:'"-()?! , 4 other ASCII sign, 5 beyond ASCII, 6 white space
_KIND[65:91], _KIND[48:58], _KIND[128:] = 1, 2, 5
_KIND[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 4
_KIND[[ord(c) for c in ".,;:'\"-()?!"]] = 3
_KIND[words.SPACE] = 6


def _views(part: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Content and metadata features of each row."""
    data, offsets = words.buffers(part["text"])
    starts, ends, first = words.spans(data, offsets)
    hashes = words.span_hashes(data, starts, ends)
    sources, langs = (part[c].to_pylist() for c in ("source", "lang"))
    for d in range(len(part)):
        i, j = int(offsets[d]), int(offsets[d + 1])
        own, h = data[i:j], hashes[first[d] : first[d + 1]]
        text, meta = np.zeros(TEXT, np.float32), np.zeros(META, np.float32)
        if j - i >= 3:
            text[: 1 << BITS] = np.sqrt(np.bincount(ngrams.ngram_ids(own, 3, BITS), minlength=1 << BITS) / (j - i - 2))
        if len(h) > 1:
            runs = words.shingles(h, min(3, len(h)))
            text[-3:] = (h[1:] == h[:-1]).mean(), len(np.unique(h)) / len(h), len(np.unique(runs)) / len(runs)
        for at, value in ((0, sources[d]), (HASHED, langs[d])):
            meta[at + (zlib.crc32(value.encode()) if value is not None else 0) % HASHED] = 1
        kinds = np.bincount(_KIND[own], minlength=7) / max(1, j - i)
        lines = int((own == 10).sum()) + 1
        meta[2 * HASHED :] = [np.log1p(j - i) / 10, np.log1p(lines) / 5, np.log1p((j - i) / lines) / 8, *kinds[1:], len(h) / max(1, j - i), 1]
        yield text, meta


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in words.slices(batch):
            found = [(t.astype(np.float16).tobytes(), m.tobytes()) for t, m in _views(part)]
            yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array([x[0] for x in found], pa.binary()), pa.array([x[1] for x in found], pa.binary())], names=["doc_id", "content", "meta"])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float, steps: int = 150) -> np.ndarray:
    """Weights (the intercept is last) by gradient steps with momentum scaled per weight (Adam)."""
    w, m, v = (np.zeros(x.shape[1] + 1) for _ in range(3))
    weight = weight / weight.sum()
    for t in range(1, steps + 1):
        error = ((_sigmoid(x @ w[:-1].astype(x.dtype) + w[-1]) - y) * weight).astype(x.dtype)
        g = np.append(error @ x, error.sum()) + l2 * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


def _balanced(y: np.ndarray) -> np.ndarray:
    """Weights that give both classes the same sum; rows of -1 have none."""
    ones, zeros = max(1, (y == 1).sum()), max(1, (y == 0).sum())
    return np.select([y == 1, y == 0], [0.5 / ones, 0.5 / zeros], 0.0)


@dataclass(frozen=True)
class View:
    """Standardisation, weights and calibration of one classifier."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        raw = ((x - self.mean) / self.scale) @ self.weights[:-1] + self.weights[-1]
        return np.clip(self.slope * raw + self.shift, -12, 12)


@dataclass(frozen=True)
class Model:
    content: View
    meta: View
    combine: np.ndarray
    #: Pseudo-labels that each view got from the other.
    handed: tuple[int, int]


def _standardise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and scale of each feature; ``x`` itself becomes the standardised matrix."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + np.float32(1e-2) * (x.std() + np.float32(1e-3))
    if len(mean) == TEXT:  # the three figures of repetition stand beside two thousand shares
        scale[-3:] /= 10
    x -= mean
    x /= scale
    return mean, scale


def _raw(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1].astype(x.dtype) + w[-1]


def _matrices(content: list[bytes], meta: list[bytes]) -> list[np.ndarray]:
    return [
        np.frombuffer(b"".join(content), np.float16).astype(np.float32).reshape(-1, TEXT),
        np.frombuffer(b"".join(meta), np.float32).reshape(-1, META).copy(),
    ]


def _confident(forms: list, fitted: list[np.ndarray], had: list[np.ndarray]):
    """The confident answers on all rows: for which view, its label, the teacher's certainty, and the row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), _ROWS):
                part = batch.slice(i, _ROWS)
                ids, keys = part["doc_id"].to_numpy(), part["key"].to_numpy()
                x = _matrices(part["content"].to_pylist(), part["meta"].to_pylist())
                for teacher, pupil in ((0, 1), (1, 0)):
                    mean, scale = forms[teacher]
                    p = _sigmoid(_raw((x[teacher] - mean) / scale, fitted[teacher])).astype(np.float64)
                    fresh = ~np.isin(keys, had[pupil])
                    for label, sure in ((0, 1 - p), (1, p)):
                        at = np.flatnonzero(fresh & (sure >= CONFIDENT))
                        n = len(at)
                        columns = [np.full(n, pupil, np.int32), np.full(n, label, np.int32), sure[at], keys[at], ids[at]]
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["pupil", "label", "sure", "key", "doc_id"])

    return run


def _handed(views: DataFrame, label: DataFrame, forms: list, fitted: list[np.ndarray], had: list[np.ndarray]) -> list:
    """At most ``HANDED`` rows with features for each view and label, most confident first, one of each content."""
    found = views.mapInArrow(_confident(forms, fitted, had), "pupil int, label int, sure double, key long, doc_id long")
    found = found.join(label.select("doc_id"), "doc_id", "left_anti")
    # the greatest certainty, and of equal ones the smallest id
    one = found.groupBy("pupil", "label", "key").agg(F.max(F.struct("sure", (-F.col("doc_id")).alias("minus"))).alias("best"))
    best = one.withColumn("salt", F.pmod("key", F.lit(SALTS)))
    for parts in (["pupil", "label", "salt"], ["pupil", "label"]):
        rank = F.row_number().over(Window.partitionBy(*parts).orderBy(F.desc("best.sure"), F.xxhash64("key"), "key"))
        best = best.withColumn("rank", rank).where(F.col("rank") <= HANDED)
    best = best.select("pupil", "label", "rank", "key", (-F.col("best.minus")).alias("doc_id"))
    rows = views.join(F.broadcast(best), ["key", "doc_id"]).groupBy("pupil", "label", "rank", "key")
    return rows.agg(F.min(F.struct("content", "meta")).alias("f")).orderBy("pupil", "label", "rank").collect()


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Co-train on the documents that ``labels`` (doc_id, quality 0 or 1) covers and all others."""
    label = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    share = {r["quality"]: r["count"] for r in label.groupBy("quality").count().collect()}
    if len(share) < 2:
        return None
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source", "lang")
    views = texts.mapInArrow(_features, "doc_id long, content binary, meta binary")
    views = kept(views.withColumn("key", F.xxhash64("content", "meta")))
    label = label.select(F.col("doc_id").cast("long").alias("doc_id"), "quality")
    chosen = ngrams.stratified(views.select("doc_id").distinct().join(label, "doc_id"), "doc_id", "quality", PER_CLASS, 2 * PER_CLASS)
    one = views.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min(F.struct("content", "meta")).alias("f"))
    rows = one.orderBy(F.xxhash64("doc_id"), "doc_id").select("quality", "f.*").collect()
    y = np.array([r["quality"] for r in rows], int)
    if len(set(y)) < 2:
        return None
    x = _matrices([r["content"] for r in rows], [r["meta"] for r in rows])
    del rows
    labelled = np.arange(len(y))
    held = labelled[::4] if len(set(y[::4])) == 2 and len(set(np.delete(y, np.s_[::4]))) == 2 else labelled
    base = np.setdiff1d(labelled, held) if len(held) < len(labelled) else labelled
    forms = [_standardise(xv) for xv in x]
    truth, tests = y[held], [xv[held] for xv in x]
    # what each view has learned from so far
    known, own, had = [xv[base] for xv in x], [y[base], y[base]], [np.empty(0, np.int64)] * 2
    for step in range(ROUNDS + 1):
        fitted = [_logistic(xv, yv, _balanced(yv), 1e-3) for xv, yv in zip(known, own)]
        if step == ROUNDS:
            break
        got = _handed(views, label, forms, fitted, had)
        for pupil in (0, 1):
            new = [r for r in got if r["pupil"] == pupil]
            if new:
                found = _matrices([r["f"]["content"] for r in new], [r["f"]["meta"] for r in new])[pupil]
                known[pupil] = np.concatenate([known[pupil], (found - forms[pupil][0]) / forms[pupil][1]])
                own[pupil] = np.append(own[pupil], [r["label"] for r in new])
                had[pupil] = np.append(had[pupil], [r["key"] for r in new])
        if not got:
            break
    views, both = [], np.zeros((len(held), 2))
    for k, (xv, w) in enumerate(zip(tests, fitted)):
        raw = _raw(xv, w)
        size = np.std(raw) + 1e-6
        slope, shift = _logistic((raw / size)[:, None], truth, _balanced(truth), 1e-3)
        views.append(View(*forms[k], w, float(slope / size), float(shift)))
        both[:, k] = np.clip(slope / size * raw + shift, -12, 12)
    combine = _logistic(both / 4, truth, _balanced(truth), 1e-3)
    combine[:2] /= 4
    combine[2] += np.log(share[1] / share[0])
    return Model(views[0], views[1], combine, (len(had[0]), len(had[1])))


def _scorer(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.slices(batch):
                z = np.array([(model.content.logit(t), model.meta.logit(m)) for t, m in _views(part)], np.float64).reshape(-1, 2)
                score = _sigmoid(z @ model.combine[:2] + model.combine[2])
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, *(pa.array(c) for c in (_sigmoid(z[:, 0]), _sigmoid(z[:, 1]), score, score >= KEEP_FROM))],
                    names=[*part.schema.names, *(str(len(part.schema.names) + k) for k in range(4))],
                )

    return run


def score(docs: DataFrame, model: Model | None, names: tuple[str, str, str, str] = ("content_score", "metadata_score", "quality_score", "kept")) -> DataFrame:
    """All columns of ``docs`` with both views' calibrated scores, the combined one, and the verdict."""
    keep = others(docs, *names)
    if model is None:
        nothing = F.lit(None).cast("double")
        return docs.select(*(f"`{c}`" for c in keep), *(nothing.alias(c) for c in names[:3]), F.lit(True).alias(names[3]))
    rest = [c for c in keep if c not in ("text", "source", "lang")]
    rows = docs.select("text", "source", "lang", *(f"`{c}`" for c in rest))
    inner = ["text", "source", "lang", *map(str, range(3, len(rows.columns)))]
    n = len(inner)
    schema = T.StructType([T.StructField(c, f.dataType) for c, f in zip(inner, rows.schema.fields)] + [T.StructField(str(n + k), T.DoubleType() if k < 3 else T.BooleanType()) for k in range(4)])
    out = rows.toDF(*inner).mapInArrow(_scorer(model), schema).toDF("text", "source", "lang", *rest, *names)
    return out.select(*(f"`{c}`" for c in keep), *names)
