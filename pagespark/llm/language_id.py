"""Language identification: averaged hashed subword embeddings under a linear softmax.

Every run of 2, 3 and 4 bytes of a text (A-Z folded, digits, punctuation and white space read as
a blank) is a subword with an embedding; a text is the mean of its subwords' embeddings, and a
linear softmax reads it. Both are trained together by stochastic gradient descent in numpy, on a
bounded sample of labelled rows. A held-back part of the sample sets the temperature that makes
scores probabilities (1 at least: right answers alone never sharpen scores), and the score under
which a prediction is rejected: a low quantile of the right ones.

Prediction is one pass over the table without a shuffle: embeddings times softmax weights are one
table of logits by bucket (2 ** BITS rows, one column for each language), so a task sums rows of it.

Defined results: text that is null, empty or has no letter gives ``und`` with score 0, rejected;
without any labelled row every text gives ``und``. With one learned language every text with a letter is
of that language with score 1, and not rejected: there is nothing to weigh it against. Ties go to the language that sorts first. Rows
that repeat an id are predicted one by one; a null id counts as the empty text in the fold rule.
All other columns pass through ``predict`` untouched; one that bears an output's name, in any case of its
letters, is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagespark.llm import ngrams, words
from pagespark.llm.store import others

BITS = 16
ORDERS = (2, 3, 4)
WIDTH = 16
EPOCHS = 3
#: Bounds of the sample a model is fitted on.
PER_LANGUAGE, MOST_ROWS = 1000, 5000
#: Share of right predictions of the held-back part that may fall under the rejection score.
REJECT_SHARE = 0.002

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:65] = _FOLD[91:97] = _FOLD[123:128] = 32
_FOLD[65:91] = _FOLD[97:123]


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    logits: np.ndarray  # by bucket and language
    bias: np.ndarray
    temperature: float
    least_score: float


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that a model never learns from: one of five, by the id's checksum."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 5 == 0


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in words.slices(batch):
            data, offsets = words.buffers(part["text"])
            data, found = _FOLD[data], []
            for i, j in zip(offsets[:-1], offsets[1:]):
                ids = np.concatenate([ngrams.ngram_ids(data[i:j], n, BITS) for n in ORDERS])
                bucket, count = np.unique(ids, return_counts=True)
                weight = (count / max(1, len(ids))).astype(np.float32)
                found.append((bucket.astype(np.uint16).tobytes(), weight.tobytes()))
            yield pa.RecordBatch.from_arrays(
                [part["doc_id"], part["lang"], pa.array([x[0] for x in found], pa.binary()), pa.array([x[1] for x in found], pa.binary())],
                names=["doc_id", "lang", "bucket", "weight"],
            )


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(docs: DataFrame, seed: int = 7) -> Model:
    """Train on rows with text and a language that are not held out."""
    usable = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    ids = ngrams.stratified(usable.select("doc_id", "lang").distinct(), "doc_id", "lang", PER_LANGUAGE, MOST_ROWS)
    chosen = usable.select("doc_id", "text", "lang").join(F.broadcast(ids.select("doc_id", "lang")), ["doc_id", "lang"], "left_semi")
    found = chosen.select("doc_id", "text", "lang").mapInArrow(_features, "doc_id long, lang string, bucket binary, weight binary")
    one = found.groupBy("doc_id", "lang").agg(F.min(F.struct("bucket", "weight")).alias("f"))
    rows = one.select("doc_id", "lang", "f.*").orderBy(F.xxhash64("doc_id"), "doc_id", "lang").collect()
    languages = tuple(sorted({r["lang"] for r in rows}))
    if not languages:
        return Model((), np.zeros((1, 0), np.float32), np.zeros(0), 1.0, 1.0)
    x = [(np.frombuffer(r["bucket"], np.uint16), np.frombuffer(r["weight"], np.float32)) for r in rows]
    y = np.array([languages.index(r["lang"]) for r in rows])
    cut = len(x) - len(x) // 5
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / WIDTH, 1 / WIDTH, (1 << BITS, WIDTH)).astype(np.float32)
    out, bias = np.zeros((WIDTH, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    steps, step = EPOCHS * cut, 0
    for _ in range(EPOCHS):
        for k in rng.permutation(cut):
            bucket, weight = x[k]
            rate = np.float32(1.0 * (1 - step / steps))
            step += 1
            mean = weight @ table[bucket]
            error = _softmax(mean @ out + bias)
            error[y[k]] -= 1
            back = out @ error
            out -= rate * np.outer(mean, error)
            bias -= rate * np.float32(0.1) * error
            # a subword's own step grows with its share; the square root lets rare ones learn too
            table[bucket] -= (rate * 4 * np.sqrt(weight))[:, None] * back
    logits = table @ out
    check = range(cut, len(x)) if cut < len(x) else range(cut)
    z = np.array([x[k][1] @ logits[x[k][0]] + bias for k in check], np.float64)
    truth = y[list(check)]
    # repeated halving of the step over the logarithm of the temperature
    best, reach = 0.0, 2.0
    loss = lambda t: -np.log(_softmax(z / np.exp(t))[np.arange(len(z)), truth] + 1e-12).mean()
    for _ in range(24):
        best = min((best, max(0.0, best - reach), best + reach), key=loss)
        reach *= 0.7
    p = _softmax(z / np.exp(best))
    right = np.sort(p.max(axis=1)[p.argmax(axis=1) == truth])
    least = float(right[int(len(right) * REJECT_SHARE)]) if len(right) else 0.5
    return Model(languages, logits.astype(np.float32), bias.astype(np.float64), float(np.exp(best)), least)


def _predictor(model: Model):
    """Batches with one column ``text`` first; the prediction's columns are put after the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.languages, "und"], dtype=object)
        columns = [np.ascontiguousarray(model.logits[:, k]) for k in range(len(model.languages))]
        for batch in batches:
            for part in words.slices(batch):
                data, offsets = words.buffers(part["text"])
                data = _FOLD[data]
                n = len(part)
                total, count = np.zeros((n, len(columns))), np.zeros(n)
                for order in ORDERS if columns else ():
                    ids = ngrams.ngram_ids(data, order, BITS)
                    start = np.minimum(offsets[:-1], len(ids))
                    end = np.maximum(start, offsets[1:] - order + 1)
                    count += end - start
                    for k, column in enumerate(columns):
                        run_sum = np.zeros(len(ids) + 1)
                        np.cumsum(column[ids], dtype=np.float64, out=run_sum[1:])
                        total[:, k] += run_sum[end] - run_sum[start]
                if columns:
                    p = _softmax((total / np.maximum(count, 1)[:, None] + model.bias) / model.temperature)
                    pick, score = p.argmax(axis=1), p.max(axis=1)
                else:
                    pick, score = np.zeros(n, int), np.zeros(n)
                for k, text in enumerate(part["text"]):
                    text = text.as_py()
                    if not columns or not any(map(str.isalpha, text or "")):
                        pick[k], score[k] = len(columns), 0.0
                lang = pa.array(names[pick].tolist(), pa.string())
                und = pick == len(columns)
                gone = pa.array(und | (score < model.least_score))
                yield pa.RecordBatch.from_arrays([*part.columns, lang, pa.array(score), gone], names=[*map(str, range(len(part.columns) + 3))])

    return run


def predict(docs: DataFrame, model: Model, lang: str = "lang_pred", score: str = "score", rejected: str = "lang_rejected") -> DataFrame:
    """All columns of ``docs`` with the language, its probability, and whether it is rejected."""
    keep = others(docs, lang, score, rejected)
    rest = [c for c in keep if c != "text"]
    rows = docs.select("text", *(f"`{c}`" for c in rest))
    fields = [T.StructField(str(i), f.dataType) for i, f in enumerate(rows.schema.fields)]
    n = len(fields)
    schema = T.StructType([*fields, T.StructField(str(n), T.StringType()), T.StructField(str(n + 1), T.DoubleType()), T.StructField(str(n + 2), T.BooleanType())])
    inner = rows.toDF(*(["text", *map(str, range(1, n))]))
    out = inner.mapInArrow(_predictor(model), schema).toDF("text", *rest, lang, score, rejected)
    return out.select(*(f"`{c}`" for c in keep), lang, score, rejected)
