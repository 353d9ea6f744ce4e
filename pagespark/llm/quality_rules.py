"""Quality rules as a short-circuit cascade.

A rule rejects a document by a few figures of its text. Figures come in groups (``GROUPS``) that
cost differently. On a bounded sample, a first pass measures what each group costs and which
documents each rule rejects. Rules are then ordered by rejection per cost: the next rule is the one
that rejects most of the sample's survivors for each second that its missing figures take. The
second pass runs the rules in that order on every document and stops at the first that rejects, so
dear figures are made for survivors only: a text that a cheap rule has rejected never has its word pairs
counted or its letters weighed. The order decides cost and the name of the rejecting rule, never the verdict.

One pass over the table, no shuffle. Defined results: null and empty texts have no words and all
figures 0; equal documents get equal figures; null and repeated ids pass through; an empty table
gives no rows (and the rules keep their written order). Other columns pass through; one that bears an
output's name, in any case of its letters, is replaced.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagespark.llm import words
from pagespark.llm.store import others

#: Rows of the sample on which cost and selectivity are estimated.
SAMPLE_ROWS = 2000

Figures = dict[str, np.ndarray]
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def _sums(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """True values of a mask over bytes, by text."""
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _counts(data: np.ndarray, offsets: np.ndarray) -> Figures:
    space = words.SPACE[data]
    starts = ~space
    starts[1:] &= space[:-1]
    edge = offsets[:-1][offsets[:-1] < len(data)]
    starts[edge] = ~space[edge]
    return {
        "n_words": _sums(starts, offsets),
        "word_chars": _sums(~space & ((data & 0xC0) != 0x80), offsets),
        "n_symbols": _sums(_SYMBOL[data], offsets),
        "n_upper": _sums((data >= 65) & (data <= 90), offsets),
        "n_lower": _sums((data >= 97) & (data <= 122), offsets),
    }


def _lines(data: np.ndarray, offsets: np.ndarray) -> Figures:
    """Lines with a word, and those of them that equal an earlier one."""
    feeds = np.flatnonzero(data == 10)
    starts = np.union1d(feeds + 1, offsets[:-1])
    ends = np.union1d(feeds, offsets[1:])
    starts = starts[starts < len(data)]
    starts = starts[data[starts] != 10]  # an empty line has no word
    ends = ends[np.searchsorted(ends, starts, "right")]
    worded = np.zeros(len(data) + 1, np.int64)
    np.cumsum(~words.SPACE[data], out=worded[1:])
    own = worded[ends] > worded[starts]
    starts, ends = starts[own], ends[own]
    n = len(offsets) - 1
    doc = np.searchsorted(offsets, starts, "right") - 1
    hashes = words.span_hashes(data, starts, ends)
    order = np.lexsort((hashes, doc))
    same = (doc[order][1:] == doc[order][:-1]) & (hashes[order][1:] == hashes[order][:-1])
    return {"n_lines": np.bincount(doc, minlength=n), "n_dup_lines": np.bincount(doc[order][1:][same], minlength=n)}


def _repeats(data: np.ndarray, offsets: np.ndarray) -> Figures:
    """Words in 3-word windows that a text has twice or more."""
    starts, ends, first = words.spans(data, offsets)
    runs = words.shingles(words.span_hashes(data, starts, ends), 3)
    out = np.zeros(len(offsets) - 1, np.int64)
    for d in range(len(out)):
        i, j = int(first[d]), int(first[d + 1])
        if j - i < 4:
            continue
        own = runs[i : j - 2]
        order = np.argsort(own)
        same = own[order][1:] == own[order][:-1]
        if same.any():
            again = np.r_[False, same] | np.r_[same, False]
            covered = np.zeros(j - i, bool)
            at = order[again]
            covered[at] = covered[at + 1] = covered[at + 2] = True
            out[d] = covered.sum()
    return {"n_repeat_words": out}


def _pairs(data: np.ndarray, offsets: np.ndarray) -> Figures:
    """How often a text has its commonest pair of neighbouring words."""
    starts, ends, first = words.spans(data, offsets)
    runs = words.shingles(words.span_hashes(data, starts, ends), 2)
    out = np.zeros(len(offsets) - 1, np.int64)
    for d in range(len(out)):
        i, j = int(first[d]), int(first[d + 1])
        if j - i > 1:
            out[d] = np.unique(runs[i : j - 1], return_counts=True)[1].max()
    return {"n_top_pair": out}


def _letters(data: np.ndarray, offsets: np.ndarray) -> Figures:
    """Code points of a text, and the pairs of places that hold the same one (the squares of the counts, summed)."""
    n_chars, n_same = np.zeros((2, len(offsets) - 1), np.int64)
    for d in range(len(n_chars)):
        own = data[offsets[d] : offsets[d + 1]]
        times = np.bincount(own, minlength=256)[:128]
        if (own >= 128).any():
            wide = np.frombuffer(own.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
            times = np.append(times, np.unique(wide[wide >= 128], return_counts=True)[1])
        n_chars[d], n_same[d] = times.sum(), (times * times).sum()
    return {"n_chars": n_chars, "n_same": n_same}


GROUPS: dict[str, tuple[Callable[[np.ndarray, np.ndarray], Figures], tuple[str, ...]]] = {
    "counts": (_counts, ("n_words", "word_chars", "n_symbols", "n_upper", "n_lower")),
    "lines": (_lines, ("n_lines", "n_dup_lines")),
    "repeats": (_repeats, ("n_repeat_words",)),
    "pairs": (_pairs, ("n_top_pair",)),
    "letters": (_letters, ("n_chars", "n_same")),
}


@dataclass(frozen=True)
class Rule:
    name: str
    needs: tuple[str, ...]
    rejects: Callable[[Figures], np.ndarray]


#: The first two are the base rules. The others reject what prose is not: thresholds leave room for short documents.
RULES = (
    Rule("too_few_words", ("counts",), lambda f: f["n_words"] < 50),
    Rule("repeated_words", ("counts", "repeats"), lambda f: 100 * f["n_repeat_words"] > 50 * f["n_words"]),
    Rule("symbols", ("counts",), lambda f: 10 * f["n_symbols"] > 3 * f["n_words"]),
    Rule("word_length", ("counts",), lambda f: (f["word_chars"] < 2 * f["n_words"]) | (f["word_chars"] > 20 * f["n_words"])),
    Rule("shouting", ("counts",), lambda f: f["n_upper"] > f["n_lower"]),
    Rule("repeated_lines", ("lines",), lambda f: 100 * f["n_dup_lines"] > 50 * f["n_lines"]),
    Rule("common_pair", ("counts", "pairs"), lambda f: 10 * f["n_top_pair"] > f["n_words"]),
    Rule("few_letters", ("letters",), lambda f: f["n_same"] > f["n_chars"] ** 2 // 4),
)
BASE = ("too_few_words", "repeated_words")


class _Texts:
    """The figures of some texts, each group made at most once for a text."""

    def __init__(self, part: pa.RecordBatch) -> None:
        self.text, self.n = part["text"], len(part)
        self.figures = {c: np.zeros(self.n, np.int64) for _, names in GROUPS.values() for c in names}
        self.made = {g: np.zeros(self.n, bool) for g in GROUPS}

    def need(self, group: str, rows: np.ndarray) -> None:
        rows = rows[~self.made[group][rows]]
        if not len(rows):
            return
        some = self.text if len(rows) == self.n else self.text.take(pa.array(rows))
        make, names = GROUPS[group]
        found = make(*words.buffers(some))
        for c in names:
            self.figures[c][rows] = found[c]
        self.made[group][rows] = True

    def of(self, rows: np.ndarray) -> Figures:
        return {c: v[rows] for c, v in self.figures.items()}


def _measure(rules: tuple[Rule, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.slices(batch):
                texts, every, cost = _Texts(part), np.arange(len(part)), []
                for g in GROUPS:
                    start = time.perf_counter()
                    texts.need(g, every)
                    cost.append((time.perf_counter() - start) / len(part))
                bits = sum(r.rejects(texts.figures).astype(np.int64) << k for k, r in enumerate(rules))
                yield pa.RecordBatch.from_arrays([pa.array(bits), *(pa.array(np.full(len(part), c)) for c in cost)], names=["bits", *GROUPS])

    return run


def order_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> tuple[Rule, ...]:
    """Rules by rejection per cost on a sample of ``sample_rows`` ids, chosen by a hash."""
    ids = docs.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    sample = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi").select("text")
    schema = ", ".join(["bits long", *(f"{g} double" for g in GROUPS)])
    found = sample.mapInArrow(_measure(rules), schema).groupBy("bits").agg(F.count("*").alias("n"), *(F.sum(g).alias(g) for g in GROUPS)).collect()
    if not found:
        return rules
    bits, n = np.array([r["bits"] for r in found]), np.array([r["n"] for r in found])
    cost = {g: sum(r[g] for r in found) / n.sum() for g in GROUPS}
    left, made, out = np.ones(len(bits), bool), set(), []
    rest = list(rules)
    while rest:

        def worth(rule: Rule) -> float:
            gone = n[left & (bits >> rules.index(rule) & 1 > 0)].sum()
            return gone / (1e-9 + sum(cost[g] for g in rule.needs if g not in made))

        best = max(rest, key=worth)  # the written order decides ties
        rest.remove(best)
        out.append(best)
        made |= set(best.needs)
        left &= bits >> rules.index(best) & 1 == 0
    return tuple(out)


def _cascade(rules: tuple[Rule, ...], figures: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([r.name for r in rules] + [None], dtype=object)
        for batch in batches:
            for part in words.slices(batch):
                texts = _Texts(part)
                left, by = np.arange(len(part)), np.full(len(part), len(rules))
                for k, rule in enumerate(rules):
                    for g in rule.needs:
                        texts.need(g, left)
                    gone = rule.rejects(texts.of(left))
                    by[left[gone]] = k
                    left = left[~gone]
                    if not len(left):
                        break
                for g, (_, names_of) in GROUPS.items():
                    if not set(names_of).isdisjoint(figures):
                        texts.need(g, np.arange(len(part)))
                out = [*(pa.array(texts.figures[c]) for c in figures), pa.array(names[by].tolist(), pa.string())]
                keep = range(1, len(part.columns))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in keep), *out], names=[str(i) for i in range(len(keep) + len(out))])

    return run


def cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES, figures: tuple[str, ...] = (), rejected_by: str = "rejected_by") -> DataFrame:
    """All columns of ``docs`` (but for the new ones' names), the figures asked for, and the rejecting rule or null.

    Asking for figures has their groups, and no others, made for every text, after the rules have run.
    """
    rules = order_rules(docs, rules)
    keep = others(docs, *figures, rejected_by)
    rows = docs.select("text", *(f"`{c}`" for c in keep))
    fields = [T.StructField(str(i), docs.schema[c].dataType) for i, c in enumerate(keep)]
    fields += [T.StructField(str(len(keep) + i), T.LongType()) for i in range(len(figures))]
    schema = T.StructType([*fields, T.StructField(str(len(fields)), T.StringType())])
    inner = rows.toDF("text", *(f"c{i}" for i in range(len(keep))))
    return inner.mapInArrow(_cascade(rules, figures), schema).toDF(*keep, *figures, rejected_by)
