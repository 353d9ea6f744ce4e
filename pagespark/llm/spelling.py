"""Words of a corpus grouped with their spelling variants, through an index of variable-length grams.

1. *Words*: every text is cut into runs of letters; runs are counted inside a task before they move.
2. *Gram dictionary*: the grams of 2 to LONGEST - 1 letters that more than ``limit`` of a word list's
   places hold. The others are pruned: a gram grows letter by letter only while it is in the
   dictionary. ``limit`` follows the word list (its letters / 2 ** DICTIONARY_BITS, LEAST_LIMIT at
   least), so the dictionary never has more than (LONGEST - 2) * 2 ** DICTIONARY_BITS grams and may
   be broadcast. It decides what is compared, never what is found.
3. *Index*: a word has a gram at each place, the shortest one that the dictionary does not hold, of
   half the word at most. Its list is (length, place from the left, gram) and (length, place from
   the right, gram). A gram depends on its own letters alone, so one edit affects only those grams
   whose letters it touches; grams left of it keep their place from the left, grams right of it
   their place from the right.
4. *Merging*: of any set of a word's grams an edit affects at most as many as cover one place; one
   more than that bound has to be looked up. A left gram and a right gram that do not overlap have
   the bound 1, so two lists hold every near word: the word takes the pair with the shortest lists.
   It looks among words of its own length, and of one letter more; shorter ones look for it.
5. *Verification* of each pair that meets: common beginning and common end cover all but the edit. The
   length of the common beginning also says which of the two lists reports the pair, so each
   pair comes once and needs no distinct.
6. *Forms* are followed to their last by doubling: each round joins the pointers with themselves.
   Along forms n doubles, so rounds follow the logarithm of the logarithm of the largest n.

Lists stream through a kernel sorted by key; pairs are verified as they meet and are counted for each word
before anything moves. A list is as long as words of one length share one gram at one place.

Defined results: null and empty texts have no words. A null doc_id counts as the empty string in the
hash. Every row counts, also repeated ones. Runs of any length are words; those of more than 16 letters
are compared one by one. An empty table gives no rows. Other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagespark.llm.store import kept
from pagespark.llm.words import buffers, slices

SHORTEST, LONGEST = 2, 8
DICTIONARY_BITS, LEAST_LIMIT = 16, 64
#: Distinct runs that a task counts before it hands them on, rows of lists and pairs worked on at a time.
HELD, ROWS, PAIRS = 200_000, 100_000, 400_000
_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_WIDE = 16
_SEVEN, _HIGH = np.uint64(0x7F7F7F7F7F7F7F7F), np.uint64(0x8080808080808080)


def misspelt(doc_id: int | None, runs: Counter, every: int) -> Iterator[tuple[str, int]]:
    """Runs of a document, lower-cased; where ``every`` divides a run's hash, one letter is left out."""
    before = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in runs.items():
        h = zlib.crc32(run.encode(), before)
        if h % every == 0:
            i = h % len(run)
            run = run[:i] + run[i + 1 :]
        yield run, n


def _runs(every: int, least_length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], names=["word", "n"])

        for batch in batches:
            for part in slices(batch):
                data, offsets = buffers(part["text"])
                lower = data.copy()
                lower[(data >= 65) & (data <= 90)] += 32
                raw, ends = lower.tobytes(), offsets.tolist()
                for k, doc_id in enumerate(part["doc_id"].to_pylist()):
                    runs = Counter(_RUN.findall(raw[ends[k] : ends[k + 1]].decode()))
                    for word, n in misspelt(doc_id, runs, every):
                        if len(word) >= least_length:
                            found[word] += n
                if len(found) > HELD:
                    yield out()
                    found.clear()
        yield out()

    return run


def count_words(docs: DataFrame, every: int = 97, least_length: int = 5, least_n: int = 3) -> DataFrame:
    """word, n: runs of ``least_length`` letters or more that all texts hold ``least_n`` times or more."""
    found = docs.select("doc_id", "text").mapInArrow(_runs(every, least_length), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n)


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: Counter = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], names=["gram", "places"])

    for batch in batches:
        for word in batch["word"].to_pylist():
            n = len(word)
            for size in range(SHORTEST, min(LONGEST - 1, n) + 1):
                found.update([word[i : i + size] for i in range(n - size + 1)])
            if len(found) > HELD:
                yield out()
                found.clear()
    yield out()


def dictionary(words: DataFrame) -> dict[str, int]:
    """The grams that may grow, with the number of their places; see the module for the bound."""
    letters = words.agg(F.sum(F.length("word"))).first()[0] or 0
    limit = max(LEAST_LIMIT, letters >> DICTIONARY_BITS)
    found = words.select("word").mapInArrow(_grams, "gram string, places long").groupBy("gram").agg(F.sum("places").alias("places"))
    return {r["gram"]: r["places"] for r in found.where(F.col("places") > limit).collect()}


def decompose(word: str, length: int, grams: dict[str, int]) -> list[tuple[int, int, bool]]:
    """Start and end of the gram at each place, and whether it stopped for the word's end alone.

    ``length`` is that of the list's words: grams have half of it at most.
    """
    n, most, out = len(word), min(LONGEST, length // 2), []
    for p in range(n - SHORTEST + 1):
        e = p + SHORTEST
        while e - p < most and e < n and word[p:e] in grams:
            e += 1
        out.append((p, e, e == n and e - p < most and word[p:e] in grams))
    return out


def probes(word: str, length: int, grams: dict[str, int]) -> tuple[tuple[int, int], tuple[int, int]]:
    """A left and a right gram that no single edit affects both, with the shortest lists."""
    pieces = decompose(word, length, grams)
    cost = [(grams.get(word[p:e], LEAST_LIMIT // 2), p, e) for p, e, _ in pieces]
    lefts = sorted((e, c, p) for (c, p, e), (_, _, stopped) in zip(cost, pieces) if not stopped)
    best, at, left, chosen = math.inf, 0, None, None
    rights: list = [None] * (len(cost) + 1)
    for k in range(len(cost) - 1, -1, -1):
        rights[k] = min(cost[k], rights[k + 1]) if rights[k + 1] else cost[k]
    for m in range(len(cost)):  # the right gram starts at m or later, the left one ends at m or before
        while at < len(lefts) and lefts[at][0] <= m:
            e, c, p = lefts[at]
            left = min(left, (c, p, e)) if left else (c, p, e)
            at += 1
        if left and left[0] + rights[m][0] < best:
            best, chosen = left[0] + rights[m][0], (left[1:], rights[m][1:])
    return chosen


def _lists(grams):
    """Rows of the index (kind 0) and look-ups: 1 by a left gram, 2 by a right one, with the left one's end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = grams.value
        for batch in batches:
            keys, kinds, cuts, rows = [], [], [], []
            words = batch["word"].to_pylist()
            for row, word in enumerate(words):
                n = len(word)
                for p, e, stopped in decompose(word, n, known):
                    if not stopped:
                        keys.append(f"{n}L{p}{word[p:e]}")
                        kinds.append(0)
                        cuts.append(0)
                        rows.append(row)
                    keys.append(f"{n}R{n - p}{word[p:e]}")
                    kinds.append(0)
                    cuts.append(0)
                    rows.append(row)
                for length in (n, n + 1):
                    (p, e), (q, f) = probes(word, length, known)
                    keys += [f"{length}L{p}{word[p:e]}", f"{length}R{n - q}{word[q:f]}"]
                    kinds += [1, 2]
                    cuts += [e, e]
                    rows += [row, row]
                if len(keys) > ROWS or row == len(words) - 1:
                    take = pa.array(rows)
                    latin = pa.array([w.encode("latin-1") for w in words], pa.binary()).take(take)
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(kinds, pa.int8()), pa.array(cuts, pa.int32()), latin, batch["n"].take(take)], names=["key", "kind", "cut", "word", "n"])
                    keys, kinds, cuts, rows = [], [], [], []

    return run


class _Words:
    """Letters of words, eight to a number, from the beginning and from the end."""

    def __init__(self, column: pa.Array) -> None:
        self.column = column
        data, offsets = buffers(column)
        self.size = np.diff(offsets)
        row, at = np.repeat(np.arange(len(self.size)), self.size), np.arange(len(data)) - np.repeat(offsets[:-1], self.size)
        back = np.repeat(self.size, self.size) - 1 - at
        self.sides = []
        for place in (at, back):
            letters, inside = np.zeros((len(self.size), _WIDE), np.uint8), place < _WIDE
            letters[row[inside], place[inside]] = data[inside]
            packed = letters.view("<u8")
            self.sides.append((np.ascontiguousarray(packed[:, 0]), np.ascontiguousarray(packed[:, 1])))

    def text(self, k: int) -> bytes:
        return self.column[k].as_py()

    def common(self, i: np.ndarray, j: np.ndarray, side: int) -> np.ndarray:
        """Equal letters of words i and j from their beginning (0) or end (1); 16 at most."""
        a, b = self.sides[side]

        def equal(x: np.ndarray) -> np.ndarray:
            nonzero = (((x & _SEVEN) + _SEVEN) | x) & _HIGH
            return np.bitwise_count((nonzero & (~nonzero + np.uint64(1))) - np.uint64(1)) >> 3

        first = equal(a[i] ^ a[j]).astype(np.int64)
        full = np.flatnonzero(first == 8)
        first[full] += equal(b[i[full]] ^ b[j[full]])
        return first


def one_edit(a: bytes, b: bytes) -> int:
    """Length of the common beginning of two words that differ by one edit; -1 of others. ``b`` is not shorter."""
    n = len(a)
    if len(b) - n not in (0, 1) or a == b:
        return -1
    lo, hi = 0, n
    while lo < hi:  # the longest common beginning, by halves
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[:mid] == b[:mid] else (lo, mid - 1)
    return lo if a[lo + (len(b) == n) :] == b[lo + 1 :] else -1


def _reduced(words: _Words, n: np.ndarray, of: np.ndarray, near: np.ndarray) -> pa.RecordBatch:
    """For each word of ``of`` the number of its near words, and the best one of those."""
    order = np.lexsort((-n[near], of))
    of, near = of[order], near[order]
    first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
    count = np.diff(np.r_[first, len(of)])
    best = near[first]
    # several near words of the same n: the smallest decides
    tied = n[near] == np.repeat(n[best], count)
    many = np.flatnonzero(np.add.reduceat(tied, first) > 1)
    for k in many.tolist():
        some = near[first[k] : first[k] + count[k]]
        best[k] = min(some[n[some] == n[best[k]]].tolist(), key=words.text)
    text = [[x.decode("latin-1") for x in words.column.take(pa.array(rows)).to_pylist()] for rows in (of[first], best)]
    return pa.RecordBatch.from_arrays([pa.array(text[0], pa.string()), pa.array(n[of[first]]), pa.array(count), pa.array(text[1], pa.string()), pa.array(n[best])], names=["word", "n", "n_near", "form", "form_n"])


def _merge(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """Near words of whole lists."""
    key = rows["key"].combine_chunks()
    kind, cut, n = (rows[c].to_numpy() for c in ("kind", "cut", "n"))
    change = np.r_[True, pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False)]
    group = np.cumsum(change) - 1
    index, looks = np.flatnonzero(kind == 0), np.flatnonzero(kind > 0)
    starts = np.searchsorted(group[index], np.arange(group[-1] + 2))
    begin, meets = starts[group[looks]], starts[group[looks] + 1] - starts[group[looks]]
    looks, begin, meets = looks[meets > 0], begin[meets > 0], meets[meets > 0]
    if not len(looks):
        return
    words = _Words(rows["word"].combine_chunks())
    total = np.r_[0, np.cumsum(meets)]
    done = 0
    while done < total[-1]:  # a look-up of a long list is cut where the chunk ends
        end = min(done + PAIRS, total[-1])
        a, b = np.searchsorted(total, done, "right") - 1, np.searchsorted(total, end, "left")
        lo, hi = np.maximum(total[a:b], done), np.minimum(total[a + 1 : b + 1], end)
        i = np.repeat(looks[a:b], hi - lo)
        j = index[np.arange(done, end) + np.repeat(begin[a:b] - total[a:b], hi - lo)]
        done = end
        short = np.maximum(words.size[i], words.size[j]) <= _WIDE
        longer = np.flatnonzero(~short)
        lead = np.full(len(i), -1)
        s = np.flatnonzero(short)
        x, y = i[s], j[s]
        size = words.size[x]
        lcp = np.minimum(words.common(x, y, 0), size)
        need = size - (words.size[y] == size)
        near = (lcp < words.size[y]) & (lcp + words.common(x, y, 1) >= need)
        lead[s[near]] = lcp[near]
        for k in longer.tolist():
            lead[k] = one_edit(words.text(i[k]), words.text(j[k]))
        mine = (lead >= 0) & ((lead >= cut[i]) == (kind[i] == 1))
        i, j = i[mine], j[mine]
        if len(i):
            yield _reduced(words, n, i, j)
        grown = words.size[j] > words.size[i]
        if grown.any():
            yield _reduced(words, n, j[grown], i[grown])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, rows = [], 0
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        rows += len(batch)
        last = batch["key"][len(batch) - 1].as_py()
        if rows < ROWS or held[0]["key"][0].as_py() == last:
            continue
        table = pa.Table.from_batches(held)
        whole = int(pc.index(table["key"], pa.scalar(last)).as_py())
        yield from _merge(table.slice(0, whole))
        held = table.slice(whole).combine_chunks().to_batches()
        rows = sum(map(len, held))
    if held:
        yield from _merge(pa.Table.from_batches(held))


def near_words(words: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n: of each word the near words' number and the one of largest n (null: none).

    ``words`` has each word once, of Latin-1 letters and at least five of them.
    """
    spark = words.sparkSession
    grams = spark.sparkContext.broadcast(dictionary(words))
    lists = words.select("word", "n").mapInArrow(_lists(grams), "key string, kind byte, cut int, word binary, n long")
    met = lists.repartition("key").sortWithinPartitions("key").mapInArrow(_merged, "word string, n long, n_near long, form string, form_n long")
    alone = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("string").alias("form"), F.lit(None).cast("long").alias("form_n"))
    best = F.min(F.when(F.col("form").isNotNull(), F.struct((-F.col("form_n")).alias("less"), "form"))).alias("best")
    found = alone.unionByName(met).groupBy("word", "n").agg(F.sum("n_near").alias("n_near"), best)
    return found.select("word", "n", "n_near", F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))


def follow(forms: DataFrame) -> DataFrame:
    """word, root: each word's last form. ``forms`` has word, n, and form (null: none) of at least twice its n."""
    at = forms.select("word", F.coalesce("form", "word").alias("root"))
    most = forms.where("form is not null").agg(F.max("form_n"), F.min("n")).first()
    if most[0] is None:
        return at
    steps = max(1, math.floor(math.log2(most[0] / most[1])))
    for _ in range(math.ceil(math.log2(steps)) if steps > 1 else 0):
        at = kept(at)
        moved = at.where("root <> word")
        nxt = moved.select(F.col("word").alias("at"), F.col("root").alias("further"))
        on = moved.join(nxt, moved["root"] == nxt["at"], "left").select("word", F.coalesce("further", "root").alias("root"))
        at = on.unionByName(at.where("root = word"))
    return at


def variants(docs: DataFrame, every: int = 97, least_length: int = 5, least_n: int = 3) -> DataFrame:
    """word, form, root, n, n_near, form_n of all words of ``docs`` (doc_id, text)."""
    words = kept(count_words(docs, every, least_length, least_n))
    found = kept(near_words(words))
    follows = F.col("form_n") >= 2 * F.col("n")
    forms = found.select("word", "n", "n_near", F.when(follows, F.col("form")).alias("form"), F.when(follows, F.col("form_n")).alias("form_n"))
    return forms.join(follow(forms), "word").select("word", "form", "root", "n", "n_near", "form_n")
