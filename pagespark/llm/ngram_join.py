"""Self-join of documents on the Jaccard similarity of their word shingles, and its components.

Prefix filtering: shingles are ordered rare first; two sets that are similar enough share one of
the first ``n - ceil(t * n) + 1`` shingles of each. So documents meet on these only.

1. *Profile* (one pass over the texts): each document's set size, 128-bit digest of its set, and
   the sizes of the parts into which fixed hash values cut the set. Documents of equal sets are one
   class from here on. The same pass counts in how many documents each shingle is, in a table of
   2 ** ORDER_BITS counters (several shingles share one; the order stays the same for all documents,
   so sharing costs candidates, never results). Counters of a task are added up before they move.
2. *Postings* (second pass): (shingle, class, size, place) of each prefix, a class once for each task.
   They travel packed, by buckets of shingles whose number follows the number of postings, so that a
   bucket fits in memory at any size; a kernel sorts one bucket at a time. In a shingle's group, most typical first
   (the text whose shingles are most frequent: what the others were copied from), each member meets the first that
   the length filter allows, its pivot. The *length filter*
   needs ``t * larger <= smaller``; the *positional filter* needs that what can still follow the
   shared shingle in both sets suffices. That makes at most one pair from each posting, never all
   pairs of a group. Very frequent shingles are dealt to several groups, whose pivots meet again.
3. *First links*: each class is verified against the pivot that it met most often. Components of
   these links swallow groups of near copies.
4. *The rest, exactly*: classes of one shingle that are in different components yet are paired, under
   both filters, without those verified before. The filters are part of the join's key (``_cells``), so
   that texts which share a passage but can't be similar do not meet.
5. *Verification*, once for each pair: first the *suffix filter* (parts of the two sets, cut at the same
   hash values, differ in size by at least so many members that the sets can't be similar), then the sets
   themselves, made again from whole texts.

Links that would join classes of one component are not looked for: components are the same without.

Defined results: null and empty texts and texts without words have an empty set, size 0, and are
alone. Rows that repeat an id are documents of their own; a component's id is the smallest id in it,
null if none is known. Ties between pivots are ordered by size and digest. Extra columns take no part.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagespark.llm import words
from pagespark.llm.components import components
from pagespark.llm.store import fresh, kept, remove, row_key

WORDS = 5
#: Similarity of at least this many hundredths.
PERCENT = 75
ORDER_BITS = 22
#: Counters that travel together.
_BLOCK_BITS = 12
#: Documents of a frequent shingle that meet in one group, about.
GROUP = 20_000
PARTS = 64
#: Postings of a bucket that is sorted in memory, about (28 bytes each). A class's postings in one bucket compress
#: together, so fewer buckets move fewer bytes.
BUCKET = 1 << 20
#: Postings that a task packs together.
FLUSH = 1 << 20
#: Sizes of one band differ by less than this factor.
BAND = 4 / 3
_FILTER_BITS = 24


def _flat(sets: Iterator[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sets one after the other, and their sizes."""
    sets = list(sets)
    return np.concatenate([np.empty(0, np.uint64), *sets]), np.array([len(x) for x in sets], np.int64)


def _sums(values: np.ndarray, sizes: np.ndarray, kind) -> np.ndarray:
    """Sum of each set's values; empty sets have 0."""
    out, full = np.zeros(len(sizes), kind), sizes > 0
    if full.any():
        out[full] = np.add.reduceat(values, (np.cumsum(sizes) - sizes)[full], dtype=kind)
    return out


def _digests(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """128 bits of each set, as two numbers in a row."""
    a = _sums(flat, sizes, np.uint64) + sizes.astype(np.uint64)
    b = _sums(words.mix(flat ^ np.uint64(0xC3A5C85C97CB3127)), sizes, np.uint64)
    return words.mix(np.stack([a, b], axis=1))


def _short(digests: np.ndarray) -> np.ndarray:
    """What stands for a class in postings; where two classes share one, both are looked at."""
    return digests[:, 0].view(np.int64)


def _counter(found: np.ndarray) -> np.ndarray:
    return (found >> np.uint64(64 - ORDER_BITS)).astype(np.int64)


def _array(values, kind: pa.DataType) -> pa.Array:
    return values if isinstance(values, pa.Array) else pa.array(values, kind)


def _batch(schema: pa.Schema, n: int, /, **columns) -> pa.RecordBatch:
    """A batch with nulls for the columns that are not given."""
    return pa.RecordBatch.from_arrays([_array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


_PROFILE = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("carried", pa.string()), ("words", pa.int64()), ("n", pa.int64()), ("cls", pa.binary()), ("short", pa.int64()), ("parts", pa.list_(pa.int16())), ("block", pa.int32()), ("counts", pa.binary())])
PROFILE = "doc_id long, row long, carried string, words long, n long, cls binary, short long, parts array<short>, block int, counts binary"


def _narrow(counts: np.ndarray) -> bytes:
    """Counters of a block in as few bytes as hold them; the length tells which."""
    return zlib.compress(counts.astype(np.min_scalar_type(int(counts.max()))).tobytes(), 1)


def _wide(packed: bytes) -> np.ndarray:
    data = zlib.decompress(packed)
    return np.frombuffer(data, f"u{len(data) >> _BLOCK_BITS}")


def _profile(n_words: int):
    """A row for each document, and at a task's end its counters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(1 << ORDER_BITS, np.uint32)
        for batch in batches:
            for part in words.slices(batch):
                data, offsets = words.buffers(part["text"])
                spanned = words.spans(data, offsets)
                flat, sizes = _flat(words.shingle_sets(data, offsets, n_words, spanned))
                np.add.at(count, _counter(flat), np.uint32(1))
                digests = _digests(flat, sizes)
                # a part is the values of one leading digit
                cell = np.repeat(np.arange(len(sizes)) * PARTS, sizes) + (flat // np.uint64((1 << 64) // PARTS)).astype(np.int64)
                cut = np.minimum(np.bincount(cell, minlength=len(sizes) * PARTS), 32767).astype(np.int16)
                parts = pa.FixedSizeListArray.from_arrays(pa.array(cut), PARTS).cast(pa.list_(pa.int16()))
                yield _batch(_PROFILE, len(part), doc_id=part["doc_id"], row=part["row"], carried=part["carried"], words=np.diff(spanned[2]), n=sizes, cls=[d.tobytes() for d in digests], short=_short(digests), parts=parts)
        blocks = count.reshape(-1, 1 << _BLOCK_BITS)
        used = np.flatnonzero(blocks.any(axis=1))
        for i in range(0, len(used), 64):
            own = used[i : i + 64]
            yield _batch(_PROFILE, len(own), block=own.astype(np.int32), counts=[_narrow(blocks[k]) for k in own])

    return run


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum counters by block; there are 2 ** (ORDER_BITS - _BLOCK_BITS) blocks, whatever the input."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, counts in zip(batch["block"].to_pylist(), batch["counts"].to_pylist()):
            own = total.setdefault(block, np.zeros(1 << _BLOCK_BITS, np.uint64))
            own += _wide(counts)
    steps = [np.minimum(np.log2(c + 1.0) * 8, 255).astype(np.uint8).tobytes() for c in total.values()]
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(steps, pa.binary())], names=["block", "counts"])


def _order(blocks: DataFrame, tasks: int) -> np.ndarray:
    """Frequency of all counters in steps, eight to a doubling: 2 ** ORDER_BITS bytes."""
    summed = blocks.repartition(tasks, "block").mapInArrow(_add_up, "block int, counts binary")
    order = np.zeros(1 << ORDER_BITS, np.uint8)
    for row in summed.collect():
        order[row["block"] << _BLOCK_BITS : (row["block"] + 1) << _BLOCK_BITS] = np.frombuffer(row["counts"], np.uint8)
    return order


def _groups() -> np.ndarray:
    """Groups that a shingle of each frequency step is dealt to."""
    return np.ceil(2.0 ** (np.arange(256) / 8) / GROUP).astype(np.int64)


#: ``meta`` holds, from the top: how untypical a class is, its size, and the shingle's place in its order.
_COLUMNS = {"token": np.uint64, "salt": np.int32, "meta": np.int64, "cls": np.int64}
POSTINGS = "bucket int, token binary, salt binary, meta binary, cls binary"
_TYPICAL, _PLACE = 11, 26


def _untypical(total: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A set is typical if its shingles are frequent (``total``: their steps): a text that others were made from, rather than one of those."""
    top = (1 << _TYPICAL) - 1
    return top - (total / np.maximum(sizes, 1) * top / 255).astype(np.int64)


def _unpacked(meta):
    """Size and place; works on numpy arrays and Spark columns."""
    low = (1 << _PLACE) - 1
    if isinstance(meta, np.ndarray):
        return (meta >> _PLACE) & low, meta & low
    return F.shiftright(meta, _PLACE).bitwiseAND(low), meta.bitwiseAND(low)


class _Packer:
    """Postings collected to one row for each bucket: its columns' bytes."""

    def __init__(self, buckets: int) -> None:
        self.buckets, self.held, self.n = buckets, [], 0

    def add(self, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append(columns)
        self.n += len(columns[0])
        if self.n >= FLUSH:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.n:
            return
        columns = [np.concatenate(c).astype(kind, copy=False) for c, kind in zip(zip(*self.held), _COLUMNS.values())]
        self.held, self.n = [], 0
        bucket = words.mix(columns[0] + columns[1].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(self.buckets)
        order = np.argsort(bucket, kind="stable")
        bucket, columns = bucket[order], [c[order] for c in columns]
        start = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        rows = [pa.array(bucket[start].astype(np.int32))]
        for c in columns:
            ends = np.r_[start, len(c)].astype(np.int32) * c.itemsize
            rows.append(pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(c)]))
        yield pa.RecordBatch.from_arrays(rows, names=["bucket", *_COLUMNS])


def _postings(order: np.ndarray, n_words: int, percent: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        groups, packer = _groups(), _Packer(buckets)
        for batch in batches:
            for part in words.slices(batch):
                flat, sizes = _flat(words.shingle_sets(*words.buffers(part["text"]), n_words))
                digests, steps = _digests(flat, sizes), order[_counter(flat)]
                untypical = _untypical(_sums(steps, sizes, np.int64), sizes)
                keys = (steps.astype(np.uint64) << np.uint64(56)) | (flat & np.uint64((1 << 56) - 1))
                ends, prefixes, new = np.cumsum(sizes), [], []
                for d, (n, end) in enumerate(zip(sizes.tolist(), ends.tolist())):
                    digest = digests[d].tobytes()
                    if not n or digest in seen:
                        continue
                    seen.add(digest)
                    prefix = _prefix(n, percent)
                    prefixes.append(np.sort(np.partition(keys[end - n : end], prefix - 1)[:prefix]))
                    new.append(d)
                if new:
                    length = np.array([len(x) for x in prefixes])
                    key, own = np.concatenate(prefixes), np.repeat(_short(digests)[new], length)
                    place = np.arange(len(key)) - np.repeat(np.cumsum(length) - length, length)
                    meta = np.repeat((untypical[new] << 2 * _PLACE) | (sizes[new] << _PLACE), length) + place
                    salt = ((own >> 8) & 0x7FFFFFFF) % groups[(key >> np.uint64(56)).astype(np.int64)]
                    yield from packer.add(key, salt, meta, own)
        yield from packer.flush()

    return run


def _packed(buckets: int):
    """Postings that are rows (token, meta, cls), packed; of one group each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(buckets)
        for batch in batches:
            token, meta, cls = (batch[c].to_numpy() for c in ("token", "meta", "cls"))
            if len(token):
                yield from packer.add(token.view(np.uint64), np.zeros(len(token), np.int32), meta, cls)
        yield from packer.flush()

    return run


def _prefix(n, percent: int):
    """Shingles of a prefix: enough for two similar sets to share one. ``n`` is a number or a Spark column of them."""
    kept_back = (n * percent + 99) // 100 if isinstance(n, int) else F.floor((n * percent + 99) / 100)
    return n - kept_back + 1


def _allowed(n_a, n_b, place_a, place_b, percent: int):
    """Length and positional filter, on numpy arrays or Spark columns."""
    low, high = (np.minimum, np.maximum) if isinstance(n_a, np.ndarray) else (F.least, F.greatest)
    follow = low(n_a - place_a, n_b - place_b)
    return (low(n_a, n_b) * 100 >= high(n_a, n_b) * percent) & (follow * (100 + percent) >= (n_a + n_b) * percent)


def _band(n) -> F.Column:
    return F.floor(F.log(n) / math.log(BAND)).cast("int")


def _cells(rows: DataFrame, key: str, percent: int) -> tuple[DataFrame, DataFrame]:
    """Both sides of a self-join of ``rows`` (key, cls, part, n, place) under the length and positional filters.

    From a shared shingle on, a set of n with place p can be similar to sets of up to
    ``((100 + t) (n - p) - t n) / t``, its *reach*. Two sets pass both filters if neither is beyond the other's
    reach. So the smaller one needs a reach of its own size at least, and meets sizes from its own to its reach; the
    larger one meets sizes from ``t`` percent of its own to its own or its reach. Cells are pairs of size bands
    (smaller, larger); a side stands in a handful of them at most.
    """
    t, n, place = percent, F.col("n"), F.col("place")
    rows = rows.withColumn("reach", F.floor(((100 + t) * (n - place) - t * n) / t))
    least = F.ceil(n * t / 100)
    upto = F.least("n", "reach")
    small = rows.where("reach >= n").withColumn("low", _band(n)).withColumn("high", F.explode(F.sequence(_band(n), _band(F.col("reach")))))
    large = rows.where(upto >= least).withColumn("high", _band(n)).withColumn("low", F.explode(F.sequence(_band(least), _band(upto))))
    return tuple(side.select(key, "low", "high", *(F.col(c).alias(f"{c}_{k}") for c in ("cls", "part", "n", "place"))) for side, k in ((small, "x"), (large, "y")))


_STARS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("only", pa.bool_()), ("again", pa.bool_()), ("token", pa.int64()), ("meta", pa.int64())])
STARS = "a long, b long, only boolean, again boolean, token long, meta long"


def _stars(percent: int, first: bool):
    """Packed postings, sorted by bucket, to three kinds of rows. A bucket's postings are sorted here.

    ``b`` known: a pair with its group's pivot; ``only`` if the shingle is in no third class.
    ``again`` false: a posting (``a`` its class) of a shingle in three classes or more.
    ``again`` true: a pivot's posting, of a shingle that was dealt to several groups.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, []
        for batch in batches:
            for i, of in enumerate(batch["bucket"].to_pylist()):
                if of != bucket:
                    yield from settle(held)
                    bucket, held = of, []
                held.append([np.frombuffer(batch[c][i].as_buffer(), kind) for c, kind in _COLUMNS.items()])
        yield from settle(held)

    def settle(held: list) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        token, salt, meta, cls = (np.concatenate(c) for c in zip(*held))
        order = np.argsort(token)
        token = token[order]
        same = token[1:] == token[:-1]
        keep = np.r_[False, same] | np.r_[same, False]
        if first:
            keep |= _groups()[token >> np.uint64(56)] > 1
        token, (salt, meta, cls) = token[keep], (x[order[keep]] for x in (salt, meta, cls))
        if not len(token):
            return
        order = np.lexsort((cls, meta, salt, token))
        token, salt, meta, cls = (x[order] for x in (token, salt, meta, cls))
        new = np.r_[True, (token[1:] != token[:-1]) | (salt[1:] != salt[:-1])]
        once = new | np.r_[True, cls[1:] != cls[:-1]]  # a class may come from several tasks
        token, meta, cls, new = (x[once] for x in (token, meta, cls, new))
        size = np.bincount(np.cumsum(new) - 1)[np.cumsum(new) - 1]
        dealt = _groups()[token >> np.uint64(56)] > 1 if first else np.zeros(len(token), bool)
        keep = (size > 1) | dealt
        token, meta, cls, new, size, dealt = (x[keep] for x in (token, meta, cls, new, size, dealt))
        if not len(token):
            return
        n, place = _unpacked(meta)
        # a group's first member is its pivot; one whose size is too far from its pivot's is a pivot for those after it
        index = np.arange(len(token))
        pivot = np.maximum.accumulate(np.where(new, index, 0))
        while (far := np.minimum(n, n[pivot]) * 100 < np.maximum(n, n[pivot]) * percent).any():
            start = np.flatnonzero(far & np.r_[True, (pivot[1:] != pivot[:-1]) | ~far[:-1]])
            mark = np.zeros(len(n), np.int64)
            mark[start] = start
            pivot = np.where(far, np.maximum(pivot, np.maximum.accumulate(mark)), pivot)
        good = (pivot != index) & _allowed(n[pivot], n, place[pivot], place, percent)
        b = index[good]
        yield _batch(_STARS, len(b), a=cls[pivot[b]], b=cls[b], only=(size[b] == 2) & ~dealt[b])
        if first:
            more = (size > 2) | dealt
            for again, rows in ((False, np.flatnonzero(more)), (True, np.flatnonzero(dealt & (pivot == index)))):
                yield _batch(_STARS, len(rows), a=cls[rows], again=np.full(len(rows), again), token=token[rows].view(np.int64), meta=meta[rows])

    return run


def _slot(row: np.ndarray) -> np.ndarray:
    return (words.mix(row.view(np.uint64)) >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.zeros(1 << _FILTER_BITS, bool)
    for batch in batches:
        bits[_slot(batch["row"].to_numpy())] = True
    blocks = bits.reshape(-1, 1 << 16)
    used = np.flatnonzero(blocks.any(axis=1)).astype(np.int32)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array([zlib.compress(np.packbits(blocks[k]).tobytes(), 1) for k in used], pa.binary())], names=["block", "bits"])


def _either(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    blocks: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, bits in zip(batch["block"].to_pylist(), batch["bits"].to_pylist()):
            own = blocks.setdefault(k, np.zeros(1 << 13, np.uint8))
            own |= np.frombuffer(zlib.decompress(bits), np.uint8)
    yield pa.RecordBatch.from_arrays([pa.array(list(blocks), pa.int32()), pa.array([b.tobytes() for b in blocks.values()], pa.binary())], names=["block", "bits"])


def _filter(rows: DataFrame, tasks: int) -> np.ndarray:
    """A bit map of fixed size over ``row``: texts without a bit are in no pair and need not move."""
    bits = np.zeros(1 << (_FILTER_BITS - 3), np.uint8)
    marked = rows.mapInArrow(_marks, "block int, bits binary").repartition(tasks, "block").mapInArrow(_either, "block int, bits binary")
    for r in marked.collect():
        bits[r["block"] << 13 : (r["block"] + 1) << 13] = np.frombuffer(r["bits"], np.uint8)
    return bits


def _needed(bits: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _slot(batch["row"].to_numpy())
            yield batch.filter(pa.array((bits[at >> 3] >> (7 - (at & 7)) & 1).astype(bool)))

    return run


def _verify(n_words: int, percent: int):
    """Pairs sorted by hub (tx) to those whose sets are similar enough; a hub's set is made once in a run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, mine = None, np.empty(0, np.uint64)
        for batch in batches:
            good, hubs, at = np.zeros(len(batch), bool), batch["rx"].to_numpy(), 0
            for part in words.slices(batch, "ty"):
                for found in words.shingle_sets(*words.buffers(part["ty"]), n_words):
                    if hub != hubs[at]:
                        hub = hubs[at]
                        mine = next(words.shingle_sets(*words.buffers(batch["tx"].slice(at, 1)), n_words))
                    both = len(np.intersect1d(mine, found, assume_unique=True))
                    good[at] = both > 0 and 100 * both >= percent * (len(mine) + len(found) - both)
                    at += 1
            keep = pa.array(good)
            yield pa.RecordBatch.from_arrays([batch["u"].filter(keep), batch["v"].filter(keep)], names=["u", "v"])

    return run


class Join:
    """One run over a table of documents; ``documents()`` is the result.

    A column named by ``carry`` comes along with each document, as text.
    """

    def __init__(self, docs: DataFrame, n_words: int = WORDS, percent: int = PERCENT, carry: str | None = None) -> None:
        self.n_words, self.percent = n_words, percent
        self.tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.texts = docs.select("doc_id", "text").withColumn("row", row_key())
        carried = F.lit(None).cast("string") if carry is None else F.col(carry).cast("string")
        profiled = docs.select("doc_id", "text", carried.alias("carried")).withColumn("row", row_key())
        found = kept(profiled.mapInArrow(_profile(n_words), PROFILE))
        self.profile = found.where("block is null").select("doc_id", "row", "carried", "words", "n", "cls", "short", "parts")
        self.order = _order(found.where("block is not null").select("block", "counts"), self.tasks)
        one = self.profile.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("least"), F.min(F.struct("row", "n", "short", "parts")).alias("r"))
        self.classes = kept(one.select("cls", "least", "r.*"))

    def _group(self, postings: DataFrame, first: bool) -> DataFrame:
        dealt = postings.repartition("bucket").sortWithinPartitions("bucket")
        return dealt.mapInArrow(_stars(self.percent, first), STARS)

    def candidates(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Pairs with pivots (a, b, times met, only), postings of shingles in three classes or more, and the table that holds these."""
        n = self.profile.where("n > 0").agg(F.sum(_prefix(F.col("n"), self.percent))).first()[0] or 0
        buckets = max(self.tasks, -(-int(n) // BUCKET))
        postings = self.texts.select("text").mapInArrow(_postings(self.order, self.n_words, self.percent, buckets), POSTINGS)
        out = kept(self._group(postings, True))
        again = out.where("again").select("token", "meta", F.col("a").alias("cls")).mapInArrow(_packed(buckets), POSTINGS)
        pairs = out.where("b is not null").unionByName(self._group(again, False).where("b is not null"))
        met = kept(pairs.groupBy("a", "b").agg(F.count("*").alias("met"), F.max("only").alias("only")))
        return met, out.where("not again").select(F.col("a").alias("cls"), "token", "meta"), out

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Links (u, v: classes) of the pairs (a, b: short classes) that are similar enough."""
        c = self.classes
        x = c.select(F.col("short").alias("a"), F.col("cls").alias("u"), F.col("row").alias("rx"), F.col("n").alias("nx"), F.col("parts").alias("px"))
        y = c.select(F.col("short").alias("b"), F.col("cls").alias("v"), F.col("row").alias("ry"), F.col("n").alias("ny"), F.col("parts").alias("py"))
        both = pairs.select("a", "b").join(x, "a").join(y, "b")
        apart = F.aggregate(F.zip_with("px", "py", lambda p, q: F.abs(p.cast("int") - q.cast("int"))), F.lit(0), lambda s, v: s + v)
        # sets of nx and ny members that share s differ in nx + ny - 2 s places
        both = both.where(apart * (100 + self.percent) <= (F.col("nx") + F.col("ny")) * (100 - self.percent))
        both = kept(both.select("u", "v", "rx", "ry"))
        bits = _filter(both.select(F.col("rx").alias("row")).union(both.select("ry")), self.tasks)
        texts = self.texts.select("row", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_needed(bits), "row long, text string").dropDuplicates(["row"])
        spokes = both.join(texts.select(F.col("row").alias("ry"), F.col("text").alias("ty")), "ry")
        pairs = spokes.join(texts.select(F.col("row").alias("rx"), F.col("text").alias("tx")), "rx").select("u", "v", "rx", "tx", "ty")
        good = kept(pairs.mapInArrow(_verify(self.n_words, self.percent), "u binary, v binary"))
        remove(both)
        return good

    def links(self) -> DataFrame:
        """Edges from each class that is linked to anything to the smallest class of its component."""
        met, rest, stars = self.candidates()
        first = met.groupBy("b").agg(F.max_by("a", F.struct("met", "a")).alias("a"))
        good = self.verified(first)
        near = components(good)
        # the component of each class that has one, by what stands for the class in postings
        root = near.union(near.select("v", "v").distinct()).toDF("cls", "root")
        root = kept(self.classes.select("cls", "short").join(root, "cls").select("short", "root"))

        def labelled(rows: DataFrame, key: str, out: str) -> DataFrame:
            own = F.coalesce("root", F.unhex(F.hex(key)))
            return rows.join(root.withColumnRenamed("short", key), key, "left").withColumn(out, own).drop("root")

        rest = labelled(rest, "cls", "part")
        # shingles of a passage are in the same classes: one group stands for them, with each class's first place
        members = F.bit_xor(F.xxhash64("cls")).alias("members")
        open_ = rest.groupBy("token").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), members).where("lo <> hi")
        rest = kept(rest.join(open_.select("token", "members"), "token").groupBy("members", "cls", "part").agg(F.min("meta").alias("meta")))
        remove(stars, good)
        n, place = _unpacked(F.col("meta"))
        x, y = _cells(rest.select("members", "cls", "part", n.alias("n"), place.alias("place")), "members", self.percent)
        fits = _allowed(F.col("n_x"), F.col("n_y"), F.col("place_x"), F.col("place_y"), self.percent)
        cross = x.join(y, ["members", "low", "high"]).where((F.col("part_x") != F.col("part_y")) & fits).select("cls_x", "cls_y")
        lone = labelled(labelled(met.where("only").select("a", "b"), "a", "p"), "b", "q").where("p <> q").select("a", "b")
        order = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
        more = cross.toDF("a", "b").union(lone).select(*order).distinct().join(first.select(*order), ["a", "b"], "left_anti")
        last = self.verified(more)
        linked = components(near.union(last))
        remove(met, root, rest, near, last)
        return linked

    def documents(self) -> DataFrame:
        """doc_id, n_shingles, component_id of every document, its row key, and what tells components apart.

        ``group`` is null for documents without a word, which are alone.  ``words`` is the number of words,
        ``carried`` the column named by ``carry``.
        """
        root = self.links().toDF("cls", "root")
        least = self.classes.select("cls", "least").join(root, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
        smallest = least.groupBy("root").agg(F.min("least").alias("component_id"))
        of = least.join(smallest, "root").select("cls", "component_id", "root")
        rows = self.profile.select("doc_id", "row", "n", "cls", "words", "carried").join(of, "cls", "left")
        component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
        return rows.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), "row", F.col("root").alias("group"), "words", "carried")


def join(docs: DataFrame, n_words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """See ``Join.documents``."""
    return Join(docs, n_words, percent).documents()


def one_of_each(docs: DataFrame, n_words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each component: the one of the smallest id (unknown ids last).

    Documents without a word stay. Of rows that repeat an id and a text one stays.
    """
    found = join(docs, n_words, percent)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "row")).alias("best")
    stay = found.where("group is not null").groupBy("group").agg(best).select("best.row").union(found.where("group is null").select("row"))
    (key,) = fresh(docs, "row")
    rows = docs.withColumn(key, row_key()).join(stay.distinct().toDF(key), key, "left_semi")
    return rows.dropDuplicates([key]).drop(key)
