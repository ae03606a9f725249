"""Exact substring deduplication with two-stage suffix sorting.

Every byte covered by a `length`-byte string that also starts earlier is
removed; earlier means in a document of smaller doc_id, or before in the same.

1. Winnowing picks anchors: in each `length`-byte window the leftmost of its
   least `GRAM`-byte hashes.  Equal windows have equal anchors at equal places,
   so windows meet if they are gathered by anchor hash; a sketch of repeated
   hashes drops most anchors unseen.
2. An anchor's snippet is the bytes of all windows that chose it.  Anchors that
   the sketch knows as very frequent are split: their windows are dealt by the
   bytes next to the anchor, on whichever side the window holds more, as often as
   the frequency asks for.  So no hash gathers a part of the corpus.
3. Equal snippets hold the same windows, so of these only the earliest place goes
   on, and all others are removed whole: first within a task, then, packed by hash
   range, within a range.  The snippets of a hash that still has several different
   ones are concatenated and suffix-sorted in two stages: suffixes smaller than
   their successor are sorted directly, the others are induced by one scan over the
   buckets of first bytes.  Adjacent common prefixes of `length` bytes mark equal
   windows; of these only the earliest stays.
4. The removed intervals meet their documents by doc_id.  A filter of the documents
   that lose something, of a fixed size, lets all others pass unshuffled; overfull,
   it costs time only.

A hash range holds one entry for each snippet and task at most, however many
documents share a passage.

Defined cases: documents with the same doc_id and the same text are one document;
with the same doc_id and other texts they follow the hash of the text.  A null
doc_id comes first.  Null and empty texts have no bytes; texts shorter than
`length` lose nothing; an empty table gives no rows.  `clean` keeps all columns,
whatever their names, and all rows; a null text stays null.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textbytes as tb
from .exchange import PARTS, RepeatSketch, by_bucket, repeat_sketch
from .tables import bucket_count, cut, free_names

U64 = np.uint64
GRAM = 32
_STEP = U64(0x9E3779B97F4A7C15)
#: Snippet bytes a task holds before it packs, and bytes sorted at once.
HELD_BYTES = 6 << 20
SORTED_BYTES = 1 << 18
NULL_ID = -(1 << 63)
#: log2 of the occurrences from which an anchor is split, and of the factor for each further split.
SPLIT_FROM, SPLIT_STEP = 14, 2
#: Bits of the filter of documents that lose bytes.
MARK_BITS = 24
_SEPARATOR = 0xFF  # in no UTF-8 text
ENTRY = np.dtype([("hash", "<u8"), ("doc", "<i8"), ("text", "<i8"), ("start", "<u4"), ("size", "<u4")])


def _gram_hashes(arr):
    """Hashes of all GRAM-byte strings, by doubling."""
    h, width, power = arr.astype(U64) + U64(1), 1, _STEP
    while width < GRAM:
        h = h[: len(h) - width] * power + h[width:]
        power, width = power * power, 2 * width
    return tb.mix(h)


def _sliding(values, width, best):
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = best(out[: len(out) - step], out[step:])
        have += step
    return out


def anchors(arr, length):
    """(hash, first window, last window, place) of the anchors of a text; every window has one."""
    windows = len(arr) - length + 1
    if windows < 1:
        return np.empty(0, U64), *[np.empty(0, np.int64)] * 3
    with np.errstate(over="ignore"):
        grams = _gram_hashes(arr)
    span = length - GRAM + 1
    least = _sliding(grams, span, np.minimum)
    edge = np.zeros(span - 1, U64)
    best = _sliding(np.concatenate([edge, least, edge]), span, np.maximum)
    chosen = np.flatnonzero(grams == best)
    values = grams[chosen]
    run = np.concatenate([[0], np.cumsum(values[1:] != values[:-1])])
    starts = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
    ends = np.concatenate([starts[1:], [windows]]) - 1
    after = np.concatenate([[0], np.where(run[1:] == run[:-1], chosen[:-1] + 1, 0)])
    first, last = np.maximum(starts[run], after), np.minimum(ends[run], chosen)
    some = first <= last
    # Least hashes crowd near zero: mixed again, they spread evenly over the hash ranges.
    return tb.mix(values[some] + _STEP), first[some], last[some], chosen[some]


def split_windows(data, key, first, last, place, levels, length):
    """(key, first, last) of the parts of an anchor's windows, dealt `levels` times by the bytes around what all in a part have in common.

    A window that holds the known bytes [lo, hi) reaches at least half of its other
    bytes to the right of them, or more to the left: these bytes become known too.
    Equal windows take the same turns.
    """
    parts = [(key, first, last, place, place + GRAM)]
    for _ in range(levels):
        out = []
        for key, first, last, lo, hi in parts:
            half = (length - (hi - lo) + 1) // 2
            if not half:
                out.append((key, first, last, lo, hi))
                continue
            turn = hi + half - length  # from this window on there is more to the right
            for side, start, end, new_lo, new_hi in ((0, first, min(last, turn - 1), lo - half, hi), (1, max(first, turn), last, lo, hi + half)):
                if start <= end:
                    known = hashlib.blake2b(b"%d %d " % (key, side) + data[new_lo:new_hi], digest_size=8).digest()
                    out.append((int.from_bytes(known, "little"), start, end, new_lo, new_hi))
        parts = out
    return [p[:3] for p in parts]


def two_stage_suffix_array(text, depth):
    """Suffixes of a uint8 array in the order of their first `depth` bytes."""
    n = len(text)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(text[1:].astype(np.int16) - text[:-1])
    step[-1] = -1  # the last suffix is larger than the empty one
    # Equal neighbours take the type of the next unequal pair.
    at = np.where(step != 0, np.arange(n), n - 1)
    smaller = step[np.minimum.accumulate(at[::-1])[::-1]] > 0
    direct = _sort_directly(text, np.flatnonzero(smaller), depth)
    first = text[direct]
    bounds = np.searchsorted(first, np.arange(257))
    induced = [[] for _ in range(256)]
    out = []
    induced[text[-1]].append(np.array([n - 1]))
    for c in range(256):
        found = np.concatenate(induced[c]) if induced[c] else np.empty(0, np.int64)
        parts = [found] if len(found) else []
        while len(found):  # runs of the same byte induce within their own bucket
            found = found[found > 0] - 1
            found = found[(text[found] == c) & ~smaller[found]]
            if len(found):
                parts.append(found)
        parts.append(direct[bounds[c] : bounds[c + 1]])
        bucket = np.concatenate(parts)
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[text[before] > c]
        if len(before):
            symbols = text[before]
            order = np.argsort(symbols, kind="stable")
            met, starts = np.unique(symbols[order], return_index=True)
            for symbol, places in zip(met.tolist(), np.split(before[order], starts[1:])):
                induced[symbol].append(places)
    return np.concatenate(out)


def _words(text):
    """The eight bytes from each place on as one big-endian number; zeros follow the text."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(U64)
    out = padded
    for width in (1, 2, 4):
        out = (out[: len(out) - width] << U64(8 * width)) | out[width:]
    return out[: len(text)]


def _sort_directly(text, places, depth):
    keys = _words(text)
    at = lambda p: np.where(p < len(keys), keys[np.minimum(p, len(keys) - 1)], U64(0))
    order = places[np.argsort(keys[places], kind="stable")]
    value = keys[order]
    new = np.concatenate([[True], value[1:] != value[:-1]]) if len(order) else np.empty(0, bool)
    for offset in range(8, depth, 8):
        tied = ~new
        tied[:-1] |= ~new[1:]
        where = np.flatnonzero(tied)
        if not len(where):
            break
        group = np.cumsum(new)[where]
        value = at(order[where] + offset)
        turn = np.lexsort((value, group))
        order[where], value = order[where][turn], value[turn]
        split = np.concatenate([[True], (value[1:] != value[:-1]) | (group[1:] != group[:-1])])
        new[where] |= split
    return order


def repeated_windows(snippets, owners, length):
    """For each snippet the offsets of its windows whose bytes occur at an earlier place.

    owners: (document rank, start) of each snippet's earliest place.
    """
    sizes = np.array([len(s) for s in snippets])
    text = np.frombuffer(bytes([_SEPARATOR]).join(snippets) + bytes([_SEPARATOR]), np.uint8)
    base = np.concatenate([[0], np.cumsum(sizes[:-1] + 1)])
    order = two_stage_suffix_array(text, length)
    of = np.searchsorted(base, order, "right") - 1
    whole = order - base[of] + length <= sizes[of]
    order, of = order[whole], of[whole]
    keys = _words(text)
    same = np.ones(max(0, len(order) - 1), bool)
    for offset in (*range(0, length - 7, 8), length - 8):
        left = np.flatnonzero(same)
        same[left] = keys[order[left] + offset] == keys[order[left + 1] + offset]
    group = np.concatenate([[0], np.cumsum(~same)])
    offset = order - base[of]
    place = (owners[of, 0] << 32) + owners[of, 1] + offset
    least = np.minimum.reduceat(place, np.flatnonzero(np.concatenate([[True], ~same])))
    late = place > least[group]
    return of[late], offset[late]


def _pack_intervals(starts, ends):
    starts, ends = tb.merge_intervals(np.asarray(starts, np.int64), np.asarray(ends, np.int64))
    return np.stack([starts, ends], axis=1).astype("<u4").tobytes()


class _Intervals:
    """Removed intervals, by document."""

    def __init__(self):
        self.by_doc = {}

    def add(self, doc, start, end):
        held = self.by_doc.setdefault(doc, ([], []))
        held[0].append(start)
        held[1].append(end)

    def columns(self):
        docs = list(self.by_doc)
        return [d[0] for d in docs], [d[1] for d in docs], [_pack_intervals(*self.by_doc[d]) for d in docs]


_ROWS = "bucket int, doc long, text long, cuts binary, entries binary, bytes binary"


def removed_intervals(docs: DataFrame, length: int, split_from: int = SPLIT_FROM) -> DataFrame:
    """(doc, text, cuts) rows of packed intervals, for docs (doc, key, body)."""
    chosen = docs.select("doc", "key", "body")
    buckets = bucket_count(docs.sparkSession)
    bits = buckets.bit_length() - 1

    def hashes(batch):
        for data in batch.column("body").cast(pa.binary()).to_pylist():
            if data is not None and len(data) >= length:
                yield anchors(tb.as_array(data), length)[0]

    sketch = RepeatSketch.shared(docs.sparkSession, repeat_sketch(chosen.select("body"), hashes))

    def send(batches):
        def pack(places, cuts):
            rows = {"bucket": [], "doc": [], "text": [], "cuts": [], "entries": [], "bytes": []}
            snippets = list(places)
            entries = np.array([(h, d, t, s, len(x)) for x, (d, t, s, h) in places.items()], ENTRY)
            order = np.argsort(entries["hash"], kind="stable")
            for b, i, j in by_bucket(entries["hash"][order], bits):
                mine = order[i:j]
                for name, value in zip(rows, (b, None, None, None, entries[mine].tobytes(), b"".join(snippets[k] for k in mine))):
                    rows[name].append(value)
            for doc, text, blob in zip(*cuts.columns()):
                for name, value in zip(rows, (hash((doc, text)) & (buckets - 1), doc, text, blob, None, None)):
                    rows[name].append(value)
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(rows.values(), kinds)], names=list(rows))

        places, cuts, size = {}, _Intervals(), 0
        known = sketch()
        for batch in batches:
            for doc, key, data in zip(*(batch.column(c).to_pylist() for c in ("doc", "key")), batch.column("body").cast(pa.binary()).to_pylist()):
                if data is None or len(data) < length:
                    continue
                values, first, last, place = anchors(tb.as_array(data), length)
                some = np.flatnonzero(known.repeated(values))
                levels = np.maximum(known.magnitude(values[some]).astype(np.int64) - split_from, -SPLIT_STEP) // SPLIT_STEP + 1
                found = zip(*(x[some].tolist() for x in (values, first, last, place)), levels.tolist())
                parts = (part for *one, n in found for part in (split_windows(data, *one, n, length) if n else [one[:3]]))
                for h, start, final in parts:
                    end = final + length
                    snippet = data[start:end]
                    held = places.get(snippet)
                    place = (doc, key, start, h)
                    if held is None:
                        places[snippet] = place
                        size += len(snippet)
                        continue
                    if held > place:
                        places[snippet], place = place, held
                    if places[snippet][:3] != place[:3]:
                        cuts.add(place[:2], place[2], place[2] + len(snippet))
                if size > HELD_BYTES:
                    yield pack(places, cuts)
                    places, cuts, size = {}, _Intervals(), 0
        if places:
            yield pack(places, cuts)

    def settle(table):
        cuts, passed, places = _Intervals(), [], {}
        for doc, text, blob, entries, data in zip(*(table.column(c).to_pylist() for c in ("doc", "text", "cuts", "entries", "bytes"))):
            if entries is None:
                passed.append((doc, text, blob))
                continue
            at = 0
            for h, d, t, start, size in np.frombuffer(entries, ENTRY).tolist():
                snippet = data[at : at + size]
                at += size
                place, known = (d, t, start), places.setdefault(h, {})
                held = known.get(snippet)
                if held is None or held > place:
                    known[snippet], place = place, held
                if place is not None and place != known[snippet]:
                    cuts.add(place[:2], place[2], place[2] + size)
        block, size = [], 0
        several = [known for known in places.values() if len(known) > 1]
        for known in [*several, None]:
            if block and (known is None or size > SORTED_BYTES):
                _cut_block(block, length, cuts)
                block, size = [], 0
            for snippet, place in (known or {}).items():
                block.append((snippet, place))
                size += len(snippet)
        docs, texts, blobs = cuts.columns()
        return pa.table({"doc": pa.array([*docs, *(p[0] for p in passed)], pa.int64()), "text": pa.array([*texts, *(p[1] for p in passed)], pa.int64()), "cuts": pa.array([*blobs, *(p[2] for p in passed)], pa.binary())})

    return chosen.mapInArrow(send, _ROWS).groupBy("bucket").applyInArrow(settle, "doc long, text long, cuts binary")


def _cut_block(block, length, cuts):
    """Marks the repeated windows of a block of (snippet, place)."""
    ranks = {doc: rank for rank, doc in enumerate(sorted({place[:2] for _, place in block}))}
    owners = np.array([(ranks[place[:2]], place[2]) for _, place in block], np.int64)
    which, offset = repeated_windows([s for s, _ in block], owners, length)
    if not len(which):
        return
    order = np.lexsort((offset, which))
    which, offset = which[order], offset[order]
    breaks = np.flatnonzero((which[1:] != which[:-1]) | (offset[1:] != offset[:-1] + 1)) + 1
    first, last = np.concatenate([[0], breaks]), np.concatenate([breaks, [len(which)]]) - 1
    for k, lo, hi in zip(which[first].tolist(), offset[first].tolist(), offset[last].tolist()):
        doc, text, start = block[k][1]
        cuts.add((doc, text), start + lo, start + hi + length)


def _marks(cuts: DataFrame, uid: str) -> np.ndarray:
    """The bits of a filter of the uids of `cuts`."""
    spark, bits = cuts.sparkSession, MARK_BITS
    part_bits = 5
    width = 1 << (bits - part_bits)

    def slice_of(table):
        at = (table.column(uid).to_numpy().view(U64) >> U64(64 - bits)).astype(np.int64)
        marks = np.zeros(width, np.uint8)
        marks[at % width] = 1
        return pa.table({"part": pa.array([int(at[0] // width)]), "marks": pa.array([np.packbits(marks, bitorder="little").tobytes()], pa.binary())})

    out = np.zeros(1 << (bits - 3), np.uint8)
    parts = cuts.select(uid, F.shiftrightunsigned(uid, 64 - part_bits).alias("part")).distinct()
    slices = parts.groupBy("part").applyInArrow(slice_of, "part long, marks binary")
    for row in slices.repartition(PARTS).toLocalIterator():
        out[row.part * width // 8 : (row.part + 1) * width // 8] = np.frombuffer(row.marks, np.uint8)
    return out


def _marked(marks, uids):
    at = (uids >> U64(64 - MARK_BITS)).astype(np.int64)
    return (marks[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def each_cut(docs: DataFrame, make, schema, length: int, doc_id: str, text: str, **options) -> DataFrame:
    """make(batch, cuts) over all rows of `docs`, where cuts holds each row's packed intervals, or None.

    Rows of documents that lose nothing are made where they are read; the others meet their intervals in a join.
    """
    spark = docs.sparkSession
    uid, r_uid, cuts = free_names(docs.columns, "uid", "r_uid", "cuts")
    doc = F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID))
    key = F.xxhash64(F.col(text))
    made = removed_intervals(docs.select(doc.alias("doc"), key.alias("key"), F.col(text).alias("body")), length, **options)
    found = cut(made.groupBy(F.xxhash64("doc", "text").alias(r_uid)).agg(F.collect_list("cuts").alias(cuts)))
    held = spark.sparkContext.broadcast(_marks(found, r_uid))
    named = docs.withColumn(uid, F.xxhash64(doc, key))

    def unmarked(batches):
        marks = held.value
        for batch in batches:
            some = np.flatnonzero(~_marked(marks, batch.column(uid).to_numpy().view(U64)))
            if len(some):
                yield from make(batch if len(some) == batch.num_rows else batch.take(pa.array(some)), [None] * len(some))

    def marked(batches):
        marks = held.value
        for batch in batches:
            some = np.flatnonzero(_marked(marks, batch.column(uid).to_numpy().view(U64)))
            if len(some):
                yield batch.take(pa.array(some))

    def joined(batches):
        for batch in batches:
            yield from make(batch, batch.column(cuts).to_pylist())

    some = named.mapInArrow(marked, named.schema).join(found, F.col(uid) == F.col(r_uid), "left").drop(r_uid)
    return named.mapInArrow(unmarked, schema).unionByName(some.mapInArrow(joined, schema))


def runs(packed):
    """Disjoint runs of lists of packed intervals."""
    if not packed:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    pairs = np.frombuffer(b"".join(packed), "<u4").astype(np.int64).reshape(-1, 2)
    return tb.merge_intervals(pairs[:, 0], pairs[:, 1])


def rest(data, starts, ends):
    if not len(starts):
        return data
    return b"".join(data[i:j] for i, j in zip([0, *ends.tolist()], [*starts.tolist(), len(data)]))


def report(docs: DataFrame, length: int = 100, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Per document row: n_bytes, n_removed, n_spans, kept_sha256."""
    chosen = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]

    def make(batch, cuts):
        rows = []
        for data, packed in zip(batch.column("text").cast(pa.binary()).to_pylist(), cuts):
            data = data or b""
            starts, ends = runs(packed)
            rows.append((len(data), int((ends - starts).sum()), len(starts), hashlib.sha256(rest(data, starts, ends)).hexdigest()))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names=names)

    kind = chosen.schema["doc_id"].dataType.simpleString()
    return each_cut(chosen, make, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string", length, "doc_id", "text", **options)


def clean(docs: DataFrame, length: int = 100, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """`docs` without the repeated bytes; a character that loses a byte goes whole."""
    schema = docs.schema

    def make(batch, cuts):
        texts = []
        for data, packed in zip(batch.column(text).cast(pa.binary()).to_pylist(), cuts):
            if data is not None and packed:
                data = rest(data, *runs(packed)).decode("utf-8", "ignore").encode()
            texts.append(data)
        new = pa.array(texts, pa.binary()).cast(batch.schema.field(text).type)
        yield pa.RecordBatch.from_arrays([new if f.name == text else batch.column(f.name) for f in schema], names=schema.names)

    return each_cut(docs, make, schema, length, doc_id, text, **options)
