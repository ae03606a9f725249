"""Repeated hashes of a corpus, found in one shuffle of packed hashes.

`repeat_sketch`: each task sorts the 64-bit hashes it meets, drops its own repeats and sends one
packed row per hash range; each range reports a slice of a Bloom filter of the
hashes met at least twice, and the order of magnitude of frequent ones.  The
sketch has a fixed size whatever the corpus: an overfull one only lets more
hashes pass as repeated, and everything built on it stays exact.

`repeated_enough` has no such size: each range answers the tasks' packed hashes, so
what is decided does not get coarser as the corpus grows.  `IdFilter` is for
documents, which are some hundred times fewer than hashes.
"""

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import textbytes as tb
from .tables import bucket_count

U64 = np.uint64
#: A task packs and sends what it has after so many hashes.
FLUSH = 1 << 20
#: Bits of the whole filter, and bytes of the frequency classes, at most.
FILTER_BITS = 1 << 27
CLASS_BYTES = 1 << 21
#: Parts in which slices of a fixed size come to the driver: a job each, whatever the number of partitions.
PARTS = 8
#: Hashes met less often have no frequency class.
FREQUENT = 8


class RepeatSketch:
    def __init__(self, bits, filters, classes):
        """bits: of the bucket number; filters and classes: a row of bytes per bucket."""
        self.bits, self.width, self.slots = bits, filters.shape[1] * 8, classes.shape[1]
        self.filters, self.classes = filters.reshape(-1), classes.reshape(-1)

    @classmethod
    def shared(cls, spark, sketch):
        """A function that returns the broadcast sketch on an executor; its arrays are not copied."""
        held = spark.sparkContext.broadcast((sketch.bits, sketch.width, sketch.slots, sketch.filters, sketch.classes))

        def get():
            out = cls.__new__(cls)
            out.bits, out.width, out.slots, out.filters, out.classes = held.value
            return out

        return get

    def repeated(self, hashes):
        """False only for hashes that the corpus holds once."""
        out = None
        for at in _probes(hashes, self.bits, self.width):
            hit = (self.filters[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
            out = hit if out is None else out & hit
        return out

    def magnitude(self, hashes):
        """At least log2 of the hash's count where that is `FREQUENT` or more, else mostly 0."""
        return self.classes[_slots(hashes, self.bits, self.slots)]


def _buckets(hashes, bits):
    return (hashes >> U64(64 - bits)).astype(np.int64)


def _probes(hashes, bits, width):
    base = _buckets(hashes, bits) * width
    yield base + (hashes & U64(width - 1)).astype(np.int64)
    yield base + ((tb.mix(hashes) >> U64(20)) & U64(width - 1)).astype(np.int64)


def _slots(hashes, bits, slots):
    return _buckets(hashes, bits) * slots + ((hashes >> U64(8)) & U64(slots - 1)).astype(np.int64)


def by_bucket(sorted_hashes, bits):
    """(bucket, first, one past the last) of sorted hashes."""
    edges = np.searchsorted(_buckets(sorted_hashes, bits), np.arange((1 << bits) + 1))
    for b in np.flatnonzero(np.diff(edges)):
        yield int(b), int(edges[b]), int(edges[b + 1])


def repeat_sketch(df: DataFrame, hashes_of) -> RepeatSketch:
    """The sketch of all hashes that `hashes_of(batch)` yields as uint64 arrays, one array a document."""
    spark = df.sparkSession
    buckets = bucket_count(spark)
    bits = buckets.bit_length() - 1
    width, slots = min(1 << 20, FILTER_BITS // buckets), max(1, CLASS_BYTES // buckets)

    def send(batches):
        def pack(held):
            hashes, counts = np.unique(np.concatenate(held), return_counts=True)
            once, many = hashes[counts == 1], hashes[counts > 1]
            counts = np.minimum(counts[counts > 1], 0xFFFFFFFF).astype(np.uint32)
            rows = {b: [once[i:j].tobytes(), b"", b""] for b, i, j in by_bucket(once, bits)}
            for b, i, j in by_bucket(many, bits):
                rows.setdefault(b, [b"", b"", b""])[1:] = many[i:j].tobytes(), counts[i:j].tobytes()
            return pa.RecordBatch.from_arrays([pa.array(list(rows), pa.int32()), *(pa.array([r[i] for r in rows.values()], pa.binary()) for i in range(3))], names=["bucket", "once", "many", "counts"])

        held, size = [], 0
        for batch in batches:
            for hashes in hashes_of(batch):
                held.append(hashes)
                size += len(hashes)
                if size >= FLUSH:
                    yield pack(held)
                    held, size = [], 0
        if size:
            yield pack(held)

    def summarise(table):
        blob = lambda name, kind: np.frombuffer(b"".join(table.column(name).to_pylist()), kind)
        once, many, counts = blob("once", U64), blob("many", U64), blob("counts", np.uint32)
        hashes, of = np.unique(np.concatenate([once, many]), return_inverse=True)
        total = np.bincount(of, np.concatenate([np.ones(len(once)), counts]), len(hashes))
        bucket = table.column("bucket")[0].as_py()
        base = bucket * width
        marks = np.zeros(width, np.uint8)
        for at in _probes(hashes[total > 1], bits, width):
            marks[at - base] = 1
        classes = np.zeros(slots, np.uint8)
        often = total >= FREQUENT
        np.maximum.at(classes, _slots(hashes[often], bits, slots) - bucket * slots, np.log2(total[often]).astype(np.uint8))
        return pa.table({"bucket": pa.array([bucket], pa.int32()), "marks": pa.array([np.packbits(marks, bitorder="little").tobytes()], pa.binary()), "classes": pa.array([classes.tobytes()], pa.binary())})

    packed = df.mapInArrow(send, "bucket int, once binary, many binary, counts binary")
    slices = packed.groupBy("bucket").applyInArrow(summarise, "bucket int, marks binary, classes binary")
    filters, classes = np.zeros((buckets, width // 8), np.uint8), np.zeros((buckets, slots), np.uint8)
    for row in slices.repartition(PARTS).toLocalIterator():  # a few jobs, and an eighth of the sketch at once
        filters[row.bucket] = np.frombuffer(row.marks, np.uint8)
        classes[row.bucket] = np.frombuffer(row.classes, np.uint8)
    return RepeatSketch(bits, filters, classes)


class IdFilter:
    """Which int64 ids may be among those of a DataFrame; none of these is missed."""

    _SLICE_BITS = 5

    def __init__(self, marks):
        self.marks = marks

    @classmethod
    def shared(cls, ids: DataFrame):
        """A function that returns the filter of `ids` (id: long) on an executor."""
        spark, bits = ids.sparkSession, max(16, min(FILTER_BITS.bit_length() - 1, ids.count().bit_length() + 4))
        width = 1 << (bits - cls._SLICE_BITS)

        def slice_of(table):
            marks = np.zeros(width, np.uint8)
            for at in cls._places(table.column("id").to_numpy(), width):
                marks[at % width] = 1
            return pa.table({"part": pa.array([int(at[0] // width)]), "marks": pa.array([np.packbits(marks, bitorder="little").tobytes()], pa.binary())})

        def part_of(batches):
            for batch in batches:
                part = _buckets(tb.mix(batch.column("id").to_numpy().view(U64)), cls._SLICE_BITS)
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(part)], names=["id", "part"])

        marks = np.zeros(1 << (bits - 3), np.uint8)
        parts = ids.select("id").mapInArrow(part_of, "id long, part long")
        for row in parts.groupBy("part").applyInArrow(slice_of, "part long, marks binary").repartition(PARTS).toLocalIterator():
            marks[row.part * width // 8 : (row.part + 1) * width // 8] = np.frombuffer(row.marks, np.uint8)
        held = spark.sparkContext.broadcast(marks)
        return lambda: cls(held.value)

    @classmethod
    def _places(cls, ids, width):
        hashes = tb.mix(ids.view(U64))
        base = _buckets(hashes, cls._SLICE_BITS) * width
        yield base + (hashes & U64(width - 1)).astype(np.int64)
        yield base + ((hashes >> U64(30)) & U64(width - 1)).astype(np.int64)

    def may_hold(self, ids):
        out = np.ones(len(ids), bool)
        for at in self._places(ids, len(self.marks) * 8 >> self._SLICE_BITS):
            out &= (self.marks[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
        return out


def repeated_enough(df: DataFrame, sets_of) -> DataFrame:
    """(id) of the documents that have as many repeated hashes as they need.

    sets_of(batch) yields (id, distinct hashes, need), one a document.  A hash is
    repeated if another document has it, or, seldom, one of equal first bits: so
    counts are never too low.
    """
    buckets = bucket_count(df.sparkSession, factor=1)
    bits = buckets.bit_length() - 1
    names = ["bucket", "chunk", "rests", "of", "ids"]

    def send(batches):
        def pack(held):
            ids, sets, needs = zip(*held)
            ids, needs = np.array(ids, np.int64), np.array(needs, np.int32)
            of = np.repeat(np.arange(len(sets), dtype=np.uint16), [len(x) for x in sets])
            flat = np.concatenate(sets)
            # Of what it holds and where it is made, so that a task that runs anew sends the same.
            chunk = int(tb.mix(np.array([tb.mix(ids.view(U64) + np.arange(len(ids), dtype=U64)).sum(dtype=U64)]) + U64(TaskContext.get().partitionId()))[0] >> U64(1))
            order = np.argsort(flat)
            flat, of = flat[order], of[order]
            rests = (flat >> U64(32 - bits)).astype(np.uint32)
            rows = [(chunk % buckets, chunk, None, needs.tobytes(), ids.tobytes())]
            rows += [(b, chunk, rests[i:j].tobytes(), of[i:j].tobytes(), None) for b, i, j in by_bucket(flat, bits)]
            kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)

        held, size = [], 0
        for batch in batches:
            for one in sets_of(batch):
                held.append(one)
                size += len(one[1])
                if size >= FLUSH or len(held) == 1 << 16:
                    yield pack(held)
                    held, size = [], 0
        if held:
            yield pack(held)

    def answer(table):
        """The documents' own rows as they are, and per chunk which of its documents have a repeated hash, once for each."""
        own = table.filter(table.column("rests").is_null()).select(["chunk", "of", "ids"])
        asked = table.filter(table.column("rests").is_valid())
        if not asked.num_rows:
            return own
        rests = [np.frombuffer(r, np.uint32) for r in asked.column("rests").to_pylist()]
        ends = np.cumsum([len(r) for r in rests])
        _, of, counts = np.unique(np.concatenate(rests), return_inverse=True, return_counts=True)
        again = counts[of] > 1
        found = {}
        for chunk, texts, end in zip(asked.column("chunk").to_pylist(), asked.column("of").to_pylist(), ends):
            texts = np.frombuffer(texts, np.uint16)
            found.setdefault(chunk, []).append(texts[again[end - len(texts) : end]])
        found = [(chunk, np.concatenate(x).tobytes()) for chunk, x in found.items()]
        made = pa.table([pa.array([c for c, _ in found], pa.int64()), pa.array([x for _, x in found], pa.binary()), pa.nulls(len(found), pa.binary())], names=["chunk", "of", "ids"])
        return pa.concat_tables([own.cast(made.schema), made])

    def decide(table):
        own = table.filter(table.column("ids").is_valid())
        rest = table.filter(table.column("ids").is_null()).column("of").to_pylist()
        counts = np.bincount(np.frombuffer(b"".join(rest), np.uint16), minlength=1 << 16)
        out = []
        for need, ids in zip(own.column("of").to_pylist(), own.column("ids").to_pylist()):
            need = np.frombuffer(need, np.int32)
            out.append(np.frombuffer(ids, np.int64)[counts[: len(need)] >= need])
        return pa.table({"id": np.concatenate(out)})

    asked = df.mapInArrow(send, "bucket int, chunk long, rests binary, of binary, ids binary")
    answers = asked.groupBy("bucket").applyInArrow(answer, "chunk long, of binary, ids binary")
    return answers.groupBy("chunk").applyInArrow(decide, "id long")
