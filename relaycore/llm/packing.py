"""Shortest-pack-first sequence packing over the length histogram.

Every document is tokenised, ended with one end id and cut into pieces of at
most `size` ids.  Only the histogram of piece lengths, `size` numbers, comes to
the driver.  Lengths are placed longest first, each into the pack pattern that
is filled least among those with room; patterns carry counts, so the work
follows the number of lengths and not of documents.  Each pattern slot then owns
a run of ranks of its length, and pieces find their sequence and offset by
their rank among the pieces of that length.

Ranks are counted per (length, bucket), where a piece's bucket is a hash of its
document, and shifted by the buckets before; the number of buckets follows that of
the pieces (`BUCKET_PIECES`), so no length is ranked in one task.

Defined cases: a null text counts as empty and yields the end id alone; repeated
rows are packed each, and equal pieces of equal documents are placed in any order;
null doc_ids are packed like others; an empty table gives no sequences; other
columns of the documents are not carried.
"""

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .tables import bucket_count, cut

#: Pieces of a bucket, about; a rank window sorts no more of one length.
BUCKET_PIECES = 100_000
#: The text of the vocabulary's special token is not ordinary text to the tokenizer.
SPECIAL = "<|endoftext|>"


class Encoder:
    """ids of the byte-level BPE tokenizer file.

    Latin-1 texts without the special token go through tiktoken with the same
    vocabulary, which is several times as fast and gives equal ids; any other
    text goes through tokenizers.
    """

    def __init__(self, path):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.fast = None
        try:
            import base64

            import public_tokenizers
            import tiktoken

            with open(path.removesuffix(".json") + ".tiktoken", "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        except (ImportError, OSError):
            pass  # no twin of the vocabulary: the tokenizer alone

    def __call__(self, text):
        if self.fast is not None and SPECIAL not in text:
            try:
                text.encode("latin-1")
                return self.fast.encode_ordinary(text)
            except UnicodeEncodeError:
                pass
        return self.slow.encode(text, add_special_tokens=False).ids


def pieces(docs: DataFrame, tokenizer: str, size: int = 1024, doc_id: str = "doc_id", text: str = "text", end: int = 0, with_ids: bool = False) -> DataFrame:
    """The pieces of every document: doc_id, start, length, ids_crc32, doc_tokens (and ids)."""
    kind = docs.schema[doc_id].dataType.simpleString()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids]

    def run(batches):
        encode = Encoder(tokenizer)
        for batch in batches:
            rows, parts = [], []
            for row, value in enumerate(batch.column(1).to_pylist()):
                ids = np.array([*encode(value or ""), end], "<u4")
                for start in range(0, len(ids), size):
                    part = ids[start : start + size]
                    rows.append((row, start, len(part), zlib.crc32(part.tobytes()), len(ids)))
                    if with_ids:
                        parts.append(part.astype(np.int32))
            made = [pa.array([r[i] for r in rows], pa.int64()) for i in range(5)]
            extra = [pa.array(parts, pa.list_(pa.int32()))] if with_ids else []
            yield pa.RecordBatch.from_arrays([batch.column(0).take(made[0]), *made[1:], *extra], names=names)

    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def pack_histogram(histogram: dict[int, int], size: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Pack patterns as (((length, repeats), ...), count), from a histogram of lengths."""
    open_packs: dict[int, list] = defaultdict(list)  # by fill: [pattern, count] with room left
    done = []

    def put(fill, pattern, count):
        (done if fill == size else open_packs[fill]).append((pattern, count))

    for length in range(size, 0, -1):
        left = histogram.get(length, 0)
        while left:
            fill = next((f for f in range(1, size - length + 1) if open_packs.get(f)), None)
            if fill is None:
                put(length, ((length, 1),), left)
                break
            pattern, count = open_packs[fill].pop()
            times = min(count, left)
            if times < count:
                open_packs[fill].append((pattern, count - times))
            last, repeats = pattern[-1]
            grown = (*pattern[:-1], (last, repeats + 1)) if last == length else (*pattern, (length, 1))
            put(fill + length, grown, times)
            left -= times
    return done + [x for packs in open_packs.values() for x in packs]


def layout(patterns) -> list[tuple[int, int, int, int, int, int]]:
    """Slots (length, first rank, one past the last, repeats, first offset, first sequence) of the patterns."""
    slots, rank, sequence = [], defaultdict(int), 0
    for pattern, count in patterns:
        offset = 0
        for length, repeats in pattern:
            slots.append((length, rank[length], rank[length] + count * repeats, repeats, offset, sequence))
            rank[length] += count * repeats
            offset += length * repeats
        sequence += count
    return slots


def pack(docs: DataFrame, tokenizer: str, size: int = 1024, **columns) -> DataFrame:
    """Pieces with their sequence_id and offset."""
    spark = docs.sparkSession
    made = cut(pieces(docs, tokenizer, size, **columns))
    buckets = max(bucket_count(spark), made.count() // BUCKET_PIECES)
    made = made.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets).cast("long")))
    counts = cut(made.groupBy("length", "bucket").agg(F.count("*").alias("n")))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = layout(pack_histogram(histogram, size))
    slots = spark.createDataFrame(slots, "s_length long, first long, last long, repeats long, s_offset long, s_sequence long")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = counts.select(F.col("length").alias("c_length"), F.col("bucket").alias("c_bucket"), before.alias("before"))
    ranked = made.withColumn("rank", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32")) - 1)
    ranked = ranked.join(shifts, (F.col("length") == F.col("c_length")) & (F.col("bucket") == F.col("c_bucket")))
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("before"))
    # The slots are broadcast: their number is bounded by `size`, whatever the number of pieces.
    placed = ranked.join(F.broadcast(slots), (F.col("length") == F.col("s_length")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last")))
    at = F.col("rank") - F.col("first")
    kept = [c for c in made.columns if c != "bucket"]
    return placed.select(*kept, (F.col("s_sequence") + F.floor(at / F.col("repeats"))).alias("sequence_id"), (F.col("s_offset") + (at % F.col("repeats")) * F.col("length")).alias("offset"))
