"""Quality rules with cross-document line frequency.

Each text gets word, symbol and repetition counts.  Its lines are normalised
(lower-cased words joined by one space) and hashed; for every host the distinct
documents of each line are counted.  Lines found in more documents than the
host's limit are removed, and documents left with too few words are rejected,
as are those that fail the base rules.

A document is a doc_id with its text: copies under several ids all count, repeated
rows count once.  The limit of a host is max(`line_limit`, `line_share` * its
documents).  A document that lost lines is depleted if it has fewer than
`min_words` words left, or fewer than `min_left` of its words.

Texts are measured once and then stand for themselves by their hash: rows with
the same host and text are one class with a number of documents, so lines are
spread out and joined per class.  Counts are summed before and after the shuffle
by (host, line), and the join back to the classes deals every frequent line to
`SALTS` places, so neither a line nor a host with a large part of all rows needs a
task of its own.

Defined cases: null, empty and wordless texts have zero counts and fail the base
rules; a null host is a host of its own; null doc_ids with one text are one
document; repeated rows each get a result; ties cannot occur; an empty table gives
no rows.  `clean` keeps all columns of its input, whatever their names.
"""

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textbytes as tb
from .tables import cut, free_names

_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_CONTINUATION = (np.arange(256) >= 0x80) & (np.arange(256) < 0xC0)


def _hash(data):
    return int.from_bytes(blake2b(data, digest_size=8).digest(), "little", signed=True)


def line_key(line):
    """The hash of a line's normalised form and its number of words."""
    words = line.lower().split()
    return _hash(b" ".join(words)), len(words)


def measure(data):
    """word_chars, n_symbols, n_dup_lines, n_repeat_words and the (key, words) of each line with a word."""
    arr = tb.as_array(data)
    starts, ends = tb.word_spans(arr, tb.SPACE_WORD)
    chars = int((ends - starts).sum() - _CONTINUATION[arr].sum())
    words = tb.span_hashes(arr, starts, ends)
    repeated = 0
    if len(words) >= 3:
        _, which, times = np.unique(tb.shingle_hashes(words, 3), return_inverse=True, return_counts=True)
        again = times[which] > 1
        covered = np.zeros(len(words), bool)
        for k in range(3):
            covered[k : k + len(again)] |= again
        repeated = int(covered.sum())
    lines = [line for line in data.split(b"\n") if line.strip()]
    return len(words), chars, int(_SYMBOL[arr].sum()), len(lines) - len(set(lines)), repeated, [line_key(x) for x in lines]


_MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, line_keys array<long>, line_words array<int>"
#: Places to which a frequent line is dealt.
SALTS = 16


def _text_key(text):
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


def measures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """doc_id, host, text_key and the counts and lines of every row."""
    names = [x.split()[0] for x in _MEASURES.split(", ")]

    def run(batches):
        for batch in batches:
            rows = []
            for data in batch.column(3).cast(pa.binary()).to_pylist():
                *counts, lines = measure(data or b"")
                rows.append((*counts, [k for k, _ in lines], [n for _, n in lines]))
            kinds = [pa.int64()] * 5 + [pa.list_(pa.int64()), pa.list_(pa.int32())]
            made = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *made], names=["doc_id", "host", "text_key", *names])

    chosen = docs.select(F.col(doc_id).alias("doc_id"), F.col(host).cast("string").alias("host"), _text_key(text).alias("text_key"), F.col(text).alias("text"))
    return chosen.mapInArrow(run, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, host string, text_key long, {_MEASURES}")


def _same(*names):
    """Null-safe equality of columns and their renamed twins."""
    out = F.lit(True)
    for name in names:
        out = out & F.col(name).eqNullSafe(F.col("r_" + name))
    return out


def removed_lines(measured: DataFrame, line_limit: int, line_share: float) -> DataFrame:
    """(r_host, r_text_key, keys, n_removed) of the classes that have lines above their host's limit."""
    copies = measured.select("host", "text_key", "doc_id").distinct().groupBy("host", "text_key").agg(F.count("*").alias("n_docs"))
    texts = measured.groupBy("host", "text_key").agg(F.first(F.struct("line_keys", "line_words")).alias("lines"))
    texts = texts.join(copies.select(F.col("host").alias("r_host"), F.col("text_key").alias("r_text_key"), "n_docs"), _same("host", "text_key"))
    lines = texts.select("host", "text_key", "n_docs", F.explode(F.arrays_zip("lines.line_keys", "lines.line_words")).alias("line"))
    lines = lines.groupBy("host", "text_key", F.col("line.line_keys").alias("key")).agg(F.sum("line.line_words").alias("words"), F.first("n_docs").alias("n_docs"))
    limits = copies.groupBy(F.col("host").alias("r_host")).agg(F.greatest(F.lit(float(line_limit)), F.sum("n_docs") * line_share).alias("limit"))
    counted = lines.groupBy("host", "key").agg(F.sum("n_docs").alias("docs")).filter(F.col("docs") > line_limit)
    frequent = counted.join(limits, _same("host")).filter(F.col("docs") > F.col("limit"))
    frequent = frequent.select(F.col("host").alias("r_host"), F.col("key").alias("r_key"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("r_salt"))
    hit = lines.withColumn("salt", F.pmod("text_key", F.lit(SALTS).cast("long"))).join(frequent, _same("host", "key", "salt"))
    return hit.groupBy(F.col("host").alias("r_host"), F.col("text_key").alias("r_text_key")).agg(F.collect_list("key").alias("keys"), F.sum("words").alias("n_removed"))


def _judged(measured: DataFrame, line_limit: int, line_share: float, min_words: int, min_left: float) -> DataFrame:
    gone = removed_lines(measured, line_limit, line_share)
    joined = measured.drop("line_keys", "line_words").join(gone, _same("host", "text_key"), "left")
    joined = joined.withColumn("n_removed", F.coalesce("n_removed", F.lit(0).cast("long")))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    left = F.col("n_words") - F.col("n_removed")
    depleted = (F.col("n_removed") > 0) & ((left < min_words) | (left < min_left * F.col("n_words")))
    return joined.select("*", failed.alias("base_failed"), (~failed & ~depleted).alias("kept"))


def judge(docs: DataFrame, line_limit: int = 50, line_share: float = 0.02, min_words: int = 50, min_left: float = 0.3, **columns) -> DataFrame:
    """One row per document row: counts, base verdict, verdict, words in removed lines."""
    judged = _judged(cut(measures(docs, **columns)), line_limit, line_share, min_words, min_left)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed")


def clean(docs: DataFrame, line_limit: int = 50, line_share: float = 0.02, min_words: int = 50, min_left: float = 0.3, text: str = "text", host: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """The kept document rows, with all their columns, without their frequent lines.

    A verdict holds for a host and a text, so rows with a null doc_id are judged like others.
    """
    schema = docs.schema
    judged = _judged(cut(measures(docs, doc_id, text, host)), line_limit, line_share, min_words, min_left)
    v_host, v_key, v_keys, v_kept = free_names(docs.columns, "v_host", "v_key", "v_keys", "v_kept")
    verdicts = judged.groupBy(F.col("host").alias(v_host), F.col("text_key").alias(v_key)).agg(F.first("keys").alias(v_keys), F.first("kept").alias(v_kept))
    changed = verdicts.filter(~F.col(v_kept) | F.col(v_keys).isNotNull())
    joined = docs.join(changed, F.col(host).cast("string").eqNullSafe(F.col(v_host)) & (_text_key(text) == F.col(v_key)), "left")
    joined = joined.filter(F.coalesce(v_kept, F.lit(True))).drop(v_host, v_key, v_kept)

    def run(batches):
        for batch in batches:
            texts = []
            for data, keys in zip(batch.column(text).cast(pa.binary()).to_pylist(), batch.column(v_keys).to_pylist()):
                if keys and data is not None:
                    gone = set(keys)
                    data = b"\n".join(x for x in data.split(b"\n") if not x.strip() or line_key(x)[0] not in gone)
                texts.append(data)
            new = pa.array(texts, pa.binary()).cast(batch.schema.field(text).type)
            yield pa.RecordBatch.from_arrays([new if f.name == text else batch.column(f.name) for f in schema], names=schema.names)

    return joined.mapInArrow(run, schema)
