"""Language-model scoring with a probabilistic suffix tree over words.

Symbols are the words of the training documents, their end, and one symbol for
any unknown word.  The root holds the discounted relative frequencies; what
discounting frees goes to the unknown word.  A context, the last one to `depth`
words, is kept if the divergence of its next-symbol distribution from that of
its parent, times its count, passes a bound; of its symbols, those that add
enough to it are kept.  Each kept context's discounted frequencies are smoothed
with its parent's distribution, and every word of a text is scored from the
longest suffix of the words before it that the tree holds.

Every training word can be context and symbol, and a pair of context and symbol
is tested once it occurs `LEAST` times, whatever the corpus: the tree grows with
it.  So it is never in one place.  Words and runs of words are named by 64-bit
hashes, and the levels are tables by hash.  The tree grows by one level a pass:
pairs are counted over all training documents and summed by ranges of their hash.
Contexts and symbols with more than a 1,024th of all words are dealt to `SALTS`
places in the joins of a level.

The log probability of a word is a sum: that of the root, for each context in
the tree the log of what it leaves to its parent, and for the kept pair of each
level how much it lifts that.  A context is itself a kept pair of the level before,
so what the runs that start at one word are worth is the value of the longest of
them: each row of the tree holds the sum over its prefixes.  A task therefore asks
for each word of its texts, and for each place for the longest run that starts
there and may be in the tree, at the hash range of the run's first two words, where
all of that run's prefixes are too.  (Of runs with more than a 1,024th of all
words, at most 1,024 a level, every task knows the value; longer runs are kept
relative to them, at the range of their own hash.)  The answers come back by chunk
of texts, summed per text.  Two helpers of a fixed size change no result: a table of
frequent words and runs, which are weighed where they stand, and a filter of the
runs that the tree may hold, which has no false negatives and, overfull, costs time
only.

Defined cases: a null text counts as empty and holds just its end; without
training documents every score is 0 tokens' worth of the unknown word; null doc_ids
are training documents; repeated rows are each scored, alike; an empty table gives
no rows; other columns are not carried.
"""

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from . import textbytes as tb
from .exchange import by_bucket
from .tables import bucket_count, crc_mod, release, remove, share, written

U64 = np.uint64
_RUN = U64(0xA24BAED4963EE407)
#: The token after a document's last word, and before its first.
STOP = U64(0x5851F42D4C957F2D)
#: A pair is tested for divergence when it occurs this often.
LEAST = 3
_FLUSH = 1 << 20
#: Bytes of a batch of counts: a buffer is sent in such parts, so neither side of the pipe holds copies of all of it.
_SENT_BYTES = 1 << 22
_CHUNK_BYTES, _CHUNK_ROWS = 1 << 21, 1 << 15
#: Bits of the filter, and slots of the table of frequent runs, at most, as powers of two; small corpora take less.
_FILTER_BITS = 26
_CACHE_BITS = 18


def _join(context, symbol):
    """Hash of the run of words that a context's hash and the next word make."""
    return tb.mix(context * _RUN + symbol)


def tokens(bodies):
    """Of byte strings the words' hashes, each text's followed by STOP, and each token's place in its text and text."""
    text = b" ".join(b or b"" for b in bodies).lower()
    sizes = np.array([len(b or b"") + 1 for b in bodies])
    arr = tb.as_array(text)
    starts, ends = tb.word_spans(arr, tb.SPACE_WORD)
    of = np.searchsorted(np.cumsum(sizes), starts, "right")
    n = np.bincount(of, minlength=len(bodies)) + 1
    last = np.cumsum(n) - 1
    out = np.full(int(n.sum()), STOP)
    word = np.ones(len(out), bool)
    word[last] = False
    out[word] = tb.span_hashes(arr, starts, ends)
    return out, np.arange(len(out)) - np.repeat(last - n + 1, n), np.repeat(np.arange(len(bodies)), n)


def runs(symbols, place, depth):
    """For runs of 1 to depth + 1 words that end at each token: (hash, whether the text holds it)."""
    before = np.concatenate([[STOP], symbols[:-1]])
    before[place == 0] = STOP
    out = [(symbols, np.ones(len(symbols), bool))]
    for k in range(depth):
        out.append((_join(before, symbols), place >= k))
        before = np.concatenate([[STOP], out[-1][0][:-1]])
    return out


def _chunks(batches, column="body"):
    """(batch, first row, bodies) of a bounded number of bytes, or one row."""
    for batch in batches:
        held, size, lo = [], 0, 0
        for k, body in enumerate(batch.column(column).cast(pa.binary()).to_pylist()):
            held.append(body)
            size += len(body or b"")
            if size > _CHUNK_BYTES or len(held) == _CHUNK_ROWS:
                yield batch, lo, held
                held, size, lo = [], 0, k + 1
        if held:
            yield batch, lo, held


def _signed(hashes):
    return pa.array(np.ascontiguousarray(hashes).view(np.int64))


def _batch(names, kinds, rows):
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def _batches(names, kinds, rows):
    """Batches of about `_SENT_BYTES` of rows, which are made one after the other."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, bytes))
        if size >= _SENT_BYTES:
            yield _batch(names, kinds, held)
            held, size = [], 0
    if held:
        yield _batch(names, kinds, held)


def _counted(docs, columns_of, width, bits, least, joined=False):
    """Rows of `width` hashes that columns_of() yields, by the first: how often, if at least `least` times.

    With `joined` the first is the run of the second and the third, and is not sent.
    """
    names = [f"h{k}" for k in range(width)]
    sent = slice(1 if joined else 0, None)

    def run(batches):
        columns, held, size = columns_of(), [], 0
        for _, _, bodies in _chunks(batches):
            held.append(columns(bodies))
            size += held[-1].shape[1]
            if size > _FLUSH:
                yield from pack(held)
                held, size = [], 0
        if size:
            yield from pack(held)

    def pack(held):
        rows = np.concatenate(held, axis=1)
        held.clear()
        keys, first, counts = np.unique(rows[0], return_index=True, return_counts=True)
        rows, counts = rows[sent, first], counts.astype(np.uint32)
        yield from _batches(["bucket", "keys", "counts"], [pa.int32(), pa.binary(), pa.binary()], ((b, rows[:, i:j].tobytes(), counts[i:j].tobytes()) for b, i, j in by_bucket(keys, bits)))

    def total(table):
        rows = np.concatenate([np.frombuffer(k, U64).reshape(width - joined, -1) for k in table.column("keys").to_pylist()], axis=1)
        if joined:
            rows = np.concatenate([_join(rows[0], rows[1])[None], rows])
        _, first, of = np.unique(rows[0], return_index=True, return_inverse=True)
        n = np.bincount(of, np.frombuffer(b"".join(table.column("counts").to_pylist()), np.uint32)).astype(np.int64)
        kept = n >= least
        rows = rows[:, first[kept]]
        return pa.table({**{c: _signed(r) for c, r in zip(names, rows)}, "n": pa.array(n[kept])})

    packed = docs.select("body").mapInArrow(run, "bucket int, keys binary, counts binary")
    return packed.groupBy("bucket").applyInArrow(total, ", ".join(f"{c} long" for c in names) + ", n long")


def _bits(spark, n=0):
    """Of the number of hash ranges, which follows the cluster and the corpus."""
    return max(bucket_count(spark).bit_length() - 1, (int(n) >> 20).bit_length())


def word_counts(docs: DataFrame) -> DataFrame:
    """(g, n) over the hashes of all words of docs (body) and their ends."""
    counted = _counted(docs, lambda: lambda bodies: tokens(bodies)[0][None], 1, _bits(docs.sparkSession), 1)
    return counted.select(F.col("h0").alias("g"), "n")


def _slot(hashes, bits):
    return (hashes >> U64(64 - bits)).astype(np.int64)


def _filter_bits(seen):
    return (len(seen) * 8).bit_length() - 1


#: The filter is filled in so many slices, each by one task.
_SLICE_BITS = 5


def _probes(hashes, size):
    """Two places of each hash, within the slice of its first bits."""
    inner = size - _SLICE_BITS
    base = _slot(hashes, _SLICE_BITS) << inner
    yield base + ((hashes >> U64(64 - size)) & U64((1 << inner) - 1)).astype(np.int64)
    yield base + (hashes & U64((1 << inner) - 1)).astype(np.int64)


def _mark(seen, keys: DataFrame):
    """Adds the hashes of keys (g) to the bits of a filter."""
    size = _filter_bits(seen)
    width = 1 << (size - _SLICE_BITS)

    def slice_of(table):
        marks = np.zeros(width, np.uint8)
        for at in _probes(table.column("g").to_numpy().view(U64), size):
            marks[at % width] = 1
        part = int(at[0] // width)
        return pa.table({"part": pa.array([part]), "marks": pa.array([np.packbits(marks, bitorder="little").tobytes()], pa.binary())})

    parts = keys.select("g", F.shiftrightunsigned("g", 64 - _SLICE_BITS).alias("part")).groupBy("part").applyInArrow(slice_of, "part long, marks binary")
    for row in parts.collect():  # as many bytes as the filter has, and one job, not one a partition
        at = row.part * width // 8
        seen[at : at + width // 8] |= np.frombuffer(row.marks, np.uint8)


def _bit(seen, at):
    return (seen[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def _marked(seen, hashes):
    first, second = _probes(hashes, _filter_bits(seen))
    return _bit(seen, first) & _bit(seen, second)


def _pairs(bodies, level, seen=None, often=None):
    """Of the level's pairs that may be in the tree: hashes of the pair, its context, and the pair after one and (level 3 on) two words less."""
    symbols, place, _ = tokens(bodies)
    made = runs(symbols, place, level)
    context = np.concatenate([[STOP], made[level - 1][0][:-1]])
    if level == 1:
        context[place == 0] = STOP
    at = np.flatnonzero(made[level][1])
    if seen is not None:
        at = at[_marked(seen, context[at])]
        at = at[_marked(seen, symbols[at])]
    if often is not None:
        at = at[_bit(often, _slot(made[level][0][at], _filter_bits(often)))]
    lower = [made[level - 2][0][at]] if level > 2 else []
    return np.stack([made[level][0][at], context[at], made[level - 1][0][at], *lower])


def pair_counts(docs: DataFrame, level: int, seen, n: int) -> DataFrame:
    """(g, context, parent, lower, n) of a level's pairs that occur at least `LEAST` times."""
    # Most pairs are rare: a first pass over short hashes leaves them out.
    # It has applied the other filter; what either passes wrongly finds no context in the tree, or is too rare.
    shared = share(docs.sparkSession, frequent_pairs(docs, level, seen, n))

    def columns_of():
        often = shared()
        return lambda bodies: _pairs(bodies, level, often=often)

    counted = _counted(docs, columns_of, 4 if level > 2 else 3, _bits(docs.sparkSession, n), LEAST, joined=level == 1)
    return counted.select(F.col("h0").alias("g"), F.col("h1").alias("context"), F.col("h2").alias("parent"), F.col("h3" if level > 2 else "h2").alias("lower"), "n")


def frequent_pairs(docs: DataFrame, level: int, seen, n: int):
    """The bits of a filter of the level's pairs that occur at least `LEAST` times, from 32 bits of hash in a range.

    Pairs that share these are counted as one, so some pass that occur less often; none is lost.
    """
    spark = docs.sparkSession
    shared, size = share(spark, seen), _filter_bits(seen)
    bits = min(_bits(spark, n), size - 3)
    width = 1 << (size - bits)

    def run(batches):
        seen, held, size = shared(), [], 0
        for _, _, bodies in _chunks(batches):
            held.append(_pairs(bodies, level, seen)[0])
            size += len(held[-1])
            if size > _FLUSH:
                yield from pack(held)
                held, size = [], 0
        if size:
            yield from pack(held)

    def pack(held):
        keys = np.concatenate(held)
        held.clear()
        keys, counts = np.unique(keys, return_counts=True)
        keys = np.repeat(keys, np.minimum(counts, LEAST))
        rest = (keys >> U64(32 - bits)).astype(np.uint32)
        yield from _batches(["bucket", "rests"], [pa.int32(), pa.binary()], ((b, rest[i:j].tobytes()) for b, i, j in by_bucket(keys, bits)))

    def total(table):
        rests, counts = np.unique(np.frombuffer(b"".join(table.column("rests").to_pylist()), np.uint32), return_counts=True)
        marks = np.zeros(width, np.uint8)
        marks[rests[counts >= LEAST] >> np.uint32(32 - size + bits)] = 1
        return pa.table({"part": pa.array([table.column("bucket")[0].as_py()], pa.int64()), "marks": pa.array([np.packbits(marks, bitorder="little").tobytes()], pa.binary())})

    out = np.zeros(len(seen), np.uint8)
    packed = docs.select("body").mapInArrow(run, "bucket int, rests binary")
    for row in packed.groupBy("bucket").applyInArrow(total, "part long, marks binary").collect():  # no more bytes than the filter
        out[row.part * width // 8 : (row.part + 1) * width // 8] = np.frombuffer(row.marks, np.uint8)
    release(spark)
    return out


class Tree:
    """The weights of words and of runs of words (g, home, n, known, base, score), and what holds for all of them.

    home is the hash by which a row is dealt to ranges; hot holds the hashes and the
    values of the very frequent runs, by level.
    """

    def __init__(self, n, v, once, twice):
        self.n, self.v = n, v
        self.discount = once / (once + 2 * twice) if once and twice else 0.5
        self.unknown = self.discount * v / n if n else 1.0
        self.base = float(np.log10(0.5 / (n + 0.5 * (v + 1))))
        self.hot_n = max(1024, n >> 10)
        self.hot = []
        self.seen = np.zeros(1 << (min(_FILTER_BITS, max(16, int(n).bit_length() + 3)) - 3), np.uint8)

    def _often(self, table):
        """The hashes of the rows that occur more often than a 1,024th of all words."""
        return [r.g for r in table.filter(F.col("n") >= self.hot_n).select("g").collect()]

    def add_level(self, pairs, totals, symbol_gain=4.0, context_gain=12.0):
        """pairs (g, context, n, p) with lp, the log probability of the symbol, and what is kept of those that diverge enough from the parents.

        totals: (g, n, home, worth) of the contexts; worth is null where the runs after a context are relative to nothing before it.
        """
        hot = self._often(totals)
        found = self._gains(pairs, totals, hot, symbol_gain)
        sums = (F.sum("gain").alias("whole"), F.sum(F.when(F.col("gain").isNotNull(), F.col("own"))).alias("taken"))
        every = Window.partitionBy("context", "salt")
        found = found.withColumn("whole", F.sum("gain").over(every)).withColumn("taken", F.sum(F.when(F.col("gain").isNotNull(), F.col("own"))).over(every))
        if hot:  # these stand at several places, so their sums, 1,024 at most, are taken before
            some = self._gains(pairs.filter(F.col("context").isin(hot)), totals.filter(F.col("g").isin(hot)), hot, symbol_gain)
            spark, schema = pairs.sparkSession, "m_g long, m_whole double, m_taken double"
            known = F.broadcast(spark.createDataFrame(some.groupBy("context").agg(*sums).collect(), schema))
            found = found.join(known, F.col("context") == F.col("m_g"), "left")
            found = found.withColumn("whole", F.when(F.col("m_g").isNull(), F.col("whole")).otherwise(F.col("m_whole")))
            found = found.withColumn("taken", F.when(F.col("m_g").isNull(), F.col("taken")).otherwise(F.col("m_taken")))
        own = F.col("own")
        held = F.coalesce(F.col("whole") > context_gain, F.lit(False))
        found = found.withColumn("left", F.when(held, F.greatest(1 - F.col("taken"), F.lit(1e-9))).otherwise(1.0)).withColumn("kept", held & F.col("gain").isNotNull())
        smooth = F.log("left") + F.col("p")
        lp = F.when(F.col("kept"), F.log(own + F.col("left") * F.exp("p"))).otherwise(smooth)
        if_kept = lambda c: F.when(F.col("kept"), c)
        left = F.log("left") / _TEN
        alone = F.col("worth").isNull()
        worth = F.when(alone, 0.0).otherwise(F.col("worth") + left) + (lp - smooth) / _TEN
        home = F.when(alone, F.col("g")).otherwise(F.col("c_home"))
        return found.select("g", if_kept(F.col("context")).alias("context"), "n", "kept", lp.alias("lp"), if_kept(left).alias("left"), if_kept(home).alias("home"), if_kept(worth).alias("worth"))


    def with_parents(self, pairs, parents, lowest):
        """pairs (g, context, n) with p, the log probability that the parent gives the symbol."""
        found = _meet(pairs, "parent", parents.select("g", F.col("lp").alias("p1")), self._often(parents))
        if lowest is not None:  # a parent whose context is not in the tree has the probability of its own parent
            found = _meet(found, "lower", lowest.select("g", F.col("lp").alias("p2")), self._often(lowest))
        return found.select("g", "context", "n", (F.coalesce("p1", "p2") if lowest is not None else F.col("p1")).alias("p"))

    def _gains(self, pairs, totals, hot, symbol_gain):
        """pairs with own, the discounted frequency in the context, and gain, what the divergence from the parent is worth, if it is enough."""
        found = pairs.withColumn("salt", _salt("context", hot))
        found = found.join(_salted(totals.select("g", F.col("n").alias("total"), F.col("home").alias("c_home"), "worth"), hot), _same("context")).drop("m_g", "m_salt")
        gain = F.col("n") * (F.log(F.col("n") / F.col("total")) - F.col("p"))
        own = (F.col("n") - self.discount) / F.col("total")
        return found.withColumn("gain", F.when(gain > symbol_gain, gain)).withColumn("own", own).drop("total")


_TEN = float(np.log(10))
#: Places to which a very frequent key of a join is dealt.
SALTS = 32


def _salt(name, hot):
    zero = F.lit(0).cast("long")
    return F.when(F.col(name).isin(hot), F.pmod("g", F.lit(SALTS).cast("long"))).otherwise(zero) if hot else zero


def _salted(other, hot):
    """other (g, ...) as (m_g, m_salt, ...): the keys in `hot` at each of SALTS places."""
    zero = F.lit(0).cast("long")
    salts = F.when(F.col("m_g").isin(hot), F.sequence(zero, zero + SALTS - 1)).otherwise(F.array(zero)) if hot else F.array(zero)
    return other.withColumnRenamed("g", "m_g").withColumn("m_salt", F.explode(salts))


def _same(name):
    return (F.col(name) == F.col("m_g")) & (F.col("salt") == F.col("m_salt"))


def _meet(df, name, other, hot):
    """`df` with the columns of `other` (g, ...) where g is its column `name`, null where none is."""
    return df.withColumn("salt", _salt(name, hot)).join(_salted(other, hot), _same(name), "left").drop("m_g", "m_salt", "salt")


def train(docs: DataFrame, depth: int = 3) -> Tree:
    """The tree of docs (body)."""
    spark = docs.sparkSession
    counts, folder = written(word_counts(docs))
    folders = [folder]
    tree = Tree(*counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), *(F.count(F.when(F.col("n") == k, 1)) for k in (1, 2))).first())
    root = F.greatest(F.col("n") - tree.discount, F.lit(1e-3)) / max(1, tree.n)
    parents = counts.select("g", "n", F.log(root).alias("lp"))
    base = F.log10((F.col("n") + 0.5) / (tree.n + 0.5 * (tree.v + 1))) - tree.base
    nothing, none = F.lit(0.0), F.lit(0).cast("long")
    whole = (F.log10(root) - float(np.log10(tree.unknown))).alias("score")
    parts = [counts.select("g", F.col("g").alias("home"), "n", F.lit(1).cast("long").alias("known"), base.alias("base"), whole)]
    totals, levels = counts.filter(F.col("n") >= LEAST).select("g", "n", F.col("g").alias("home"), F.lit(None).cast("double").alias("worth")), []
    _mark(tree.seen, totals)
    for level in range(1, depth + 1):
        pairs = pair_counts(docs, level, tree.seen, tree.n)
        pairs, counted = written(tree.with_parents(pairs, parents, levels[-2] if level > 2 else None))
        made, folder = written(tree.add_level(pairs, totals))
        remove(spark, counted)
        levels.append(made)
        folders.append(folder)
        kept = made.filter("kept")
        parts.append(kept.select("g", "home", "n", none.alias("known"), nothing.alias("base"), F.col("worth").alias("score")))
        # What a context leaves to its parent counts wherever it stands, so it is added to its own row.
        contexts = kept.groupBy("context").agg(F.first("left").alias("left"))
        parts.append(contexts.select(F.col("context").alias("g"), F.lit(None).cast("long").alias("home"), none.alias("n"), none.alias("known"), nothing.alias("base"), F.col("left").alias("score")))
        if kept.isEmpty():
            break
        _mark(tree.seen, kept)
        # The runs after a very frequent one are relative to it, and dealt by their own hash.
        worth = F.when(F.col("n") < tree.hot_n, F.col("worth"))
        totals, parents = kept.select("g", "n", "home", worth.alias("worth")), made
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    tree.weights, _ = written(every.groupBy("g").agg(F.max("home").alias("home"), F.max("n").alias("n"), F.max("known").alias("known"), F.sum("base").alias("base"), F.sum("score").alias("score")))
    for folder in folders:
        remove(spark, folder)
    hot = tree.weights.filter((F.col("known") == 0) & (F.col("n") >= tree.hot_n)).select("g", "score").collect()  # at most 1,024 a level
    order = np.argsort(np.array([r.g for r in hot], np.int64).view(U64))
    tree.hot = (np.array([r.g for r in hot], np.int64).view(U64)[order], np.array([r.score for r in hot], np.float64)[order])
    return tree


class _Cache:
    """Weights of frequent words and runs, at most one a slot; what it lacks is asked for."""

    def __init__(self, table, bits):
        g = table.column("g").to_numpy().view(U64)
        order = np.argsort(table.column("n").to_numpy(), kind="stable")  # the last write of a slot is the most frequent
        at = _slot(g[order], bits)
        self.bits, self.full = bits, np.zeros(1 << bits, bool)
        self.full[at] = True
        self.keys = np.zeros(1 << bits, U64)
        self.keys[at] = g[order]
        self.base, self.score = np.zeros(1 << bits), np.zeros(1 << bits)
        self.base[at], self.score[at] = (table.column(c).to_numpy()[order] for c in ("base", "score"))

    def find(self, hashes):
        at = _slot(hashes, self.bits)
        return np.where((self.keys[at] == hashes) & self.full[at], at, -1)


def _frequent(weights, size):
    """The most frequent rows, at most `size`, by classes of counts."""
    size_class = F.floor(F.log2("n") * 4)
    classes = {r.k: r.w for r in weights.filter("n > 0").groupBy(size_class.alias("k")).agg(F.count("*").alias("w")).collect()}
    least, held = None, 0
    for k in sorted(classes, reverse=True):
        if held + classes[k] > size:
            break
        least, held = k, held + classes[k]
    return weights.filter(size_class >= least if least is not None else F.lit(False)).select("g", "n", "base", "score").toArrow()


def _sums(of, values, n):
    return np.bincount(of, values, n).astype(np.float64)


def _lookup(held, wanted):
    """Places of `wanted` in the sorted `held`, -1 where absent."""
    if not len(held):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(held, wanted), len(held) - 1)
    return np.where(held[at] == wanted, at, -1)


def starting_runs(bodies, depth):
    """Of texts with STOP put before them: tokens, text of each, whether it is a token to score, and hashes of the runs of 2 to depth + 1 that start there (0 where the text ends before)."""
    symbols, place, text = tokens(bodies)
    first = np.flatnonzero(place == 0)
    symbols = np.insert(symbols, first, STOP)
    token = np.insert(np.ones(len(text), bool), first, False)
    text = np.insert(text, first, text[first])
    out, run, fits = [], symbols, np.ones(len(symbols), bool)
    for k in range(1, depth + 1):
        later = np.concatenate([symbols[k:], np.zeros(min(k, len(symbols)), U64)])
        same = np.concatenate([text[k:], np.full(min(k, len(text)), -1)]) == text
        fits &= same
        run = _join(run, later)
        out.append((run, fits.copy()))
    return symbols, text, token, out


class _Asker:
    """Weighs the words and runs of a chunk of texts as far as a task can, and lists what is to be asked for."""

    def __init__(self, tree_seen, hot, cache, depth):
        self.seen, self.hot, self.cache, self.depth = tree_seen, hot, cache, depth

    def __call__(self, bodies):
        """Per text: tokens, known words, base and score so far; and (keys, texts) of words and of chains of one to `depth` runs."""
        rows = len(bodies)
        symbols, text, token, made = starting_runs(bodies, self.depth)
        n = np.bincount(text[token], minlength=rows)
        words, of = symbols[token], text[token]
        slot = self.cache.find(words)
        hit = slot >= 0
        known = np.bincount(of[hit], minlength=rows)
        base = _sums(of[hit], self.cache.base[slot[hit]], rows)
        score = _sums(of[hit], self.cache.score[slot[hit]], rows)
        asked = [(words[~hit][None], of[~hit])]
        # The longest run that the filter lets pass, and how many of its first runs are very frequent.
        at = np.arange(len(symbols))
        length, skipped = np.zeros(len(symbols), np.int8), np.zeros(len(symbols), np.int8)
        for k, (run, fits) in enumerate(made):
            at = at[fits[at]]
            at = at[_marked(self.seen, run[at])]
            length[at] = k + 1
            place = _lookup(self.hot[0], run[at])
            some = place >= 0
            score += _sums(text[at[some]], self.hot[1][place[some]], rows)
            skipped[at[some]] = k + 1
        for size in range(1, self.depth + 1):
            for skip in range(size):
                at = np.flatnonzero((length == size) & (skipped == skip))
                if not len(at):
                    continue
                slot = self.cache.find(made[size - 1][0][at])
                hit = slot >= 0
                score += _sums(text[at[hit]], self.cache.score[slot[hit]], rows)
                at = at[~hit]
                asked.append((np.stack([made[j][0][at] for j in range(skip, size)]), text[at]))
        return n, known, base, score, asked


def score(docs: DataFrame, tree: Tree, depth: int = 3, cache_rows: int = 1 << _CACHE_BITS, passes: int = 4) -> DataFrame:
    """docs (doc, body) to (doc, n_tokens, n_known, base_score, score), a row each.

    Every row is scored, in `passes` parts by hash of doc, each written before the next
    one begins, so what is asked for at once takes a part of the disk only.
    """
    cache = _Cache(_frequent(tree.weights, cache_rows), min(_CACHE_BITS, max(10, int(tree.n).bit_length())))
    shared = share(docs.sparkSession, _Asker(tree.seen, tree.hot, cache, depth))
    out = None
    for k in range(passes):
        mine = docs.filter(F.pmod(F.xxhash64("doc"), F.lit(passes).cast("long")) == k)
        part, _ = written(_scored(mine, tree, shared))
        out = part if out is None else out.unionByName(part)
    return out


def _scored(docs, tree, shared):
    """docs (doc, body) to the rows of `score`, at once."""
    spark = docs.sparkSession
    bits = max(1, (int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length(), (int(tree.n) >> 22).bit_length())
    unknown, default = float(np.log10(tree.unknown)), tree.base
    kind = docs.schema["doc"].dataType.simpleString()
    # A chunk of texts: its own row with docs, and rows that ask (of: text numbers; keys: `width` hashes each).
    schema = f"bucket int, chunk long, width int, of binary, keys binary, known binary, base binary, score binary, docs array<{kind}>"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        asker = shared()
        chunk = TaskContext.get().partitionId() << 32
        for batch, lo, bodies in _chunks(batches):
            rows = len(bodies)
            n, known, base, total, asked = asker(bodies)
            own = [n.astype(np.int64), known.astype(np.int64), base + n * default, total + n * unknown]
            ids = batch.column("doc").slice(lo, rows)
            ids = pa.ListArray.from_arrays(pa.array([0, rows], pa.int32()), ids)
            made = [pa.array([chunk & ((1 << bits) - 1)], pa.int32()), pa.array([chunk], pa.int64()), pa.nulls(1, pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in own[:1]), pa.nulls(1, pa.binary()), *(pa.array([x.tobytes()], pa.binary()) for x in own[1:]), ids]
            yield pa.RecordBatch.from_arrays(made, names=names)
            sent = []
            for keys, of in asked:
                order = np.argsort(keys[0])
                keys, of = keys[:, order], of[order].astype(np.uint16)
                sent.extend((b, chunk, len(keys), of[i:j].tobytes(), keys[:, i:j].tobytes()) for b, i, j in by_bucket(keys[0], bits))
            if sent:
                columns = [pa.array([r[i] for r in sent], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()))]
                empty = pa.nulls(len(sent), pa.binary())
                yield pa.RecordBatch.from_arrays([*columns, empty, empty, empty, pa.nulls(len(sent), ids.type)], names=names)
            chunk += 1

    answer = f"chunk long, of binary, known binary, base binary, score binary, docs array<{kind}>"
    answers = [c.split()[0] for c in answer.split(", ")]

    def meet(asked, weights):
        """The chunks' own rows as they are, and per chunk sums of what its texts asked for here."""
        alone = asked.filter(asked.column("keys").is_null()).select(answers)
        asked = asked.filter(asked.column("keys").is_valid())
        if not asked.num_rows or not weights.num_rows:
            return alone
        held = weights.column("g").to_numpy().view(U64)
        order = np.argsort(held)
        held = held[order]
        weight = [weights.column(c).to_numpy()[order] for c in ("known", "base", "score")]
        sums = {}
        for chunk, width, of, keys in zip(*(asked.column(c).to_pylist() for c in ("chunk", "width", "of", "keys"))):
            of, keys = np.frombuffer(of, np.uint16), np.frombuffer(keys, U64).reshape(width, -1)
            at = np.full(len(of), -1)
            for chain in keys[::-1]:  # the longest run first
                open_ = np.flatnonzero(at < 0)
                at[open_] = _lookup(held, chain[open_])
            hit = at >= 0
            sums.setdefault(chunk, []).append((of[hit], at[hit]))
        rows = []
        for chunk, found in sums.items():
            of, at = (np.concatenate(x) for x in zip(*found))
            texts, of = np.unique(of, return_inverse=True)
            if len(texts):
                known, base, total = (_sums(of, w[at], len(texts)) for w in weight)
                # Only words have a base; an empty column says that all are 0.
                some = known.any()
                rows.append((chunk, texts.tobytes(), known.astype(np.uint32).tobytes() if some else b"", base.tobytes() if some else b"", total.tobytes()))
        columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), *[pa.binary()] * 4))]
        made = pa.table([*columns, pa.nulls(len(rows), alone.schema.field("docs").type)], names=answers)
        return pa.concat_tables([alone, made])

    result = f"doc {kind}, n_tokens long, n_known long, base_score double, score double"

    def total(table):
        mine = table.filter(table.column("docs").is_valid())
        n, known, base, out = (np.frombuffer(mine.column(c)[0].as_py(), t).copy() for c, t in (("of", np.int64), ("known", np.int64), ("base", float), ("score", float)))
        rest = table.filter(table.column("docs").is_null())
        for of, more_known, more_base, more in zip(*(rest.column(c).to_pylist() for c in ("of", "known", "base", "score"))):
            at = np.frombuffer(of, np.uint16)
            out[at] += np.frombuffer(more)
            if more_known:
                known[at] += np.frombuffer(more_known, np.uint32)
                base[at] += np.frombuffer(more_base)
        ids = mine.column("docs").combine_chunks().flatten()
        return pa.table({"doc": ids, "n_tokens": n, "n_known": known, "base_score": base, "score": out})

    asked = docs.select("doc", "body").mapInArrow(run, schema)
    ranged = tree.weights.select(F.shiftrightunsigned("home", 64 - bits).cast("int").alias("bucket"), "g", "known", "base", "score")
    every = asked.groupBy("bucket").cogroup(ranged.groupBy("bucket")).applyInArrow(meet, answer)
    return every.groupBy("chunk").applyInArrow(total, result)


def report(docs: DataFrame, depth: int = 3, **options) -> DataFrame:
    """Scores of every document; those whose crc32(doc_id) mod 5 is not 1 are the training set."""
    held_out = F.coalesce(crc_mod("doc", 5) == 1, F.lit(False))
    chosen = docs.select(F.col("doc_id").alias("doc"), F.col("text").alias("body"))
    training = chosen.filter(~held_out)
    tree = train(training, depth)
    scored = score(chosen, tree, depth, **options)
    return scored.select(
        F.col("doc").alias("doc_id"),
        held_out.alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(tree.n).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )
