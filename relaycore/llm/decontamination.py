"""Benchmark decontamination with a generalised suffix automaton of normalised test items.

The items' words are added to one automaton; every document's words stream
through it while the longest match length is tracked.  A window is `window`
consecutive words of an item (a shorter, non-empty item is one window); each
document word inside an occurrence of a window is hit.

The benchmark streams to the driver item by item and is cut into blocks of at
most `block_words` words, a longer item into pieces that overlap by a window less
one word.  Each block is one pass over the documents, and with several blocks a
pass is written out before the next, so one automaton is broadcast at a time and
its size grows with neither table.

Defined cases: a null or wordless text has no words and is never contaminated;
null and wordless items own no window; equal items are each reported, items of one
item_id together; repeated document rows are each judged on their own; an empty
benchmark hits nothing, an empty table gives no rows.  All columns of the documents
are kept, whatever their names.
"""

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textbytes as tb
from .tables import cut, free_names, share


class SuffixAutomaton:
    """Suffix automaton over several word sequences, with the items of each state."""

    def __init__(self, window):
        self.window = window
        self.vocabulary = {}
        self.next, self.link, self.length = [{}], [-1], [0]
        self.items, self.short = [set()], [()]
        self.shortest = window

    def _state(self, length, moves, link, items=()):
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.items.append(set(items))
        self.short.append(())
        return len(self.next) - 1

    def _split(self, parent, symbol, child):
        """The copy of `child` that holds just the strings up to `parent`'s length and one."""
        copy = self._state(self.length[parent] + 1, dict(self.next[child]), self.link[child])
        self.link[child] = copy
        while parent >= 0 and self.next[parent].get(symbol) == child:
            self.next[parent][symbol] = copy
            parent = self.link[parent]
        return copy

    def _extend(self, last, symbol):
        known = self.next[last].get(symbol)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._split(last, symbol, known)
        new = self._state(self.length[last] + 1, {}, 0)
        at = last
        while at >= 0 and symbol not in self.next[at]:
            self.next[at][symbol] = new
            at = self.link[at]
        if at >= 0:
            child = self.next[at][symbol]
            self.link[new] = child if self.length[child] == self.length[at] + 1 else self._split(at, symbol, child)
        return new

    def add(self, item, words):
        state = 0
        for word in words:
            symbol = self.vocabulary.setdefault(word, len(self.vocabulary))
            state = self._extend(state, symbol)
            self.items[state].add(item)
        self.shortest = min(self.shortest, len(words))

    def finish(self, short_items):
        """Spread items to shorter suffixes; point states at the state of their window and at whole short items."""
        order = sorted(range(1, len(self.length)), key=self.length.__getitem__)
        for state in reversed(order):
            if self.link[state] > 0:
                self.items[self.link[state]] |= self.items[state]
        for item, words in short_items:
            state = 0
            for word in words:
                state = self.next[state][self.vocabulary[word]]
            self.short[state] += ((len(words), item),)
        self.owner, self.with_short = [0] * len(self.length), [0] * len(self.length)
        for state in order:
            up = self.link[state]
            if self.length[state] >= self.window:
                self.owner[state] = self.owner[up] if self.length[up] >= self.window else state
            self.with_short[state] = state if self.short[state] else self.with_short[up]
        return self

    def stream(self, ids, hit, found):
        """Run word ids (-1: in no item) through the automaton; marks `hit`, adds to `found`."""
        known = np.zeros(len(ids) + 2, np.int8)
        known[1:-1] = ids >= 0
        edge = np.diff(known)
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        long = ends - starts >= self.shortest
        for start, end in zip(starts[long].tolist(), ends[long].tolist()):
            state = matched = 0
            for at, symbol in enumerate(ids[start:end].tolist(), start):
                while state and symbol not in self.next[state]:
                    state = self.link[state]
                    matched = self.length[state]
                if symbol in self.next[state]:
                    state = self.next[state][symbol]
                    matched += 1
                if matched >= self.window:
                    hit[at - self.window + 1 : at + 1] = True
                    found |= self.items[self.owner[state]]
                at_short = self.with_short[state]
                while at_short:
                    for size, item in self.short[at_short]:
                        if size <= matched:
                            hit[at - size + 1 : at + 1] = True
                            found.add(item)
                    at_short = self.with_short[self.link[at_short]]


def words_of(text):
    """Lower-cased words of UTF-8 bytes (None: none)."""
    return [] if text is None else text.translate(tb.ALNUM_TABLE).split()


def automata(items: DataFrame, window: int, block_words: int):
    """Automata over blocks of the items (columns item, words as bytes)."""
    most = max(block_words, window)
    block, size = [], 0
    for item, text in items.toLocalIterator():
        words = words_of(text)
        for start in range(0, max(1, len(words) - window + 1), most - window + 1) if words else ():
            piece = words[start : start + most]
            if block and size + len(piece) > most:
                yield _automaton(block, window)
                block, size = [], 0
            block.append((item, piece))
            size += len(piece)
    if block:
        yield _automaton(block, window)


def _automaton(block, window):
    built = SuffixAutomaton(window)
    for item, words in block:
        built.add(item, words)
    return built.finish([(item, words) for item, words in block if len(words) < window])


def match(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, block_words: int = 100_000, carry_text: bool = True) -> tuple[DataFrame, list[str]]:
    """`docs` (without its text unless `carry_text`) with three more columns, and their names.

    They are, under names that clash with no other: n_words long, hits array<int> (hit
    word positions as [start, end) pairs) and items array<string>.
    """
    names = free_names(docs.columns, "n_words", "hits", "items")
    out = docs.select("*", *(F.lit(0).cast("long") if k == 0 else F.array().cast(kind) for k, kind in enumerate(("long", "array<int>", "array<string>")))).toDF(*docs.columns, *names)
    chosen = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.col(item_text).cast("binary").alias("words"))
    blocks = automata(chosen, window, block_words)
    automaton = next(blocks, None) or SuffixAutomaton(window).finish([])
    for following in blocks:
        out, automaton = cut(_one_pass(out, text, automaton, out.schema, names)), following
    return _one_pass(out, text, automaton, out.schema if carry_text else out.drop(text).schema, names), names


def _one_pass(df, text, automaton, schema, names):
    shared = share(df.sparkSession, automaton)
    columns = schema.names
    n_words, n_hits, n_items = names

    def run(batches):
        a = shared()
        get = a.vocabulary.get
        for batch in batches:
            counts, hits, items = [], [], []
            before = zip(batch.column(n_hits).to_pylist(), batch.column(n_items).to_pylist())
            for data, (old, known) in zip(batch.column(text).cast(pa.binary()).to_pylist(), before):
                words = words_of(data)
                ids = np.fromiter(map(get, words, repeat(-1)), np.int32, len(words))
                hit, found = np.zeros(len(words) + 2, bool), set(known or ())
                a.stream(ids, hit[1:-1], found)
                for lo, hi in zip(old[::2], old[1::2]):
                    hit[lo + 1 : hi + 1] = True
                counts.append(len(words))
                hits.append(np.flatnonzero(hit[1:] != hit[:-1]).astype(np.int32))
                items.append(sorted(found))
            new = {n_words: pa.array(counts, pa.int64()), n_hits: pa.array(hits, pa.list_(pa.int32())), n_items: pa.array(items, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays([new[n] if n in new else batch.column(n) for n in columns], names=columns)

    return df.mapInArrow(run, schema)


def report(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per document row: the counts, a digest of the items found, and the verdict."""
    found, (n_words, hits, items) = match(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), benchmark, carry_text=False, **options)
    n_hit = F.aggregate(F.transform(hits, lambda at, k: F.when(k % 2 == 1, at).otherwise(-at)), F.lit(0).cast("long"), lambda n, at: n + at)
    return found.select(
        "doc_id",
        F.col(n_words).alias("n_words"),
        n_hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"),
        (F.size(hits) > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", max_coverage: float = 0.8, **options) -> DataFrame:
    """`docs` without the hit spans; documents with more than `max_coverage` of their words hit go altogether.

    A removed span reaches from its first word's first byte to its last word's last byte.
    """
    schema = docs.schema
    found, (n_words, hits, _) = match(docs, benchmark, text=text, **options)

    def run(batches):
        for batch in batches:
            keep, texts = [], []
            sizes = batch.column(n_words).to_pylist()
            for row, (data, hit) in enumerate(zip(batch.column(text).cast(pa.binary()).to_pylist(), batch.column(hits).to_pylist())):
                if hit:
                    covered = sum(hit[1::2]) - sum(hit[::2])
                    if covered > max_coverage * sizes[row]:
                        continue
                    starts, ends = tb.word_spans(tb.as_array(data.translate(tb.ALNUM_TABLE)), tb.ALNUM_WORD)
                    cuts = [(starts[lo], ends[hi - 1]) for lo, hi in zip(hit[::2], hit[1::2])]
                    data = b"".join(data[lo:hi] for lo, hi in zip([0, *(c[1] for c in cuts)], [*(c[0] for c in cuts), len(data)]))
                keep.append(row)
                texts.append(data)
            rows = batch.take(pa.array(keep, pa.int64()))
            new = pa.array(texts, pa.binary()).cast(batch.schema.field(text).type)
            yield pa.RecordBatch.from_arrays([new if f.name == text else rows.column(f.name) for f in schema], names=schema.names)

    return found.mapInArrow(run, schema)
