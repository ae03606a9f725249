"""Whole-message processing: parse, segment, dedup, compress, verify, rebuild; with its statistics.

`Processor` handles one message and travels to executors by value.  Three DataFrame
operators drive it over messages (conv_id, turn, raw: the JSON of a message):

* `process`: every message by itself, one narrow pass;
* `process_new`: the last messages of a conversation against the untouched history
  before them; the history's blocks meet by hash in a join, so no conversation is
  gathered;
* `process_all`: all messages in order against what was already sent on (or a store
  of blocks); rows stream sorted through a task that holds block hashes alone.

A message that cannot be handled is kept as it is, with the reason.  Null raw counts
as JSON null.  Defined for repeated turns (each a message, in order of raw).
"""

import hashlib
import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.tokens import KEEP_RATIO, estimate_cost
from . import compress, segmenting
from .messages import LEAST_CHARS, PAYLOAD_ROLES, segments, is_structured

STRATEGIES = ("off", "conservative", "telegraphic", "balanced", "aggressive")
LEAST_BLOCK_TOKENS = 25
AGGRESSIVE_KEEP = 0.5


class ParseError(ValueError):
    pass


class Processor:
    """One session's settings: strategy, framework, dedup in ("context", "store", None), an own `compressor(text, keep)`."""

    def __init__(self, model="unknown", strategy="telegraphic", framework="openai-chat", dedup="context", keep_ratio=None, compressor: Callable | None = None, count: Callable = compress.count_tokens, tier="estimate", roles=None, least_chars=LEAST_CHARS):
        if compressor is None and strategy not in STRATEGIES:
            raise ValueError(f"strategy must be one of {STRATEGIES}, not {strategy!r}")
        if framework not in PAYLOAD_ROLES and roles is None:
            raise ParseError(f"no parser for framework {framework!r} (known: {', '.join(sorted(PAYLOAD_ROLES))})")
        if dedup not in ("context", "store", None):
            raise ValueError("dedup must be context, store or None")
        self.model, self.framework, self.dedup, self.count, self.tier = model, framework, dedup, count, tier
        self.roles, self.least_chars = frozenset(roles or PAYLOAD_ROLES[framework]), least_chars
        self.strategy = getattr(compressor, "__name__", "custom") if compressor else strategy
        keep = {"balanced": KEEP_RATIO, "aggressive": AGGRESSIVE_KEEP}.get(strategy)
        self.keep = keep_ratio if compressor or (keep and keep_ratio is not None) else keep
        kernels = {"off": lambda t, k: t, "conservative": compress.conservative, "telegraphic": compress.telegraphic}
        self.compressor = compressor or kernels.get(strategy, compress.budgeted)

    def payload(self, message) -> str | None:
        """The text that may change, null where there is none."""
        if not isinstance(message, dict):
            raise ParseError(f"expected a dict message, got {type(message).__name__}")
        chain = self.framework == "langchain"
        role = (message.get("type") or message.get("role")) if chain else message.get("role")
        if not isinstance(role, str):
            raise ParseError("message has no string 'type'/'role' field" if chain else "message has no string 'role' field")
        text = message.get("content")
        fixed = chain and bool(message.get("tool_calls"))
        if fixed or not isinstance(text, str) or len(text) < self.least_chars or role not in self.roles or is_structured(text):
            return None
        return text or None

    def cost(self, message) -> int:
        return self.count(json.dumps(message, ensure_ascii=False, default=str))

    def process(self, message, places=None):
        """(message to send, statistics); `places` maps a block's hash to its (message, paragraph), or for a store to anything."""
        before = self.cost(message)
        stats = {"model": self.model, "strategy": self.strategy, "tokens_before": before, "tokens_after": before, "tier": self.tier, "safe": True, "fell_back": False, "fallback_reason": None, "dedup_hits": 0}
        try:
            sent, after, hits = self._changed(message, before, places)
            return sent, {**stats, "tokens_after": after, "dedup_hits": hits}
        except _Unsafe as reason:
            return message, {**stats, "fell_back": True, "fallback_reason": str(reason)}
        except ParseError as error:
            return message, {**stats, "fell_back": True, "fallback_reason": f"ParseError: {error}"}
        except Exception as error:  # noqa: BLE001: a failing kernel of a caller must not lose the message
            return message, {**stats, "fell_back": True, "fallback_reason": f"unexpected {type(error).__name__}: {error}"}

    def _changed(self, message, before, places):
        if self.strategy == "off":
            return message, before, 0
        text = self.payload(message)
        if text is None:
            return message, before, 0
        hits, out = 0, []
        spans = segmenting.split(text)
        for kind, span in spans:
            if kind == segmenting.TEXT and span.strip():
                reference = self._reference(span, places)
                hits += reference is not None
                span = self.compressor(span, self.keep) if reference is None else reference
            out.append(span)
        changed = "".join(out)
        if segmenting.protected(changed) != [s for kind, s in spans if kind == segmenting.PROTECTED]:
            raise _Unsafe("protected payload span mismatch")
        sent = {key: changed if key == "content" else value for key, value in message.items()}
        self.payload(sent)
        if fingerprint(sent) != fingerprint(message):
            raise _Unsafe("structural round-trip mismatch")
        after = self.cost(sent)
        if after > before:
            raise _Unsafe("processing increased token count")
        return sent, after, hits

    def _reference(self, block, places):
        if self.dedup is None or places is None:
            return None
        cost, sha = self.count(block), digest(block)
        at = places.get(sha)
        if self.dedup == "store" and cost >= LEAST_BLOCK_TOKENS:
            places[sha] = True
        if cost < LEAST_BLOCK_TOKENS or not at:
            return None
        name = f"lc:{sha[:10]}"
        if self.dedup == "store":
            text = f"[ref {name}: call rehydrate('{name}') for the full content]"
        else:
            text = f"[ref {name}: see earlier message {at[0]}, paragraph {at[1]}]"
        return text if self.count(text) < cost else None


class _Unsafe(Exception):
    pass


def fingerprint(message: dict) -> str:
    """A hash of all of a message but its content, and of the kind of that."""
    rest = {k: v for k, v in message.items() if k != "content"} | {"content": type(message.get("content")).__name__}
    return digest(json.dumps(rest, ensure_ascii=False, default=str))


def digest(block: str) -> str:
    return hashlib.sha256(block.encode("utf-8", "surrogatepass")).hexdigest()


def content(message) -> str:
    text = message.get("content") if isinstance(message, dict) else None
    return text if isinstance(text, str) else ""


_STATS = [("model", pa.string()), ("strategy", pa.string()), ("tokens_before", pa.int64()), ("tokens_after", pa.int64()), ("tier", pa.string()), ("safe", pa.bool_()), ("fell_back", pa.bool_()), ("fallback_reason", pa.string()), ("dedup_hits", pa.int64())]
STATS_SCHEMA = "model string, strategy string, tokens_before long, tokens_after long, tier string, safe boolean, fell_back boolean, fallback_reason string, dedup_hits long"


def _schema(messages, columns):
    return ", ".join(f"`{c}` {messages.schema[c].dataType.simpleString()}" for c in columns) + ", raw string, sent string, " + STATS_SCHEMA


def load(raw):
    try:
        return json.loads(raw if raw is not None else "null")
    except ValueError:
        return raw


def _drive(processor, columns, places_of):
    """A mapInArrow function; `places_of(batch, row, message)` gives a message's places, and is told what was sent."""

    def run(batches: Iterator[pa.RecordBatch]):
        track = places_of()
        for batch in batches:
            sent, stats = [], []
            for k, raw in enumerate(batch.column("raw").to_pylist()):
                message = load(raw)
                out, found = processor.process(message, track.places(batch, k))
                track.sent(out)
                sent.append(raw if out is message else json.dumps(out, ensure_ascii=False))
                stats.append(found)
            made = [pa.array([s[name] for s in stats], kind) for name, kind in _STATS]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), batch.column("raw"), pa.array(sent, pa.string()), *made], names=[*columns, "raw", "sent", *(n for n, _ in _STATS)])

    return run


class _Nothing:
    def places(self, batch, k):
        return None

    def sent(self, message):
        pass


class _Column(_Nothing):
    def places(self, batch, k):
        return {sha: (message, paragraph) for sha, message, paragraph in ((p["sha"], p["message"], p["paragraph"]) for p in batch.column("places")[k].as_py() or ())}


class _Running(_Nothing):
    """Blocks of the conversation that streams by; sorted input brings one conversation after another."""

    def __init__(self, store=False):
        self.store, self.conv, self.known, self.count = store, object(), {}, 0

    def places(self, batch, k):
        conv = batch.column("conv_id")[k].as_py()
        if conv != self.conv:
            self.conv, self.known, self.count = conv, {}, 0
        return self.known

    def sent(self, message):
        self.count += 1
        if not self.store:
            for k, block in enumerate(segmenting.BREAK.split(content(message)), 1):
                self.known[digest(block)] = (self.count, k)


def process(messages: DataFrame, processor: Processor, keys=("conv_id", "turn")) -> DataFrame:
    """Every message by itself: keys, raw, sent and the statistics."""
    rows = messages.select(*keys, "raw")
    return rows.mapInArrow(_drive(processor, keys, _Nothing), _schema(messages, keys))


def process_new(messages: DataFrame, processor: Processor, only_new: int = 1) -> DataFrame:
    """The last `only_new` messages of each conversation, with the blocks of the messages before them as evidence.

    Only the history before those messages counts here, as it is untouched; for more
    than one new message that refer to one another use `process_all`.
    """
    if only_new < 0:
        raise ValueError("only_new must not be negative")
    keys = ("conv_id", "turn")
    order = Window.partitionBy("conv_id").orderBy(F.desc("turn"), F.desc("raw"))
    body = F.try_variant_get(F.try_parse_json("raw"), "$.content", "variant")
    text = F.when(F.schema_of_variant(body) == "STRING", F.try_variant_get(body, "$", "string")).otherwise("")
    ranked = messages.select(*keys, "raw").withColumn("back", F.row_number().over(order))
    ranked = ranked.withColumn("message", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "raw")))
    new = ranked.filter(F.col("back") <= only_new)
    hashed = lambda c: F.sha2(c.cast("binary"), 256)
    old = ranked.filter(F.col("back") > only_new).select("conv_id", "message", F.posexplode(F.split(text, segmenting.BREAK.pattern)).alias("paragraph", "block"))
    old = old.groupBy("conv_id", hashed(F.col("block")).alias("sha")).agg(F.max(F.struct("message", (F.col("paragraph") + 1).alias("paragraph"))).alias("at"))
    wanted = new.select("conv_id", F.col("message").alias("row"), F.explode(F.array_distinct(F.transform(segments(text), lambda s: hashed(s["text"])))).alias("sha"))
    at = F.struct("sha", F.col("at.message").alias("message"), F.col("at.paragraph").alias("paragraph"))
    met = wanted.join(old, ["conv_id", "sha"]).groupBy(F.col("conv_id").alias("p_conv"), "row").agg(F.collect_list(at).alias("places"))
    rows = new.join(met, F.col("conv_id").eqNullSafe(F.col("p_conv")) & (F.col("message") == F.col("row")), "left").select(*keys, "raw", "places")
    return rows.mapInArrow(_drive(processor, keys, _Column), _schema(messages, keys))


def process_all(messages: DataFrame, processor: Processor) -> DataFrame:
    """All messages of each conversation in order, with what was sent before each as evidence."""
    keys = ("conv_id", "turn")
    store = processor.dedup == "store"
    rows = messages.select(*keys, "raw").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "raw")
    return rows.mapInArrow(_drive(processor, keys, lambda: _Running(store)), _schema(messages, keys))


def records(processed: DataFrame, source="source", target="target") -> DataFrame:
    """Hand-off records of processed messages: adds edge, ratio, tokens saved and cost where source and target exist."""
    name = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("?"))
    ratio = F.when(F.col("tokens_before") == 0, 1.0).otherwise(F.col("tokens_after") / F.col("tokens_before"))
    made = processed.withColumn("edge", F.concat(name(source), F.lit("->"), name(target))).withColumn("ratio", ratio).withColumn("tokens_saved", F.col("tokens_before") - F.col("tokens_after"))
    return made.withColumn("cost_before", estimate_cost(F.col("tokens_before"), F.col("model"))).withColumn("cost_after", estimate_cost(F.col("tokens_after"), F.col("model")))


def by_edge(records: DataFrame) -> DataFrame:
    return records.groupBy("edge").agg(F.count("*").alias("handoffs"), F.sum("tokens_before").alias("tokens_before"), F.sum("tokens_after").alias("tokens_after"), F.count_if("fell_back").alias("fallbacks"))


def totals(records: DataFrame) -> DataFrame:
    before, after = F.coalesce(F.sum("tokens_before"), F.lit(0)), F.coalesce(F.sum("tokens_after"), F.lit(0))
    return records.agg(
        before.alias("tokens_before"), after.alias("tokens_after"), (before - after).alias("tokens_saved"),
        F.when(before == 0, 1.0).otherwise(after / before).alias("overall_ratio"), F.count_if("fell_back").alias("fallbacks"),
        F.array_sort(F.collect_set("tier")).alias("tiers"), F.count("*").alias("handoffs"),
    )
