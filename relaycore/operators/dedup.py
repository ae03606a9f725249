"""Block deduplication against a session's store or a recipient's history."""

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.tokens import heuristic_tokens
from .messages import blocks

LEAST_TOKENS = 25


def block_rows(messages: DataFrame) -> DataFrame:
    """conv_id, turn, block_idx, block, sha, tokens: one row a block."""
    rows = messages.select("conv_id", "turn", F.posexplode(blocks(F.col("text"))).alias("block_idx", "block"))
    return rows.select("*", F.sha2(F.col("block").cast("binary"), 256).alias("sha"), heuristic_tokens(F.col("block")).alias("tokens"))


def handle(sha):
    return F.concat(F.lit("lc:"), F.substring(sha, 1, 10))


def store_hits(rows: DataFrame) -> DataFrame:
    """Blocks seen before in their session, large enough and worth a reference."""
    order = Window.partitionBy("conv_id", "sha").orderBy("turn", "block_idx")
    ranked = rows.withColumn("seen", F.row_number().over(order) - 1)
    name = handle(F.col("sha"))
    reference = F.concat(F.lit("[ref "), name, F.lit(": call rehydrate('"), name, F.lit("') for the full content]"))
    return ranked.filter((F.col("seen") > 0) & (F.col("tokens") >= LEAST_TOKENS) & (heuristic_tokens(reference) < F.col("tokens"))).drop("seen")


def context_hits(rows: DataFrame) -> DataFrame:
    """Blocks that occur in an earlier turn, with the latest such place and the reference text."""
    earlier = Window.partitionBy("conv_id", "sha").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    found = rows.withColumn("at", F.max(F.struct("turn", "block_idx")).over(earlier)).filter((F.col("tokens") >= LEAST_TOKENS) & F.col("at").isNotNull())
    text = F.concat(F.lit("[ref "), handle(F.col("sha")), F.lit(": see earlier message "), F.col("at.turn") + 1, F.lit(", paragraph "), F.col("at.block_idx") + 1, F.lit("]"))
    return found.select("conv_id", "turn", "block_idx", "sha", "tokens", text.alias("reference")).filter(heuristic_tokens(F.col("reference")) < F.col("tokens"))


def content_store(rows: DataFrame) -> DataFrame:
    """Every distinct block of a session once, under its handle."""
    return rows.groupBy("conv_id", "sha").agg(F.min("block").alias("block")).withColumn("handle", handle(F.col("sha")))


def rehydrate(wanted: DataFrame, store: DataFrame) -> DataFrame:
    """wanted (conv_id, handle) with the block that a content store holds for it; `error` names a handle that it lacks."""
    held = store.select(F.col("conv_id").alias("s_conv"), F.col("handle").alias("s_handle"), "block")
    joined = wanted.join(held, F.col("conv_id").eqNullSafe(F.col("s_conv")) & (F.col("handle") == F.col("s_handle")), "left")
    unknown = F.concat(F.lit("unknown handle: "), F.coalesce("handle", F.lit("null")))
    return joined.select(*wanted.columns, "block", F.when(F.col("block").isNull(), unknown).alias("error"))
