"""Messages: eligibility of payloads, structure detection, segmentation, edges."""

import re

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.tokens import estimate_cost, heuristic_tokens

# The roles whose payload may be changed, by framework, and the least payload length.
PAYLOAD_ROLES = {"openai-chat": ("user", "assistant", "system", "developer"), "langchain": ("human", "ai", "system")}
LEAST_CHARS = 80
_FENCE = r"(?msd)^```.*?^```[ \t]*$"
_BREAK = r"\n[ \t]*\n"


def looks_structured(text: Column) -> Column:
    """JSON-like or tag-led text; the first characters decide, validity does not matter."""
    return text.rlike(r"^\s*[\[{]") | text.rlike(r"^\s*<[a-zA-Z][^>]*>")


def is_structured(text: str) -> bool:
    """`looks_structured` for kernels."""
    return bool(re.match(r"\s*(?:[\[{]|<[a-zA-Z][^>]*>)", text))


def payload_eligible(role: Column, payload: Column, framework: str = "openai-chat") -> Column:
    roles = PAYLOAD_ROLES.get(framework)
    allowed = F.lit(True) if roles is None else role.isin(*roles)
    return payload.isNotNull() & (F.length(payload) >= LEAST_CHARS) & allowed & ~looks_structured(payload)


def segments(text: Column) -> Column:
    """Structs (kind, text) in order: fenced blocks and tables are protected, other paragraphs and gaps are text.

    Paragraphs that are JSON documents need a parser and stay text here.
    """
    nothing = F.array().cast("array<string>")
    piece = lambda kind, x: F.struct(F.lit(kind).alias("kind"), x.alias("text"))

    def paragraphs(block):
        mixed = F.flatten(F.zip_with(F.split(block, _BREAK), F.regexp_extract_all(block, F.lit(_BREAK), F.lit(0)), lambda p, s: F.array(p, s)))
        kind = lambda x: F.when(x.rlike(r"^\s*\|[^\n]*\n[ \t]*\|"), "protected").otherwise("text")
        return F.transform(F.filter(mixed, lambda x: x.isNotNull() & (x != "")), lambda x: F.struct(kind(x).alias("kind"), x.alias("text")))

    fences = F.transform(F.regexp_extract_all(text, F.lit(_FENCE), F.lit(0)), lambda f: F.array(piece("protected", f)))
    empty = F.array().cast("array<struct<kind:string,text:string>>")
    return F.flatten(F.zip_with(F.transform(F.split(text, _FENCE), paragraphs), fences, lambda b, f: F.concat(b, F.coalesce(f, empty))))


def blocks(text: Column) -> Column:
    return F.split(text, _BREAK)


def with_edges(messages: DataFrame, model: str = "gpt-4.1") -> DataFrame:
    """Each message's edge (its role to the next one's in the conversation), tokens of the whole message, and cost."""
    following = F.lead("role").over(Window.partitionBy("conv_id").orderBy("turn"))
    name = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("?"))
    made = messages.withColumn("target", following).withColumn("edge", F.concat(name(F.col("role")), F.lit("->"), name(F.col("target"))))
    made = made.withColumn("tokens", heuristic_tokens(F.to_json(F.struct("role", F.col("text").alias("content")))))
    return made.withColumn("cost", estimate_cost(F.col("tokens"), F.lit(model)))


def edge_profile(messages: DataFrame, model: str = "gpt-4.1") -> DataFrame:
    return with_edges(messages, model).groupBy("edge").agg(F.count("*").alias("handoffs"), F.sum("tokens").alias("tokens_before"))
