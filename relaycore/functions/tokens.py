"""Token estimates and model lookups as Column expressions."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, functions as F

# Model name prefixes, and prices in USD per million input, cached input and output tokens.
OPENAI_PREFIXES = ("gpt-", "o1", "o3", "o4", "chatgpt", "text-embedding")
ANTHROPIC_PREFIXES = ("claude",)
PRICES = (
    ("gpt-4.1-mini", "openai", 0.40, 0.10, 1.60),
    ("gpt-4.1-nano", "openai", 0.10, 0.025, 0.40),
    ("gpt-4.1", "openai", 2.00, 0.50, 8.00),
    ("gpt-4o-mini", "openai", 0.15, 0.075, 0.60),
    ("gpt-4o", "openai", 2.50, 1.25, 10.00),
    ("o3", "openai", 2.00, 0.50, 8.00),
    ("claude-opus-4", "anthropic", 15.00, 1.50, 75.00),
    ("claude-sonnet-4", "anthropic", 3.00, 0.30, 15.00),
    ("claude-haiku-4", "anthropic", 1.00, 0.10, 5.00),
    ("claude-3-5-haiku", "anthropic", 0.80, 0.08, 4.00),
)
KEEP_RATIO = 0.75

#: White space as Python's \s has it.
SPACE = r"[\t-\r\x1c-\x1f \x85\p{Z}]"
_PIECES = r"(?s)[A-Za-z]+(?:'[A-Za-z]+)?|\p{Nd}+|" + SPACE + "+|."


def heuristic_tokens(text: Column) -> Column:
    """Estimated tokens: words by 7 letters, numbers by 3 digits, white space by 4, any other character 0.7.

    The sum is folded in order in binary floating point and rounded half to even.
    """
    size = F.length

    def weigh(piece):
        word = 1 + F.floor((size(piece) - 1) / 7)
        number = 1 + F.floor((size(piece) - 1) / 3)
        gap = F.floor(size(piece) / 4)
        kind = F.when(piece.rlike("^[A-Za-z]"), word).when(piece.rlike(r"^\p{Nd}"), number).when(piece.rlike("^" + SPACE), gap)
        return F.coalesce(kind.cast("double"), F.lit(0.7).cast("double"))

    total = F.aggregate(F.regexp_extract_all(text, F.lit(_PIECES), F.lit(0)), F.lit(0.0).cast("double"), lambda a, p: a + weigh(p))
    return F.when(text == "", F.lit(0)).otherwise(F.greatest(F.lit(1.0), F.bround(total, 0)).cast("bigint")).cast("bigint")


def exact_tokens(text: Column, tokenizer: str) -> Column:
    """Tokens of a tokenizer file (a path on every executor), an Arrow batch at a time; null for null."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        encoder = Tokenizer.from_file(tokenizer)
        for texts in batches:
            known = texts.dropna()
            sizes = [len(e.ids) for e in encoder.encode_batch(known.tolist(), add_special_tokens=False)]
            yield pd.Series(sizes, index=known.index, dtype="Int64").reindex(texts.index)

    return count(text)


def counter(model: str, tokenizers: dict[str, str] | None = None):
    """(tier, function of a text column) for a model: exact where `tokenizers` names a file for a prefix of it, the longest first, else the estimate."""
    fits = sorted((p for p in tokenizers or {} if model.lower().startswith(p.lower())), key=len)
    if fits:
        return "exact", lambda text: exact_tokens(text, tokenizers[fits[-1]])
    return "estimate", heuristic_tokens


def count_with_tier(text: Column, model: str = "unknown") -> Column:
    return F.struct(heuristic_tokens(text).alias("tokens"), F.lit("estimate").alias("tier"), F.lit(model).alias("model"))


def model_family(model: Column) -> Column:
    lowered = F.lower(model)
    starts = lambda prefixes: lowered.rlike("^(" + "|".join(prefixes) + ")")
    return F.when(starts(OPENAI_PREFIXES), "openai").when(starts(ANTHROPIC_PREFIXES), "anthropic").otherwise("unknown")


def model_profile(model: Column, prices=PRICES) -> Column:
    """The profile whose name is the longest prefix of the model's; null where none is."""
    out = F.lit(None)
    for name, family, price, cached, output in sorted(prices, key=lambda p: len(p[0])):
        row = F.struct(F.lit(name).alias("model"), F.lit(family).alias("family"), F.lit(price).alias("input_price"), F.lit(cached).alias("cached_price"), F.lit(output).alias("output_price"))
        out = F.when(F.lower(model).startswith(name), row).otherwise(out)
    return out


def estimate_cost(tokens: Column, model: Column, cached: bool = False) -> Column:
    """USD of input tokens; null for models without a price."""
    return tokens * model_profile(model)["cached_price" if cached else "input_price"] / 1_000_000
