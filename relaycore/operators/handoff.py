"""Audit and repair of requirements along chains of hand-offs."""

from pyspark.sql import DataFrame, functions as F


def _contracts(requirements: DataFrame, *fields: str) -> DataFrame:
    """The requirements of each chain as one array, so that a stage's text meets them in one row."""
    return requirements.groupBy("chain_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("needs"))


def audit(requirements: DataFrame, handoffs: DataFrame) -> DataFrame:
    """Per chain, requirement and stage: is the quote in the text?  Joined by chain_id."""
    held = handoffs.join(_contracts(requirements, "requirement_id", "quote"), "chain_id")
    seen = F.transform("needs", lambda r: F.struct(r["requirement_id"].alias("requirement_id"), F.contains(F.col("text"), r["quote"]).alias("present")))
    return held.select("chain_id", "idx", "stage", F.explode(seen).alias("r")).select("chain_id", "r.requirement_id", "idx", "stage", "r.present")


def losses(audited: DataFrame) -> DataFrame:
    """Per requirement the first stage that misses it and whether the last one has it."""
    missing = ~F.col("present")
    return audited.groupBy("chain_id", "requirement_id").agg(
        F.min(F.when(missing, F.col("idx"))).alias("first_missing"),
        F.min_by("stage", F.when(missing, F.col("idx"))).alias("first_missing_stage"),
        F.max_by("present", "idx").alias("final_present"),
    )


def repair(requirements: DataFrame, handoffs: DataFrame) -> DataFrame:
    """Each hand-off with its missing quotes appended in the requirements' order, without a cap.

    requirements: chain_id, ord, requirement_id, evidence_id, source, quote.  A quote that an
    earlier restored one contains is not appended again; citations never count as text.
    """
    held = handoffs.join(_contracts(requirements, "ord", "requirement_id", "evidence_id", "source", "quote"), "chain_id")
    found = held.select("chain_id", "idx", "text", F.filter("needs", lambda r: ~F.contains(F.col("text"), r["quote"])).alias("lost"))
    quoted = lambda x: F.regexp_extract(F.to_json(F.array(x)), r"(?s)^\[(.*)\]$", 1)

    def append(done, x):
        known = F.exists(done, lambda d: F.contains(d["quote"], x["quote"]))
        return F.when(known, done).otherwise(F.concat(done, F.array(x)))

    nothing = F.filter("lost", lambda x: F.lit(False))
    kept = F.aggregate("lost", nothing, append)
    clause = lambda x: F.concat(F.lit('\n\n[Source clause {"requirement": '), quoted(x["requirement_id"]), F.lit(', "evidence": '), quoted(x["evidence_id"]), F.lit(', "source": '), quoted(x["source"]), F.lit("}]\n"), x["quote"])
    repaired = F.concat("text", F.array_join(F.transform(kept, clause), ""))
    return found.select("chain_id", "idx", F.size("lost").cast("long").alias("n_restored"), repaired.alias("repaired"))


def evidence_hashes(evidence: DataFrame) -> DataFrame:
    return evidence.select("id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))
