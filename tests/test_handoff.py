import re

import pytest
from pyspark.sql import functions as F

from relaycore.functions import prose, tokens
from relaycore.operators import compress, dedup, handoff, messages


def values(spark, column, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("t"))).collect()]


TEXTS = ["", "a", "Don't stop, 12345 things!!!!!", "x" * 30, "a  \n\n\n b", "é ü 漢字 ٣٣", "a.b,c;d:e"]


def test_native_token_count_equals_kernel(spark):
    assert values(spark, tokens.heuristic_tokens, TEXTS) == [compress.count_tokens(t) for t in TEXTS]


@pytest.mark.parametrize("text,structured", [("[not json", True), (" {}", True), ("<p>x", True), ("<!DOCTYPE html>", False), ("plain", False), ("", False)])
def test_structure_follows_first_characters(spark, text, structured):
    assert values(spark, messages.looks_structured, [text]) == [structured]


def test_telegraph_keeps_words_after_negations(spark):
    assert values(spark, prose.telegraph, ["This is the plan, not the draft.", "it is not a test ."]) == ["This plan, not the draft.", "it not a test."]


def test_recapitalize(spark):
    assert values(spark, prose.recapitalize, ["see sec. two", "A. b! c", ""]) == ["See sec. Two", "A. B! C", ""]


def test_segments_join_to_the_text(spark):
    text = "one\n\n| a |\n| b |\n\n```\ncode\n\nx\n```\nend"
    found = values(spark, messages.segments, [text])[0]
    assert "".join(s["text"] for s in found) == text
    assert [s["text"] for s in found if s["kind"] == "protected"] == ["| a |\n| b |", "```\ncode\n\nx\n```"]


def test_longest_prefix_wins(spark):
    assert values(spark, lambda c: tokens.model_profile(c)["model"], ["gpt-4.1-mini-x", "GPT-4.1", "none"]) == ["gpt-4.1-mini", "gpt-4.1", None]


def test_repair_appends_missing_quotes_once(spark):
    needs = spark.createDataFrame([(1, 0, "r0", "e", "s", "alpha beta"), (1, 1, "r1", "e", "s", "beta"), (1, 2, "r2", "e", "s", "here")], "chain_id int, ord int, requirement_id string, evidence_id string, source string, quote string")
    stages = spark.createDataFrame([(1, 0, "a", "only here")], "chain_id int, idx int, stage string, text string")
    row = handoff.repair(needs, stages).first()
    assert row.repaired == 'only here\n\n[Source clause {"requirement": "r0", "evidence": "e", "source": "s"}]\nalpha beta'
    lost = {r.requirement_id: r for r in handoff.losses(handoff.audit(needs, stages)).collect()}
    assert lost["r0"].first_missing == 0 and lost["r2"].first_missing is None and lost["r2"].final_present


def test_context_takes_the_latest_place(spark):
    block = "A block of words that is long enough to be worth a reference in the later text, as it holds far more than twenty-five estimated tokens of plain prose."
    rows = [(1, 0, block), (1, 1, "intro\n\n" + block), (1, 2, block)]
    made = dedup.block_rows(spark.createDataFrame(rows, "conv_id int, turn int, text string"))
    last = [r for r in dedup.context_hits(made).collect() if r.turn == 2]
    assert len(last) == 1 and "message 2, paragraph 2]" in last[0].reference
    assert dedup.store_hits(made).count() == 2


@pytest.mark.parametrize("name", ["conservative", "budgeted", "naive"])
def test_kernels_never_cost_more(name):
    text = "Please note that in order to finish we need 3 steps. The plan is able to hold. It is the plan to hold the plan. " * 3
    out = compress.STRATEGIES[name](text, 0.5)
    assert compress.count_tokens(out) <= compress.count_tokens(text)
    assert not re.search("in order to", out) or name == "naive"


def test_context_hits_and_audit_make_no_pairs(spark):
    rows = spark.createDataFrame([(1, k, "one block of text " * 12) for k in range(40)], "conv_id int, turn int, text string")
    assert "Join" not in dedup.context_hits(dedup.block_rows(rows))._jdf.queryExecution().executedPlan().toString()
    needs = spark.createDataFrame([(1, str(k), "q") for k in range(3)], "chain_id int, requirement_id string, quote string")
    stages = spark.createDataFrame([(1, k, "s", "q") for k in range(4)], "chain_id int, idx int, stage string, text string")
    assert handoff.audit(needs, stages).filter("present").count() == 12


def test_rehydrate_names_unknown_handles(spark):
    store = dedup.content_store(dedup.block_rows(spark.createDataFrame([(1, 0, "a block")], "conv_id int, turn int, text string")))
    handle = store.first().handle
    wanted = spark.createDataFrame([(1, handle), (1, "lc:none"), (2, handle), (1, None)], "conv_id int, handle string")
    got = {(r.conv_id, r.handle): (r.block, r.error) for r in dedup.rehydrate(wanted, store).collect()}
    assert got[(1, handle)] == ("a block", None)
    assert got[(1, "lc:none")] == (None, "unknown handle: lc:none") and got[(2, handle)][0] is None and got[(1, None)][1] == "unknown handle: null"


def test_exact_counts_where_a_tokenizer_is_named(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tier, count = tokens.counter("my-model-2", {"my-": "/nowhere", "my-model": path})
    texts = ["", "two words", "漢字", "x" * 50]
    assert tier == "exact" and values(spark, count, texts) == [len(Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids) for t in texts]
    assert tokens.counter("other", {"my-model": path}) == ("estimate", tokens.heuristic_tokens)
