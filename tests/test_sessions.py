import json

import pytest

from relaycore.operators import compress, segmenting, sessions
from relaycore.operators.sessions import Processor

LONG = "Please note that in order to reach the goal the team is able to hold the plan, which is the plan of all the parts that are in the shared work."
FENCED = f"{LONG}\n\n```python\nthe  code\n\nis kept\n```\n\n| a | b |\n| the | is |\n\n{{\"a\": NaN}}\n\nend of the text"


def frame(spark, rows):
    return spark.createDataFrame([(c, t, m if m is None or isinstance(m, str) else json.dumps(m, ensure_ascii=False)) for c, t, m in rows], "conv_id int, turn int, raw string")


def message(text, role="user", **more):
    return {"role": role, "content": text, **more}


def test_segments_are_lossless_and_protect_code_tables_and_json():
    parts = segmenting.split(FENCED)
    assert "".join(t for _, t in parts) == FENCED
    assert [t.split("\n")[0] for k, t in parts if k == "protected"] == ["```python", "| a | b |", '{"a": NaN}']
    assert segmenting.split("") == []


@pytest.mark.parametrize("strategy", sessions.STRATEGIES)
def test_structure_survives_every_strategy(strategy):
    raw = {"name": "n", **message(FENCED), "tool_calls": [{"id": "x", "function": {"arguments": '{"the": "is"}'}}], "z": [1, None]}
    sent, stats = Processor(strategy=strategy).process(raw)
    assert list(sent) == list(raw) and {**sent, "content": 0} == {**raw, "content": 0}
    assert segmenting.protected(sent["content"]) == segmenting.protected(FENCED)
    assert stats["tokens_after"] <= stats["tokens_before"] and not stats["fell_back"]
    assert (stats["tokens_after"] < stats["tokens_before"]) == (strategy != "off")


@pytest.mark.parametrize("raw", [message("short"), message(LONG, "tool"), message([{"type": "text", "text": LONG}]), message("[" + LONG), message("<p>" + LONG), message(None), message("")])
def test_other_messages_pass_through(raw):
    sent, stats = Processor().process(raw)
    assert sent is raw and not stats["fell_back"] and stats["tokens_after"] == stats["tokens_before"]


@pytest.mark.parametrize("raw,reason", [({"content": LONG}, "ParseError: message has no string 'role' field"), (message(LONG, 42), "ParseError: message has no string 'role' field"), ([1], "ParseError: expected a dict message, got list"), (None, "ParseError: expected a dict message, got NoneType")])
def test_bad_messages_fall_back(raw, reason):
    sent, stats = Processor().process(raw)
    assert sent is raw and stats["fallback_reason"] == reason and stats["safe"]


def boom(text, keep):
    raise RuntimeError("no")


def bloat(text, keep):
    return text + " more of it"


def fence(text, keep):
    return "```\nx\n```"


@pytest.mark.parametrize("kernel,reason", [(boom, "unexpected RuntimeError: no"), (bloat, "processing increased token count"), (fence, "protected payload span mismatch")])
def test_hostile_compressors_fall_back(kernel, reason):
    raw = message(LONG)
    sent, stats = Processor(compressor=kernel).process(raw)
    assert sent is raw and stats["fallback_reason"] == reason and stats["strategy"] == kernel.__name__


def test_langchain_protects_tool_messages():
    chain = Processor(framework="langchain")
    assert chain.process({"type": "human", "content": LONG})[1]["tokens_after"] < chain.process({"type": "human", "content": LONG, "tool_calls": [1]})[1]["tokens_after"]
    assert chain.process({"type": "", "role": "ai", "content": LONG})[0]["content"] != LONG
    with pytest.raises(ValueError):
        Processor(framework="unknown")
    with pytest.raises(ValueError):
        Processor(strategy="unknown")


def test_new_messages_refer_to_the_latest_place(spark):
    rows = [(1, 0, message(LONG)), (1, 1, message("intro\n\n" + LONG)), (1, 2, message([LONG])), (1, 3, message(LONG)), (2, 0, message(LONG)), (3, 0, None), (3, 1, "no json")]
    got = {r.conv_id: r for r in sessions.process_new(frame(spark, rows), Processor()).collect()}
    assert "see earlier message 2, paragraph 2]" in json.loads(got[1].sent)["content"] and got[1].dedup_hits == 1
    assert got[2].dedup_hits == 0 and got[3].fell_back and got[3].sent == "no json"
    assert sessions.process_new(frame(spark, rows), Processor(), 0).count() == 0
    with pytest.raises(ValueError):
        sessions.process_new(frame(spark, rows), Processor(), -1)


def test_all_messages_see_what_was_sent(spark):
    plain = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega and once again"
    rows = [(c, t, message(plain)) for c in (1, 2) for t in (0, 1, 2)]
    for kind in ("context", "store"):
        got = {(r.conv_id, r.turn): r for r in sessions.process_all(frame(spark, rows), Processor(dedup=kind, strategy="conservative")).collect()}
        assert [got[1, t].dedup_hits for t in range(3)] == [0, 1, 1] == [got[2, t].dedup_hits for t in range(3)]
    # A capital letter is put at its head, so what was sent is not what the next one says.
    low = frame(spark, [(1, t, message(plain.lower())) for t in (0, 1)])
    assert sum(r.dedup_hits for r in sessions.process_all(low, Processor(strategy="conservative")).collect()) == 0
    assert sum(r.dedup_hits for r in sessions.process_all(low, Processor(strategy="conservative", dedup="store")).collect()) == 1
    assert sessions.process_all(frame(spark, []), Processor()).count() == 0


def test_records_and_totals(spark):
    rows = frame(spark, [(1, 0, message(LONG)), (1, 1, {"content": "x"})]).selectExpr("*", "'a' as source", "cast(null as string) as target")
    made = sessions.records(sessions.process(rows, Processor(), keys=("conv_id", "turn", "source", "target")))
    edge = sessions.by_edge(made).first()
    assert (edge.edge, edge.handoffs, edge.fallbacks) == ("a->?", 2, 1)
    total = sessions.totals(made).first()
    assert total.tokens_saved == total.tokens_before - total.tokens_after > 0 and total.tiers == ["estimate"]
    nothing = sessions.totals(made.limit(0)).first()
    assert (nothing.tokens_before, nothing.overall_ratio) == (0, 1.0)


def test_budget_meets_the_brute_force_choice():
    """The running counts choose as a search that joins and counts everything anew."""
    text = "The goal must hold. We met at 5 today. The goal is the goal of it. Nothing here! It was of it. Paris waits for the goal.\n\nOne more. It is the goal again. Very long words abound."
    for keep in (0.9, 0.7, 0.5, 0.3):
        spans = [(k, t if k == "protected" else compress.plain_pass(t)) for k, t in segmenting.split(text)]
        kept = [[s, i, p, True] for s, (k, t) in enumerate(spans) for i, p in enumerate(compress._SENTENCES.split(t))]
        words = lambda p: set(compress.re.findall("[a-z0-9]+", p.lower())) - compress._STOP_WORDS
        join = lambda: "".join(" ".join(e[2] for e in kept if e[0] == s and e[3]) for s in range(len(spans)))
        while compress.count_tokens(join()) > max(1, int(compress.count_tokens(text) * keep)):
            best = max(((10.0 if not words(e[2]) else len(words(e[2]) & set().union(*(words(o[2]) for o in kept if o is not e and o[3]))) / len(words(e[2])) - compress._weight(e[2]), -n) for n, e in enumerate(kept) if e[3] and e[1]), default=None)
            if best is None:
                break
            kept[-best[1]][3] = False
        assert compress.budgeted(text, keep) == compress.cheaper(text, join())
