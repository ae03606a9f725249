import json

import pytest

from relaycore import reports
from relaycore.evaluation import matrix, tasks
from relaycore.operators import compress, sessions
from relaycore.sources import traces
from relaycore.streaming import sessions as streams

# Accuracy and mean token ratio of the study over seed 7, 40 tasks a family.
STUDY = {
    ("passthrough", None): (1.000, 1.000), ("conservative", None): (1.000, 0.936), ("telegraphic", None): (1.000, 0.919),
    ("budgeted", 0.90): (0.967, 0.835), ("budgeted", 0.75): (0.850, 0.729), ("budgeted", 0.60): (0.600, 0.620), ("budgeted", 0.45): (0.383, 0.482), ("budgeted", 0.30): (0.333, 0.387),
    ("naive", 0.90): (0.983, 0.794), ("naive", 0.75): (0.392, 0.662), ("naive", 0.60): (0.175, 0.538), ("naive", 0.45): (0.058, 0.402), ("naive", 0.30): (0.008, 0.271),
}


@pytest.fixture(scope="module")
def runs(spark):
    return matrix.run(tasks.generate(spark)).cache()


def test_study(runs):
    got = {(c.strategy, c.keep_ratio): (round(c.accuracy, 3), round(c.mean_token_ratio, 3)) for c in matrix.summarize(runs).collect()}
    assert got == STUDY
    plans = {r.strategy: r[1] for r in runs.filter("family = 'tool_plan_handoff' and keep_ratio = 0.3").groupBy("strategy").agg({"correct": "max"}).collect()}
    assert plans == {"budgeted": True, "naive": False}


def test_safe_points_and_markdown(runs):
    summary = matrix.summarize(runs)
    points = {p.strategy: p.keep_ratio for p in matrix.safe_points(summary).collect()}
    assert points == {"conservative": None, "telegraphic": None, "naive": 0.9}
    text = reports.results_markdown(summary)
    assert "| mock | budgeted | 0.30 | 120 | 0.333 | 0.387 | 0.0% |" in text and "**mock / naive** safe operating point: keep ratio 0.90" in text
    assert matrix.safe_points(summary.filter("strategy <> 'passthrough'")).count() == 0
    assert matrix.plot_data(summary).count() == 13


def test_tasks_round_trip(spark, tmp_path):
    made = tasks.generate(spark, 3, 5)
    traces.write_tasks(made, str(tmp_path / "t"))
    key = lambda df: sorted((r.task_id, r.receiver_question, json.loads(r.handoff_message)["content"], json.dumps(json.loads(r.expected.fields), sort_keys=True), r.expected["values"]) for r in df.collect())
    back = traces.read_tasks(spark, str(tmp_path / "t"))
    assert key(back) == key(made)
    assert key(tasks.generate(spark, 4, 5)) != key(made)


@pytest.mark.parametrize("text,found", [("x {bad} {\"a\": \"}\"} {\"b\": 1}", {"a": "}"}), ("none", None), ("{", None), ("[{\"a\": 1}]", {"a": 1})])
def test_first_object(text, found):
    assert tasks.first_json_object(text) == found


def test_receiver_reports_broken_structure():
    ask = lambda calls: matrix.mock_receiver(matrix.prompt(json.dumps({"tool_calls": calls}), "q"))
    assert ask([{"function": {"name": "n", "arguments": "{"}}]).startswith("ERROR: tool call arguments")
    assert ask("x") == ask([{"function": {"name": 1, "arguments": {}}}]) == "ERROR: tool call structure is malformed"
    assert json.loads(ask([{"function": {"name": "n", "arguments": "{}"}}])) == {"name": "n", "arguments": {}}
    assert matrix.mock_receiver(matrix.prompt("{}", "unknown thing")) == "the received content does not say"


def lines(tmp_path, *rows):
    path = tmp_path / "trace.jsonl"
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows), encoding="utf-8")
    return str(path)


def test_traces_unwrap_envelopes(spark, tmp_path):
    path = lines(tmp_path, {"role": "user", "content": "a"}, "", {"source": "x", "target": "y", "message": {"role": "user", "content": "b"}}, {"role": "user", "message": "text"}, "  ")
    got = traces.read_trace(spark, path).orderBy("seq").collect()
    assert [(r.seq, r.source, r.target) for r in got] == [(0, None, None), (1, "x", "y"), (2, None, None)]
    assert [json.loads(r.raw).get("content") for r in got] == ["a", "b", None]


@pytest.mark.parametrize("bad", ["{no", "[1]", "3"])
def test_bad_lines_are_errors(spark, tmp_path, bad):
    with pytest.raises(Exception, match="expected a JSON object per line"):
        traces.read_trace(spark, lines(tmp_path, {"role": "user"}, bad)).collect()


def test_handoff_files(spark, tmp_path):
    good = {"contract": {"evidence": [{"id": "e", "text": "a \"q\": b", "source": "s"}], "requirements": [{"id": "r", "evidence_id": "e", "quote": "a"}]}, "handoffs": [{"stage": "s", "text": ""}]}
    row = traces.read_handoffs(spark, lines(tmp_path, json.dumps(good, indent=1))).first()
    assert row.requirements[0].quote == "a" and row.handoffs[0].text == ""
    for bad in ({**good, "handoffs": []}, {**good, "more": 1}, {"handoffs": good["handoffs"]}):
        with pytest.raises(Exception):
            traces.read_handoffs(spark, lines(tmp_path, bad)).collect()


def test_results_profiles_and_json(spark, runs, tmp_path):
    traces.write_results(runs.limit(20), str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r/results.json")).count() == 20
    with pytest.raises(ValueError):
        traces.write_json({}, str(tmp_path / "a"), str(tmp_path / "a"))
    traces.write_json({"a": "é"}, str(tmp_path / "deep/a"))
    assert json.loads((tmp_path / "deep/a").read_text()) == {"a": "é"}


def profile(spark, rows):
    df = spark.createDataFrame([(k, s, t, json.dumps(m)) for k, (s, t, m) in enumerate(rows)], "index long, source string, target string, raw string")
    return sessions.records(sessions.process(df, sessions.Processor("gpt-4.1", "telegraphic"), keys=("index", "source", "target")))


def test_profile_reports_and_round_trip(spark, tmp_path):
    made = profile(spark, [("a", "<b>", {"role": "user", "content": "It is the plan of the team that is in the office for the whole of the week, as the week is long."}), ("a", None, {"no": 1})])
    text, page = reports.summary(made), reports.to_html(made)
    assert "a-><b>" in text and "1 fallback(s)" in text and "$0.0" in text and "note: " in text
    assert "a-&gt;&lt;b&gt;" in page and "fallback: ParseError" in page and "<b>" not in page.split("</h1>")[1].replace("<b>gpt-4.1</b>", "").replace("<b>telegraphic</b>", "")
    assert reports.summary(made.limit(0)) == "No handoffs recorded." and "No handoffs" in reports.to_html(made.limit(0))
    traces.write_profile(made, str(tmp_path / "p"))
    back = sessions.records(traces.read_profile(spark, str(tmp_path / "p")))
    assert sorted(map(str, back.select(*sorted(back.columns)).collect())) == sorted(map(str, made.select(*sorted(back.columns)).collect()))


def test_streams(spark, tmp_path):
    block = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega and once again"
    rows = [(c, t, block, json.dumps({"role": "user", "content": block})) for c in (1, 2) for t in (0, 1, 2)]
    schema = "conv_id int, turn int, text string, raw string"
    for k in range(3):
        spark.createDataFrame([r for r in rows if r[1] == k], schema).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))

    def collect(df, name):
        query = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
        return spark.table(name).collect()

    stored = collect(streams.store_sessions(stream(), sessions.Processor(strategy="conservative", dedup="store")), "stored")
    assert len(stored) == 6 and sum(r.dedup_hits for r in stored) == 4
    assert len(collect(streams.content_store(stream()), "blocks")) == 2
    assert sum(r.tokens_before for r in collect(sessions.process(stream(), sessions.Processor()), "plain")) == 6 * compress.count_tokens(rows[0][3])
    with pytest.raises(ValueError):
        streams.store_sessions(stream(), sessions.Processor())
