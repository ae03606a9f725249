import json

from relaycore.cli import main


def write(path, value):
    path.write_text(value if isinstance(value, str) else json.dumps(value))
    return str(path)


def test_profile_and_bad_input(spark, tmp_path, capsys):
    trace = write(tmp_path / "t.jsonl", '{"role": "user", "content": "hello"}\n')
    assert main(["profile", trace, "--html", str(tmp_path / "p.html")], spark) == 0
    assert "?->?" in capsys.readouterr().out and (tmp_path / "p.html").read_text().startswith("<!DOCTYPE html>")
    assert main(["profile", write(tmp_path / "bad.jsonl", "{no")], spark) == 2
    assert main(["version"], spark) == 0


def test_audit_and_replay(spark, tmp_path, monkeypatch, capsys):
    evidence, needs = [{"id": "e", "text": "keep it", "source": "s"}], [{"id": "r", "evidence_id": "e", "quote": "keep it"}]
    trace = write(tmp_path / "h.json", {"contract": {"evidence": evidence, "requirements": needs}, "handoffs": [{"stage": "a", "text": "keep it"}, {"stage": "b", "text": ""}]})
    assert main(["audit", trace, "--out", trace], spark) == 2
    assert main(["audit", trace, "--out", str(tmp_path / "a.json")], spark) == 0
    found = json.loads((tmp_path / "a.json").read_text())
    assert found["violations"] == [] and found["requirements"][0]["first_missing_stage"] == "b"
    write(tmp_path / "mycheck.py", "def check(text):\n    return 'keep' in text, {}, ''\n\ndef never(text):\n    return False, {}, ''\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    capsys.readouterr()
    assert main(["replay", trace, "--validator", "mycheck:check"], spark) == 0
    assert json.loads(capsys.readouterr().out)["replays"][0]["status"] == "repaired"
    assert main(["replay", trace, "--validator", "mycheck:never"], spark) == 1
    assert main(["replay", trace, "--validator", "none:check"], spark) == 2


def test_a_lone_handoff_has_no_baseline(spark, tmp_path, monkeypatch, capsys):
    evidence, needs = [{"id": "e", "text": "keep it", "source": "s"}], [{"id": "r", "evidence_id": "e", "quote": "keep it"}]
    trace = write(tmp_path / "one.json", {"contract": {"evidence": evidence, "requirements": needs}, "handoffs": [{"stage": "a", "text": "keep it"}]})
    write(tmp_path / "lonecheck.py", "def check(text):\n    return True, {}, ''\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    assert main(["replay", trace, "--validator", "lonecheck:check"], spark) == 1
    assert json.loads(capsys.readouterr().out)["replays"][0]["status"] == "baseline_unavailable"
    assert main(["replay", trace, "--validator", "lonecheck"], spark) == 2
