"""Commands: profile, eval, audit, replay, experiment.  Exit code 0; 1 for no tasks or no success; 2 for bad input."""

import argparse
import importlib
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession, functions as F

from . import __version__, reports
from .evaluation import experiment, matrix, tasks
from .operators import handoff, replay, sessions
from .sources import traces


def _profile(spark, args):
    rows = traces.read_trace(spark, args.trace).withColumnRenamed("seq", "index")
    done = sessions.process(rows, sessions.Processor(args.model, args.strategy, args.framework), keys=("index", "source", "target"))
    made = sessions.records(done).persist()
    print(reports.summary(made))
    if args.html:
        Path(args.html).write_text(reports.to_html(made), encoding="utf-8")
    if args.out:
        traces.write_profile(made, args.out)
    return 0


def _eval(spark, args):
    made = traces.read_tasks(spark, args.tasks) if args.tasks else tasks.generate(spark, args.seed)
    if made.isEmpty():
        print("no tasks", file=sys.stderr)
        return 1
    runs = matrix.run(made).persist()
    print(reports.results_markdown(matrix.summarize(runs)))
    if args.out:
        traces.write_results(runs, args.out)
    return 0


def _audit(spark, args):
    traces.check_output(args.out, args.trace)
    rows = traces.read_handoffs(spark, args.trace)
    stages = rows.select(F.col("trace_id").alias("chain_id"), F.posexplode("handoffs").alias("idx", "h")).select("chain_id", "idx", "h.stage", "h.text")
    needs = rows.select(F.col("trace_id").alias("chain_id"), F.explode("requirements").alias("r")).select("chain_id", F.col("r.id").alias("requirement_id"), "r.quote")
    found = handoff.losses(handoff.audit(needs, stages)).orderBy("chain_id", "requirement_id")
    faults = replay.violations(rows)
    traces.write_json({"violations": [r.asDict() for r in faults.collect()], "requirements": [r.asDict() for r in found.collect()]}, args.out, args.trace)
    return 0


def _replay(spark, args):
    traces.check_output(args.out, args.trace)
    module, _, name = args.validator.partition(":")
    if not module or not name:
        raise ValueError("the validator must be given as module:function")
    sys.path.insert(0, "")
    code = importlib.import_module(module)
    if code.__name__.split(".")[0] != __package__:
        from pyspark import cloudpickle

        cloudpickle.register_pickle_by_value(code)  # executors have no copy of the caller's module
    stages = traces.read_handoffs(spark, args.trace)
    last = F.element_at("handoffs", -1)["text"]
    first = F.when(F.size("handoffs") > 1, F.element_at("handoffs", 1)["text"])  # a lone hand-off has no baseline
    rows = stages.select("trace_id", "evidence", "requirements", first.alias("original"), last.alias("candidate"))
    done = [r.asDict(recursive=True) for r in replay.diagnose(rows, getattr(code, name), args.max_evaluations, args.max_added_tokens).collect()]
    traces.write_json({"replays": done}, args.out, args.trace)
    return 0 if all(r["success"] for r in done) else 1


def _experiment(spark, args):
    made = experiment.cases(spark, args.seed, args.variants)
    outcomes, done = experiment.outcomes(made), experiment.replays(made, args.max_evaluations)
    print(reports.experiment_summary(outcomes, done))
    if args.out:
        body = {"seed": args.seed, "outcomes": [json.loads(x) for x in outcomes.toJSON().collect()], "replays": [json.loads(x) for x in done.toJSON().collect()]}
        traces.write_json(body, args.out)
    return 0


def _version(spark, args):
    print(__version__)
    return 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="relaycore", description=__doc__)
    commands = top.add_subparsers(required=True)

    def add(name, run, *options):
        sub = commands.add_parser(name)
        sub.set_defaults(run=run)
        sub.add_argument("--out")
        for flag, settings in options:
            sub.add_argument(flag, **settings)

    least = {"type": int, "default": 8}
    add("profile", _profile, ("trace", {}), ("--model", {"default": "gpt-4.1"}), ("--strategy", {"default": "off", "choices": sessions.STRATEGIES}), ("--framework", {"default": "openai-chat"}), ("--html", {}))
    add("eval", _eval, ("--tasks", {}), ("--seed", {"type": int, "default": 7}))
    add("audit", _audit, ("trace", {}))
    add("replay", _replay, ("trace", {}), ("--validator", {"required": True, "help": "module:function"}), ("--max-evaluations", least), ("--max-added-tokens", {"type": int}))
    add("experiment", _experiment, ("--seed", {"type": int, "default": 7}), ("--variants", {"type": int, "default": 3}), ("--max-evaluations", least))
    add("version", _version)
    return top


def main(argv=None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        return args.run(spark or SparkSession.builder.appName("relaycore").getOrCreate(), args)
    except Exception as error:  # noqa: BLE001: a command reports its failure as an exit code
        print(f"error: {error}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    raise SystemExit(main())
