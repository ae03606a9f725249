"""Text, HTML and Markdown views of aggregates; Spark aggregates, the driver formats the few rows."""

from html import escape

from pyspark.sql import DataFrame, functions as F

from .evaluation import experiment, matrix
from .functions.tokens import PRICES
from .operators import sessions

# Fixed value: the month of the prices in use.
PRICES_OF = "2026-06"
_ESTIMATED = "some counts are offline estimates, about 15 to 20 percent off"


def cost(tokens: int, model: str) -> float | None:
    fits = [p for p in PRICES if model.lower().startswith(p[0])]
    return tokens * max(fits, key=lambda p: len(p[0]))[2] / 1_000_000 if fits else None


def money(value: float | None) -> str:
    return "n/a" if value is None else f"${value:,.4f}"


def table(rows: list[list], heads: list[str]) -> str:
    """Columns padded to their widest cell, under a rule."""
    grid = [heads, None, *rows]
    widths = [max(len(str(r[k])) for r in grid if r) for k in range(len(heads))]
    return "\n".join("  ".join(str(c).ljust(w) for c, w in zip(r or ["-" * w for w in widths], widths)) for r in grid)


def _figures(records: DataFrame):
    """Totals, and edges by tokens before, most first; None where nothing is recorded."""
    total = sessions.totals(records).first()
    if not total["handoffs"]:
        return None
    head = records.agg(F.min("model").alias("model"), F.min("strategy").alias("strategy")).first()
    edges = sessions.by_edge(records).orderBy(F.desc("tokens_before"), "edge").collect()
    return total, head, edges


def summary(records: DataFrame) -> str:
    found = _figures(records)
    if found is None:
        return "No handoffs recorded."
    total, head, edges = found
    rows = []
    for e in edges:
        saved = e.tokens_before - e.tokens_after
        share = 100 * saved / e.tokens_before if e.tokens_before else 0.0
        rows.append([e.edge, e.handoffs, f"{e.tokens_before:,}", f"{e.tokens_after:,}", f"{saved:,} ({share:.1f}%)", e.fallbacks])
    costs = [money(cost(n, head.model)) for n in (total.tokens_before, total.tokens_after)]
    out = [
        f"profile - model: {head.model}, strategy: {head.strategy}, token counts: {', '.join(total.tiers)}",
        table(rows, ["edge", "handoffs", "tok before", "tok after", "saved", "fallbacks"]),
        f"total: {total.tokens_before:,} -> {total.tokens_after:,} tokens ({total.tokens_saved:,} saved, ratio {total.overall_ratio:.3f}), {total.fallbacks} fallback(s)\n"
        f"est. input cost: {costs[0]} -> {costs[1]} (prices of {PRICES_OF}; input only)" + (f"\nnote: {_ESTIMATED}" if "estimate" in total.tiers else ""),
    ]
    return "\n\n".join(out)


def to_html(records: DataFrame, most_rows: int | None = None) -> str:
    """A page without outside parts: totals, edges with bars by the largest, and every hand-off (or the first `most_rows`)."""
    found = _figures(records)
    if found is None:
        return "<p>No handoffs recorded.</p>"
    total, head, edges = found
    largest = max(e.tokens_before for e in edges) or 1
    cells = lambda *values: "<tr>" + "".join(f"<td>{v}</td>" for v in values) + "</tr>"
    edge_rows = [cells(escape(e.edge), e.handoffs, f"{e.tokens_before:,}", f"{e.tokens_after:,}", f"{e.tokens_before - e.tokens_after:,}", f"<div style='background:#57c;height:9px;width:{100 * e.tokens_before / largest:.0f}%'></div>") for e in edges]
    keys = [c for c in ("index", "conv_id", "turn") if c in records.columns]
    listed = records.orderBy(*keys or ["edge"])
    notes = lambda r: f"fallback: {escape(r.fallback_reason or '')}" if r.fell_back else f"{r.dedup_hits} dedup hit(s)" if r.dedup_hits else ""
    each = [cells(escape(r.edge), f"{r.tokens_before:,}", f"{r.tokens_after:,}", f"{r.ratio:.3f}", r.tier, notes(r)) for r in (listed if most_rows is None else listed.limit(most_rows)).toLocalIterator()]
    part = lambda title, heads, rows: f"<h2>{title}</h2><table><tr>" + "".join(f"<th>{h}</th>" for h in heads) + "</tr>" + "\n".join(rows) + "</table>"
    return (
        "<!DOCTYPE html><html lang='en'><head><meta charset='utf-8'><title>Hand-off profile</title></head><body><h1>Hand-off profile</h1>"
        f"<p>model <b>{escape(head.model)}</b>, strategy <b>{escape(head.strategy)}</b>, token counts: {', '.join(total.tiers)}</p>"
        f"<p>{total.tokens_before:,} → {total.tokens_after:,} tokens ({total.tokens_saved:,} saved, ratio {total.overall_ratio:.3f}), input cost {money(cost(total.tokens_before, head.model))} → {money(cost(total.tokens_after, head.model))} (prices of {PRICES_OF})</p>"
        + part("Tokens by edge", ("edge", "handoffs", "before", "after", "saved", "share"), edge_rows)
        + part("Hand-offs", ("edge", "before", "after", "ratio", "tier", "notes"), each)
        + (f"<p>{_ESTIMATED}</p>" if "estimate" in total.tiers else "")
        + "</body></html>"
    )


def results_markdown(summary: DataFrame, tolerance: float = matrix.TOLERANCE) -> str:
    """The cells of a matrix as a table, then each strategy's safe point."""
    ratio = lambda r: "—" if r is None else f"{r:.2f}"
    lines = ["| model | strategy | keep ratio | tasks | accuracy | mean token ratio | fallbacks |", "|---|---|---:|---:|---:|---:|---:|"]
    lines += [f"| {c.model} | {c.strategy} | {ratio(c.keep_ratio)} | {c.tasks} | {c.accuracy:.3f} | {c.mean_token_ratio:.3f} | {c.fallback_rate:.1%} |" for c in matrix.ordered(summary).collect()]
    points = matrix.safe_points(summary, tolerance).orderBy("model", "strategy").collect()
    lines += [""] + [f"- **{p.model} / {p.strategy}** safe operating point: keep ratio {ratio(p.keep_ratio)}, {p.mean_token_ratio:.3f} of baseline tokens at accuracy {p.accuracy:.3f} (baseline {p.baseline:.3f})" for p in points]
    return "\n".join(lines)


def experiment_summary(outcomes: DataFrame, replayed: DataFrame) -> str:
    totals = {r.policy: r for r in experiment.policy_totals(outcomes).collect()}
    lines = [f"{p}: {totals[p].passed}/{totals[p].cases} passed; {totals[p].tokens:,} text tokens" for p in experiment.POLICIES if p in totals]
    t = experiment.replay_totals(replayed).first()
    lines += [f"after diagnosis: {t.passed} passed; {t.repaired} repaired", f"overhead: {t.calls} validator calls; {t.attempt_tokens:,} input text tokens", "Statuses by fault:"]
    statuses = experiment.status_counts(replayed).orderBy("fault", "status").collect()
    return "\n".join(lines + [f"  {f}: " + ", ".join(f"{s.status}={s.cases}" for s in statuses if s.fault == f) for f in experiment.FAULTS])
