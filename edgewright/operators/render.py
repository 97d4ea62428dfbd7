"""Pages from panel tables: inline SVG and HTML, on the driver."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame

from edgewright.operators import gates, metrics, monitor, panels, resample, scores, splits
from edgewright.sources.files import small, write_page

CSS = """:root{--ink:#20242b;--bg:#fdfdfd;--good:#0b6e4f;--bad:#a4133c;--soft:#7a5c00;--line:#4f6d7a}
@media(prefers-color-scheme:dark){:root{--ink:#eceff1;--bg:#15181d;--good:#52d1a4;--bad:#ff8fa3;--soft:#f2c14e;--line:#a3b8c2}}
body{font:15px/1.5 system-ui,sans-serif;color:var(--ink);background:var(--bg);max-width:60rem;margin:2rem auto;padding:0 1rem}
table{border-collapse:collapse}td,th{padding:.2rem .7rem;text-align:right;border-bottom:1px solid #8884}th:first-child,td:first-child{text-align:left}
.pass{color:var(--good)}.fail{color:var(--bad)}.warn{color:var(--soft)}svg{width:100%;height:auto}"""


def cell(x) -> str:
    if x is None:
        return "–"
    if isinstance(x, float):
        return "–" if x != x else "∞" if x == float("inf") else f"{x:.4g}"
    return html.escape(str(x))


def table(df: DataFrame, title: str) -> str:
    rows = small(df)
    if not rows:
        return ""
    head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
    body = "".join("<tr>" + "".join(f"<td>{cell(x)}</td>" for x in r) + "</tr>" for r in rows)
    return f"<section><h2>{html.escape(title)}</h2><table><tr>{head}</tr>{body}</table></section>"


def line(points: list[tuple[float, float]], title: str, marks: list[float] = ()) -> str:
    """A line through points; ``marks`` are levels drawn across."""
    if not points:
        return ""
    xs, ys = [p[0] for p in points], [p[1] for p in points] + list(marks)
    w, h, x0, y0 = 720, 220, min(xs), min(ys)
    fx = (w - 20) / ((max(xs) - x0) or 1)
    fy = (h - 20) / ((max(ys) - y0) or 1)
    at = lambda x, y: f"{10 + (x - x0) * fx:.1f},{h - 10 - (y - y0) * fy:.1f}"
    path = " ".join(at(*p) for p in points)
    levels = "".join(f'<line x1="10" x2="{w - 10}" y1="{at(x0, m).split(",")[1]}" y2="{at(x0, m).split(",")[1]}" stroke="var(--bad)" stroke-dasharray="4"/>' for m in marks)
    return f'<section><h2>{html.escape(title)}</h2><svg viewBox="0 0 {w} {h}" role="img" aria-label="{html.escape(title)}">{levels}<polyline points="{path}" fill="none" stroke="var(--line)" stroke-width="2"/></svg></section>'


def columns(values: list[tuple[str, float]], title: str) -> str:
    """Columns with labels."""
    if not values:
        return ""
    w, h, top = 720, 200, max(abs(v) for _, v in values) or 1
    step = w / len(values)
    bars = "".join(f'<rect x="{i * step + 2:.1f}" y="{h - 20 - abs(v) / top * (h - 40):.1f}" width="{step - 4:.1f}" height="{abs(v) / top * (h - 40):.1f}" fill="var({"--good" if v >= 0 else "--bad"})"><title>{html.escape(k)}: {v:.4g}</title></rect>' for i, (k, v) in enumerate(values))
    return f'<section><h2>{html.escape(title)}</h2><svg viewBox="0 0 {w} {h}" role="img">{bars}</svg></section>'


def page(title: str, parts: list[str], path: str | None = None, *, costs_attested: bool = True) -> str:
    stamp = "" if costs_attested else '<p class="warn">Costs are not attested: results may be gross.</p>'
    return write_page(f'<!doctype html><html lang="en"><head><meta charset="utf-8"><title>{html.escape(title)}</title><style>{CSS}</style></head><body><h1>{html.escape(title)}</h1>{stamp}{"".join(parts)}</body></html>', path)


#: What each gate asks, in a line.
ASKS = {"REAL": "Is it more than luck, given all that was tried?", "STRONG": "Is it large enough to matter?", "DURABLE": "Does it last out of sample?", "GENERAL": "Does it hold in other markets?"}


def drawn(rows: list, value: str) -> list[tuple[float, float]]:
    """The points of a curve's pixels: each goes through its first, least, greatest and last value."""
    out = []
    for r in sorted(rows, key=lambda r: r.pixel):
        out += [(r.pixel, r[f"{value}_{k}"]) for k in ("first", "low", "high", "last") if r[f"{value}_{k}"] is not None]
    return out


def grid(rows: list, title: str, bins: int = 40) -> str:
    """Cells of two excursions, shaded by how many trades they hold; green where most of them won."""
    if not rows:
        return ""
    cells: dict[tuple[int, int], list[int]] = {}
    for r in rows:
        cells.setdefault((r.mae_bin, r.mfe_bin), [0, 0])[0 if r.won else 1] += r.n
    most, step = max(map(sum, cells.values())), 400 / bins
    rects = "".join(
        f'<rect x="{x * step:.1f}" y="{400 - (y + 1) * step:.1f}" width="{step:.1f}" height="{step:.1f}" fill="var({"--good" if w >= n else "--bad"})" fill-opacity="{0.15 + 0.85 * (w + n) / most:.2f}"><title>{w} won, {n} lost</title></rect>'
        for (x, y), (w, n) in sorted(cells.items())
    )
    beyond = sum(r.over for r in rows)
    return f'<section><h2>{html.escape(title)}</h2><p>{beyond} trades lie beyond the axes, in the outer cells.</p><svg viewBox="0 0 400 400" role="img">{rects}</svg></section>'


def gate_cards(checks: DataFrame) -> str:
    """A card for each gate, open where it failed, with all of its checks."""
    verdict = {r.gate: r.passed for r in gates.gate_verdicts(checks).collect()}
    by: dict[str, list] = {}
    for r in checks.orderBy("gate_ord", "check_ord").collect():
        by.setdefault(r.gate, []).append(r)
    cards = []
    for gate, rows in by.items():
        tag = lambda r: ("pass", "PASS") if r.passed else ("fail", "FAIL") if r.hard else ("warn", "warn")
        body = "".join(f'<tr><td>{html.escape(r.name)}{"" if r.hard else " (soft)"}<br><small>{html.escape(r.detail or "")}</small></td><td>{cell(r.value)}</td><td>{cell(r.threshold)}</td><td class="{tag(r)[0]}">{tag(r)[1]}</td></tr>' for r in rows)
        state = "pass" if verdict[gate] else "fail"
        cards.append(f'<details{"" if verdict[gate] else " open"}><summary><strong>{html.escape(gate)}</strong> <span class="{state}">{state}</span> {html.escape(ASKS.get(gate, ""))}</summary><table><tr><th>Check</th><th>Value</th><th>Bar</th><th>Result</th></tr>{body}</table></details>')
    return "".join(cards)


def summary(checks: DataFrame) -> str:
    """What holds and what does not, in a sentence each."""
    verdict = [(r.gate, r.passed) for r in gates.gate_verdicts(checks).orderBy("gate_ord").collect()]
    broken = [f"{r.gate} fails on {r.name}" for r in gates.failed_checks(checks).orderBy("gate_ord", "check_ord").collect()]
    chips = " ".join(f'<span class="{"pass" if ok else "fail"}">{html.escape(g)} {"✓" if ok else "✗"}</span>' for g, ok in verdict)
    said = "Every check that decides holds." if not broken else "; ".join(broken) + "."
    return f"<p>{chips}</p><p>{html.escape(said)}</p>"


def banner(checks: DataFrame) -> str:
    state = panels.verdict_state(checks).first().state
    words = {"pass": ("pass", "Every gate passes."), "scope": ("warn", "It holds here; other markets do not confirm it."), "fail": ("fail", "At least one gate fails.")}[state]
    return f'<p class="{words[0]}"><strong>{words[1]}</strong></p>{summary(checks)}{gate_cards(checks)}<pre>{html.escape(gates.audit_text(checks))}</pre>'


def tearsheet(trades: DataFrame, path: str | None = None, *, title: str = "Edge report", n_boot: int = 2000) -> str:
    """One book: verdict, metrics, distribution, cumulative R and drawdown, exits, calibration."""
    parts = [table(resample.reality_check(trades, n_boot=n_boot), "Verdict"), table(metrics.flags(metrics.edge_report(trades)), "Metrics")]
    parts.append(columns([(f"{r.lo:.2f}", float(r.n)) for r in sorted(small(panels.r_histogram(trades)), key=lambda r: r.bin)], "R"))
    ran = small(panels.r_curve(trades))
    parts += [line(drawn(ran, "cum_r"), "Cumulative R", [0.0] if ran else []), line(drawn(ran, "drawdown"), "Drawdown")]
    if {"mfe", "mae"} <= set(trades.columns):
        parts.append(grid(small(panels.excursion_bins(trades)), "Favourable over adverse excursion"))
    parts.append(columns([(f"{r.lo:.3f}", float(r.n)) for r in sorted(small(panels.bootstrap_bins(trades, n_boot=n_boot)), key=lambda r: r.bin)], "Bootstrapped expectancy"))
    if {"exit_date", "entry_date"} & set(trades.columns):
        parts.append(table(panels.block_panel(splits.period_r(trades), n_boot=n_boot), "Monthly mean, single months and blocks"))
    if "exit_reason" in trades.columns:
        parts.append(table(panels.exit_reasons(trades), "Exits"))
    if "bars_held" in trades.columns:
        parts.append(table(panels.holding_medians(trades), "Holding"))
    if "prob" in trades.columns:
        parts.append(table(metrics.calibration(trades).orderBy("bin"), "Calibration"))
    return page(title, parts, path, costs_attested=bool({"cost", "cost_r"} & set(trades.columns)))


def gauntlet_report(trades: DataFrame, checks: DataFrame, path: str | None = None, *, title: str = "Gauntlet", n_boot: int = 2000) -> str:
    parts = [banner(checks), table(panels.bullets(checks).drop("gate_ord"), "Gates"), table(panels.whiskers(trades, checks, n_boot=n_boot), "Bounds and floors")]
    return page(title, parts, path)


def decay_page(preds: DataFrame, path: str | None = None, *, q: int = 5) -> str:
    found = scores.quantile_decay(preds, q).orderBy("bucket")
    rows = small(found)
    return page("Score decay", [columns([(str(r.bucket), r.win_rate) for r in rows], "Win rate by score"), table(found, "Buckets"), table(panels.score_quantiles(preds), "Scores by outcome")], path)


def monitor_page(trades: DataFrame, base, path: str | None = None) -> str:
    design = monitor.cusum_design(base)
    rows = small(monitor.monitor_curve(trades, base, design=design))
    alarm = next((r.alarm_at for r in rows if r.alarm_at is not None), None)
    said = "No alarm." if alarm is None else f"ALARM at trade {alarm}."
    parts = [table(monitor.edge_monitor(trades, base, design=design), "Verdict"), f'<p class="{"pass" if alarm is None else "fail"}">{said}</p>']
    parts.append(line(drawn(rows, "rolling"), "Rolling expectancy, with the baseline and the soft line", [base.expectancy, base.expectancy * monitor.SLIP]))
    return page("Edge monitor", [*parts, line(drawn(rows, "cusum"), "CUSUM and its threshold", [design.h])], path)
