"""Where results go: JSON, an HTML page, a Markdown note, or tables."""

from __future__ import annotations

import html
import json
from pathlib import Path

from pyspark.sql import DataFrame


def write_tables(tables: dict[str, DataFrame], path: str) -> None:
    """Each table as Parquet under its name; results of any size stay distributed."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}")


def write_json(report: dict, path: str) -> str:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(report, indent=2, default=str, sort_keys=False))
    return path


def _table(rows: list[dict]) -> str:
    if not rows:
        return "<p>none</p>"
    head = list(rows[0])
    cell = lambda v: html.escape(f"{v:.3f}" if isinstance(v, float) else str(v))
    return "<table><tr>" + "".join(f"<th>{html.escape(h)}</th>" for h in head) + "</tr>" + "".join("<tr>" + "".join(f"<td>{cell(r.get(h))}</td>" for h in head) + "</tr>" for r in rows) + "</table>"


def render_html(report: dict, title: str = "Entity resolution report") -> str:
    body = "".join(f"<h2>{html.escape(k)}</h2>{_table(v)}" for k, v in report.items())
    return f"<!doctype html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>{body}</body></html>"


def render_markdown(report: dict, title: str = "Entity resolution report") -> str:
    out = [f"# {title}", ""]
    for k, rows in report.items():
        out += [f"## {k}", ""]
        if rows:
            head = list(rows[0])
            out += ["| " + " | ".join(head) + " |", "|" + "-|" * len(head)] + ["| " + " | ".join(f"{r.get(h):.3f}" if isinstance(r.get(h), float) else str(r.get(h)).replace("|", "/") for h in head) + " |" for r in rows] + [""]
    return "\n".join(out)


def write_report(report: dict, folder: str) -> list[str]:
    """``benchmark_metrics.json``, ``report.html`` and ``report.md`` in ``folder``."""
    f = Path(folder)
    f.mkdir(parents=True, exist_ok=True)
    (f / "report.html").write_text(render_html(report))
    (f / "report.md").write_text(render_markdown(report))
    return [write_json(report, str(f / "benchmark_metrics.json")), str(f / "report.html"), str(f / "report.md")]
