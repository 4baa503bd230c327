"""Reports on disk: JSON tables, a page to explore them, heat maps, label lists."""

from __future__ import annotations

import csv
import html
import json
import os
import re
from collections.abc import Iterable
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame

STAMP = re.compile(r"\d{4}-\d\d-\d\d_\d\d-\d\d-\d\d(?:_\d+)?$")


def new_report_dir(base: str, now: datetime | None = None) -> Path:
    """A folder named by local time, with _2, _3 ... where that is taken."""
    stamp = (now or datetime.now()).strftime("%F_%H-%M-%S")
    n, path = 1, Path(base, stamp)
    while path.exists():
        n += 1
        path = Path(base, f"{stamp}_{n}")
    path.mkdir(parents=True)
    return path


def newest_report_dir(base: str) -> Path | None:
    names = [p for p in Path(base).iterdir() if p.is_dir() and STAMP.fullmatch(p.name)] if os.path.isdir(base) else []
    return max(names, key=lambda p: p.name, default=None)


def records(df: DataFrame) -> Iterable[dict]:
    """Rows as plain values, streamed a partition at a time."""
    for row in df.toLocalIterator(prefetchPartitions=True):
        yield row.asDict(recursive=True)


def write_json_rows(df: DataFrame, path: Path) -> int:
    """One JSON array, written row by row, so a table never lies in the driver's memory as a whole."""
    n = 0
    with path.open("w") as f:
        f.write("[")
        for n, row in enumerate(records(df), 1):
            f.write(("," if n > 1 else "") + "\n" + json.dumps(row, ensure_ascii=False, default=str))
        f.write("\n]\n")
    return n


def write_labels(df: DataFrame, path: Path) -> int:
    """Rows for people to label, as CSV with quoting where it is needed."""
    n = 0
    with path.open("w", newline="") as f:
        out = csv.writer(f, lineterminator="\n")
        out.writerow(["name", "relpath", "kind", "score", "human_label"])
        for n, row in enumerate(records(df), 1):
            out.writerow([row[c] for c in ("name", "relpath", "kind", "score", "human_label")])
    return n


def heatmap_svg(rects: Iterable[dict], width: int = 960, height: int = 640) -> str:
    """Rectangles of two pixels or more, labelled where a name fits."""
    parts = [f'<svg viewBox="0 0 {width} {height}" xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}">', "<style>text{font:11px sans-serif;fill:#111}</style>"]
    for r in rects:
        if r["w"] < 2 or r["h"] < 2:
            continue
        name = html.escape(r["relpath"].rsplit("/", 1)[-1])
        parts.append(f'<g><title>{html.escape(r["relpath"])}</title><rect x="{r["x"]:.1f}" y="{r["y"]:.1f}" width="{r["w"]:.1f}" height="{r["h"]:.1f}" fill="{r["fill"]}" stroke="#222" stroke-width="0.6"/>')
        if r["w"] > 48 and r["h"] > 16:
            parts.append(f'<text x="{r["x"] + 4:.1f}" y="{r["y"] + 14:.1f}">{name}</text>')
        parts.append("</g>")
    return "\n".join([*parts, "</svg>"])


_PAGE = """<!doctype html><html lang=en><title>Code index</title><meta charset=utf-8><style>
body{font:14px system-ui,sans-serif;margin:1.5rem;color:#222}nav button{margin-right:.4rem}table{border-collapse:collapse;margin-top:1rem}th{cursor:pointer;text-align:left}
td,th{border-bottom:1px solid #ddd;padding:.25rem .6rem;vertical-align:top;max-width:40rem}input,select{margin-right:.5rem}</style>
<h1>Code index</h1><nav id="tabs"></nav><p><input id="find" placeholder="Filter"><select id="tongue"><option value>All languages</option></select>
<select id="side"><option value="">All files</option><option value="no">Product</option><option value="yes">Tests</option></select><button id="prev">&lsaquo;</button> <span id="where"></span> <button id="next">&rsaquo;</button></p><table id="rows"></table>
<script id="data" type="application/json">__DATA__</script><script>
const tables=JSON.parse(document.getElementById('data').textContent),size=200;let tab=Object.keys(tables)[0],page=0,key=null,up=false;const $=id=>document.getElementById(id);
for(const name of Object.keys(tables)){const b=document.createElement('button');b.textContent=name+' ('+tables[name].length+')';b.onclick=()=>{tab=name;page=0;key=null;draw()};$('tabs').append(b)}
for(const l of new Set((tables.files||[]).map(row=>row.language))){const o=document.createElement('option');o.textContent=o.value=l;$('tongue').append(o)}
function draw(){const q=$('find').value.toLowerCase(),l=$('tongue').value,s=$('side').value;let rows=tables[tab].filter(r=>(!q||Object.values(r).join(' ').toLowerCase().includes(q))&&(!l||!('language' in r)||r.language===l)&&(!s||!('is_test' in r)||r.is_test===(s==='yes')));
if(key)rows=[...rows].sort((a,b)=>(a[key]>b[key]?1:a[key]<b[key]?-1:0)*(up?1:-1));const last=Math.max(0,Math.ceil(rows.length/size)-1);page=Math.min(page,last);$('where').textContent=rows.length+' rows, page '+(page+1)+' of '+(last+1);
const t=$('rows');t.replaceChildren();const shown=rows.slice(page*size,(page+1)*size);if(!shown.length)return;const head=t.insertRow();for(const k of Object.keys(shown[0])){const h=document.createElement('th');h.textContent=k;h.onclick=()=>{up=key===k?!up:false;key=k;draw()};head.append(h)}
for(const r of shown){const row=t.insertRow();for(const v of Object.values(r))row.insertCell().textContent=Array.isArray(v)?v.join(', '):v}}
for(const id of ['find','tongue','side'])$(id).oninput=()=>{page=0;draw()};$('prev').onclick=()=>{page=Math.max(0,page-1);draw()};$('next').onclick=()=>{page++;draw()};draw()
</script>
"""


def join_json(tables: dict[str, Path], path: Path, head: str = "", tail: str = "", escape: bool = False) -> None:
    """One JSON object of the arrays in some files, copied line by line, between a head and a tail."""
    with path.open("w") as out:
        out.write(head + "{")
        for i, (name, source) in enumerate(tables.items()):
            out.write(("," if i else "") + json.dumps(name) + ":")
            with source.open() as rows:
                for line in rows:
                    out.write(line.replace("<", "\\u003c") if escape else line)
        out.write("}" + tail)


def write_explorer(tables: dict[str, Path], path: Path) -> None:
    """One page with the tables inside; '<' is escaped so that no text ends the script."""
    head, tail = _PAGE.split("__DATA__")
    join_json(tables, path, head, tail, escape=True)
