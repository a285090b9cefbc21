"""Markdown to chunks by headings, with the path of headings and what a section holds."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellum.operators.chunking import HARD_CHARS, MAX_CHARS, MIN_CHARS, chunk_paragraphs, slices, split_oversized

HEADING = re.compile(r"^(#{1,6})\s+(.+)$")
FENCE, MERMAID, TABLE = re.compile(r"^\s*```", re.M), re.compile(r"^\s*```\s*mermaid", re.M | re.I), re.compile(r"^\s*\|.*\|\s*$", re.M)

# Section types in order, and what in a heading speaks for them.
SECTION_TYPES = [
    ("decision", ("adr", "decision", "решени")), ("architecture", ("architecture", "архитект")), ("context", ("problem", "context", "зачем")), ("implementation", ("solution", "implementation", "реализац")), ("validation", ("test", "провер")),
    ("risk", ("risk", "rollback", "риск")), ("reference", ("api", "reference")), ("usage", ("install", "usage", "quickstart")), ("benchmark", ("benchmark", "metric")), ("follow_up", ("follow", "next")),
]
FLAGS = ("contains_mermaid", "contains_code", "contains_table")


def section_type(heading: str) -> str:
    low = heading.lower()
    return "preamble" if not low else next((kind for kind, words in SECTION_TYPES if any(w in low for w in words)), "section")


def sections(text: str) -> list[dict]:
    """Preamble and sections with heading, level, path, type and flags; empty without a heading."""
    out: list[dict] = []
    path: list[tuple[int, str]] = []
    lines: list[str] = []
    heading, level = "", 0

    def close() -> None:
        body = "\n".join(lines).strip()
        if body:
            flags = {f: int(bool(rx.search(body))) for f, rx in zip(FLAGS, (MERMAID, FENCE, TABLE), strict=True)}
            out.append({"content": body, "heading": heading, "heading_level": level, "heading_path": " > ".join(h for _, h in path), "doc_section_type": section_type(heading)} | flags)

    found = False
    for line in text.split("\n"):
        m = HEADING.match(line.strip())
        if m:
            close()
            found, lines = True, []
            level, heading = len(m[1]), m[2].strip().strip("#").strip()
            path = [*[p for p in path if p[0] < level], (level, heading)]
        lines.append(line)
    close()
    return out if found else []


def _joined(a: dict, b: dict) -> dict:
    both = lambda key: " | ".join(dict.fromkeys(x for x in (a[key], b[key]) if x))
    levels = [x["heading_level"] for x in (a, b) if x["heading_level"]]
    kinds = {x["doc_section_type"] for x in (a, b)}
    out = {"content": a["content"] + "\n\n" + b["content"], "heading": both("heading"), "heading_level": min(levels, default=0), "heading_path": both("heading_path"), "doc_section_type": kinds.pop() if len(kinds) == 1 else "mixed"}
    return out | {f: a[f] | b[f] for f in FLAGS}


def chunk_markdown(text: str | None) -> list[dict]:
    """Sections merged up to MAX_CHARS with their metadata, oversized ones split; paragraphs where no heading is."""
    parts = sections(text or "")
    if not parts:
        blank = {"heading": "", "heading_level": 0, "heading_path": "", "doc_section_type": ""} | dict.fromkeys(FLAGS, 0)
        return [{"content": c} | blank for c in chunk_paragraphs(text)]
    out: list[dict] = []
    held = None
    for part in parts:
        size = len(part["content"])
        if size > HARD_CHARS:
            out += ([held] if held else []) + [part | {"content": c} for c in split_oversized(part["content"])]
            held = None
        elif (len(held["content"]) if held else 0) + size + 2 <= MAX_CHARS:
            held = _joined(held, part) if held else part
        else:
            out += [held] if held else []
            held = part
    out += [held] if held else []
    return [c for c in out if len(c["content"]) >= MIN_CHARS]


def markdown_chunks(files: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    names = ["content", "heading", "heading_level", "heading_path", "doc_section_type", *FLAGS]
    types = {n: "int" if n in ("heading_level", *FLAGS) else "string" for n in names}
    source = files.select(*keep, F.col(text_col).alias("_text"))
    own = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.schema if f.name != "_text")

    def run(batches):
        for b in slices(batches):
            rows = [(i, k, c) for i, t in enumerate(b.column("_text").to_pylist()) for k, c in enumerate(chunk_markdown(t))]
            at = pa.array([i for i, _, _ in rows], pa.int64())
            made = [pa.array([c[n] for _, _, c in rows], pa.int32() if types[n] == "int" else pa.string()) for n in names]
            yield pa.RecordBatch.from_arrays([*[b.column(k).take(at) for k in keep], pa.array([k for _, k, _ in rows], pa.int32()), *made], names=[*keep, "chunk_index", *names])

    return source.mapInArrow(run, f"{own}, chunk_index int, " + ", ".join(f"{n} {types[n]}" for n in names))
