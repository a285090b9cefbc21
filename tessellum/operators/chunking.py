"""Text to chunks: blocks between blank lines, greedily merged up to a size and split beyond a limit."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_CHARS, MAX_CHARS, HARD_CHARS = 100, 2500, 4000
_BLANK = re.compile(r"\n\s*\n")


def _fill(parts: list[str], glue: str) -> list[str]:
    """Neighbours joined while they and the glue stay within MAX_CHARS; blank results go."""
    out, held = [], ""
    for part in parts:
        if len(held) + len(part) + len(glue) <= MAX_CHARS:
            held = held + glue + part if held else part
            continue
        out.append(held.strip())
        held = part
    out.append(held.strip())
    return [x for x in out if x]


def split_oversized(text: str) -> list[str]:
    """At blank lines, or at line ends where there are none; a longer single line stays whole."""
    parts = _BLANK.split(text)
    return _fill(parts, "\n\n") if len(parts) > 1 else _fill(text.split("\n"), "\n")


def merge_split(blocks: list[str]) -> list[str]:
    """Greedy merge of blocks, oversized ones split; chunks under MIN_CHARS go."""
    out, run = [], []
    for block in blocks:
        if len(block) > HARD_CHARS:
            out += [*_fill(run, "\n\n"), *split_oversized(block)]
            run = []
        else:
            run.append(block)
    out += _fill(run, "\n\n")
    return [c for c in out if len(c) >= MIN_CHARS]


def chunk_lines(text: str | None) -> list[str]:
    """Blocks of at least MIN_CHARS between blank lines, merged; the whole stripped text if no block is that long."""
    text = text or ""
    blocks = [b for b in (p.strip() for p in _BLANK.split(text)) if len(b) >= MIN_CHARS]
    if not blocks:
        whole = text.strip()
        return [whole] if len(whole) >= MIN_CHARS else []
    return merge_split(blocks)


def chunk_paragraphs(text: str | None) -> list[str]:
    return merge_split([p for p in (x.strip() for x in _BLANK.split(text or "")) if p])


#: Texts that a worker takes apart at once: what it holds beside Spark's batch.
SLICE_ROWS = 256


def slices(batches, rows: int = SLICE_ROWS):
    """The batches in runs of at most so many rows."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def chunk_column(docs: DataFrame, keep: list[str], text_col: str = "text", how=chunk_lines) -> DataFrame:
    """``keep``, ``chunk_index`` and ``content``; the merge depends on what it has gathered, so it runs over Arrow batches."""
    source = docs.select(*keep, F.col(text_col).alias("_text"))
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.schema if f.name != "_text")

    def run(batches):
        for batch in slices(batches):
            rows, index, content = [], [], []
            for i, text in enumerate(batch.column("_text").to_pylist()):
                for k, c in enumerate(how(text)):
                    rows.append(i)
                    index.append(k)
                    content.append(c)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(k).take(at) for k in keep], pa.array(index, pa.int32()), pa.array(content, pa.string())], names=[*keep, "chunk_index", "content"])

    return source.mapInArrow(run, f"{types}, chunk_index int, content string")


def merge_blocks(docs: DataFrame, keep: list[str], blocks_col: str, text_col: str, otherwise=chunk_lines) -> DataFrame:
    """``keep``, ``chunk_index`` and ``content`` of an array of blocks, merged and split by size; null blocks: what
    ``otherwise`` makes of the text."""
    source = docs.select(*keep, F.col(blocks_col).alias("_blocks"), F.col(text_col).alias("_text"))
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.schema if f.name not in ("_blocks", "_text"))

    def run(batches):
        for batch in slices(batches):
            rows, index, content = [], [], []
            for i, (blocks, text) in enumerate(zip(batch.column("_blocks").to_pylist(), batch.column("_text").to_pylist(), strict=True)):
                for k, c in enumerate(otherwise(text) if blocks is None else merge_split(blocks)):
                    rows.append(i)
                    index.append(k)
                    content.append(c)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(k).take(at) for k in keep], pa.array(index, pa.int32()), pa.array(content, pa.string())], names=[*keep, "chunk_index", "content"])

    return source.mapInArrow(run, f"{types}, chunk_index int, content string")
