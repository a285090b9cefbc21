"""Places of chunks in the files they were cut from."""

from __future__ import annotations

import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_RUN = re.compile(r"\n{2,}")
PLACE = ("char_start", "char_end", "line_start", "line_end")
_PLACES = "array<struct<char_start: int, char_end: int, line_start: int, line_end: int>>"


class _Folded:
    """A text in which each run of newlines is one, with the way back to places in the text."""

    def __init__(self, text: str):
        self.text = text
        self.folded = _RUN.sub("\n", text)
        # behind the k-th run, places in the text are ``lost[k]`` further on than in the folded one
        self.ends, self.lost = [], [0]
        for run in _RUN.finditer(text):
            self.lost.append(self.lost[-1] + run.end() - run.start() - 1)
            self.ends.append(run.end() - self.lost[-1])
        self.lines = [i for i, c in enumerate(text) if c == "\n"]

    def place(self, at: int) -> int:
        return at + self.lost[bisect_right(self.ends, at)]

    def line(self, at: int) -> int:
        """The line (from 1) of a place in the text."""
        return bisect_right(self.lines, at - 1) + 1


def places(text: str, chunks: list[str]) -> list[tuple[int, int, int, int]]:
    """(start, end, first line, last line) of each chunk, looked for behind the one before; a run of newlines in a chunk is any
    run in the text. What isn't found has -1, -1, 0, 0, and the next is looked for from the same place."""
    folded, cursor, out = _Folded(text), 0, []
    for chunk in chunks:
        wanted = _RUN.sub("\n", chunk)
        at = folded.folded.find(wanted, cursor) if wanted else -1
        if at < 0:
            out.append((-1, -1, 0, 0))
            continue
        cursor = at + len(wanted)
        start, end = folded.place(at), folded.place(cursor - 1) + 1
        out.append((start, end, folded.line(start), folded.line(end - 1)))
    return out


def place_chunks(files: DataFrame, chunks: DataFrame, key: str = "path", text_col: str = "text", content_col: str = "content", order: str = "chunk_index") -> DataFrame:
    """The rows of ``chunks`` with ``char_start``, ``char_end`` (behind the last character), ``line_start`` and ``line_end`` in
    the file of their ``key``, which names one file. A file and its chunks are one row of one pass; chunks of files that
    aren't there, and such that the file doesn't hold, have -1, -1, 0, 0."""
    own = chunks.drop(*PLACE)
    grouped = own.groupBy(F.col(key).alias("_key")).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_order"), F.struct(*own.columns).alias("_row")))).alias("_chunks"))
    texts = files.select(F.col(key).alias("_path"), F.col(text_col).alias("_text"))
    both = grouped.join(texts, F.col("_key").eqNullSafe(F.col("_path")), "left")
    source = both.select("_text", F.transform("_chunks", lambda c: c["_row"][content_col]).alias("_contents"), "_chunks")
    kind = source.schema["_chunks"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):  # a file each
                b = batch.slice(i, 1)
                text, contents = b.column("_text")[0].as_py() or "", b.column("_contents")[0].as_py()
                found = [dict(zip(PLACE, p, strict=True)) for p in places(text, [c or "" for c in contents])]
                yield pa.RecordBatch.from_arrays([b.column("_chunks"), pa.array([found], pa.list_(pa.struct([(n, pa.int32()) for n in PLACE])))], names=["_chunks", "_places"])

    placed = source.mapInArrow(run, f"_chunks {kind}, _places {_PLACES}")
    rows = placed.select(F.explode(F.arrays_zip("_chunks", "_places")).alias("z"))
    return rows.select("z._chunks._row.*", *[f"z._places.{n}" for n in PLACE])
