"""Byte-level BPE encoding and decoding (12): the tiktoken library over a local file of ranks.

A text of over ``CHUNK`` characters is encoded in chunks. They part only where the pattern's matches part whatever stands on
either side, so the ids are those of the whole text: before white space that follows something else, and between a letter and
a digit or mark of punctuation. A match of over ``RUN`` white-space characters, which the library's regular expression can't
hold beyond a million of them, is merged as one piece. Decoding joins the raw bytes of the ids.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellum.llm.common import blocks, table, utf8

#: The rank file and the pattern of the query; the operators take both.
RANKS_PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: Characters a chunk; white-space characters that are merged as one piece.
CHUNK, RUN = 1 << 16, 1 << 16
#: A rank file is broadcast; its size is that of a vocabulary.
RANKS_BYTES = 64 << 20

#: The characters of the property White_Space.
_WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Letters (ASCII, kana, ideographs, Hangul), and digits and marks that are none, in every version of Unicode.
_LETTERS, _OTHERS = "A-Za-z\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3", "0-9!-/:-@\\[-`{-~\u3001\u3002\uff01\uff0c\uff1f"
_CUT = re.compile(f"[^{_WHITE}](?=[{_WHITE}])|[{_LETTERS}](?=[{_OTHERS}])")
_LONG_RUN = re.compile(f"[{_WHITE}]{{{RUN},}}")


def chunks(text: str) -> Iterator[tuple[bool, str]]:
    """(whether it is one match, characters) of consecutive parts of a text; encoded one by one they give its ids."""
    lo = 0
    for run in _LONG_RUN.finditer(text):
        # the pattern leaves the last of these characters to what follows
        last = run.end() if run.end() == len(text) else run.end() - 1
        yield from _short(text, lo, run.start())
        yield True, text[run.start() : last]
        lo = last
    yield from _short(text, lo, len(text))


def _short(text: str, lo: int, end: int) -> Iterator[tuple[bool, str]]:
    while lo < end:
        found = _CUT.search(text, lo + CHUNK, end + 1) if lo + CHUNK < end else None
        hi = min(found.end(), end) if found else end
        yield False, text[lo:hi]
        lo = hi


class Ranks:
    """Encoder and decoder of a rank file's content under a pattern."""

    def __init__(self, content: bytes, pattern: str):
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, content.splitlines()) if piece}
        self.by_pattern = tiktoken.Encoding("by_pattern", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.as_one = tiktoken.Encoding("as_one", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})
        self.known = np.zeros(max(ranks.values(), default=-1) + 1, bool)
        self.known[list(ranks.values())] = True

    def encode(self, text: str) -> np.ndarray:
        if len(text) <= CHUNK:
            return np.array(self.by_pattern.encode_ordinary(text), "<u4")
        parts = [np.array((self.as_one if one else self.by_pattern).encode_ordinary(part), "<u4") for one, part in chunks(text)]
        return np.concatenate(parts)

    def decode(self, ids: np.ndarray) -> bytes | None:
        """The raw bytes of these ids, which need not be UTF-8; None where one is no id of the file."""
        if len(ids) and (int(ids.max()) >= len(self.known) or int(ids.min()) < 0 or not self.known[ids].all()):
            return None
        return b"".join(self.by_pattern.decode_bytes(ids[lo : lo + CHUNK].tolist()) for lo in range(0, len(ids), CHUNK))


_made: dict[tuple[bytes, str], Ranks] = {}


def _ranks(content: bytes, pattern: str) -> Ranks:
    """One a worker process; the library's tables take some 30 MB for 50,000 ranks."""
    if (content, pattern) not in _made:
        _made.clear()
        _made[content, pattern] = Ranks(content, pattern)
    return _made[content, pattern]


def _shared(spark: SparkSession, path: str):
    with open(path, "rb") as f:
        content = f.read(RANKS_BYTES + 1)
    if len(content) > RANKS_BYTES:
        raise ValueError(f"{path}: a rank file of over {RANKS_BYTES} bytes")
    return spark.sparkContext.broadcast(content)


def encode_column(docs: DataFrame, keep: list[str], ranks_path: str, pattern: str = public_tokenizers.PATTERN, text_col: str = "text", packed: bool = False) -> DataFrame:
    """Columns ``keep`` of ``docs`` with ``token_ids`` and ``n_tokens``, without special tokens.

    ``token_ids`` is an array of int, or with ``packed`` a binary of little-endian unsigned 32-bit integers, as files of
    training tokens hold them. One row for each row, repeated rows and null ids included; null and empty texts have no ids.
    What isn't UTF-8 counts as U+FFFD. Of other columns nothing is read; no shuffle.
    """
    shared = _shared(docs.sparkSession, ranks_path)
    source = docs.select(*[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keep)], F.col(f"`{text_col}`").alias("_text"))
    types = [f"{f.name} {f.dataType.simpleString()}" for f in source.schema if f.name != "_text"]

    def run(batches):
        ranks = _ranks(shared.value, pattern)
        for b in blocks(batches, "_text"):
            data, offs = utf8(b.column("_text"))
            raw = data.tobytes()
            ids = [ranks.encode(raw[lo:hi].decode("utf-8", "replace")) for lo, hi in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
            counts = np.array([len(x) for x in ids], np.int64)
            if packed:
                column = pa.array([x.tobytes() for x in ids], pa.binary())
            else:
                column = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.array(np.concatenate(ids).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], column, pa.array(counts)], names=[*b.schema.names[:-1], "token_ids", "n_tokens"])

    out = source.mapInArrow(run, ", ".join([*types, f"token_ids {'binary' if packed else 'array<int>'}, n_tokens long"]))
    return out.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], "token_ids", "n_tokens")


def decode_column(tokens: DataFrame, keep: list[str], ranks_path: str, pattern: str = public_tokenizers.PATTERN, ids_col: str = "token_ids") -> DataFrame:
    """Columns ``keep`` and ``decoded``, the raw bytes of the ids (an array or packed); null ids, and such that hold one
    that the file doesn't have, give null; no ids, no bytes."""
    shared = _shared(tokens.sparkSession, ranks_path)
    source = tokens.select(*[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keep)], F.col(f"`{ids_col}`").alias("_ids"))
    types = [f"{f.name} {f.dataType.simpleString()}" for f in source.schema if f.name != "_ids"]

    def run(batches):
        ranks = _ranks(shared.value, pattern)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                b = batch.slice(lo, 256)
                given = [x.as_py() if isinstance(x, pa.BinaryScalar) else x.values and x.values.fill_null(-1).to_numpy() for x in b.column("_ids")]
                decoded = [None if x is None else ranks.decode(np.frombuffer(x, "<u4") if isinstance(x, bytes) else x) for x in given]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(decoded, pa.binary())], names=[*b.schema.names[:-1], "decoded"])

    out = source.mapInArrow(run, ", ".join([*types, "decoded binary"]))
    return out.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], "decoded")


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256 (of what the ids decode to). Null ids and repeated rows
    stay; null and empty texts have no tokens and the digests of nothing; an empty table gives an empty result."""
    tokens = encode_column(table(spark, sf_dir, "documents"), ["doc_id"], RANKS_PATH, packed=True)
    kept = tokens.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), "token_ids")
    decoded = decode_column(kept, ["doc_id", "n_tokens", "ids_sha256"], RANKS_PATH)
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
