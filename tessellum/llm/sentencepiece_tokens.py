"""SentencePiece encoding and decoding (6) by a streaming Viterbi search over the pieces of a given merge model.

A sequence of pieces is what the model's merges make of a text exactly if each two neighbours are what the merges make
of the two alone. So the search scores a path by its pairs of neighbours (0 where the merges leave the pair apart, minus
infinity where they don't), and one path survives at each boundary. A boundary looks back as far as the longest piece, and
ids are committed where all boundaries that a later piece may start from lead back to one boundary.

No piece reaches over the start of a word, so all paths converge there: the words of a slice of text are searched in
step, boundary by boundary, in numpy, each distinct word once, and their ids are committed together. A longer run without
such a start is searched by ``stream``, which looks for convergence after every ``longest`` characters. Both hold a slice
of the text, never paths of the whole.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellum.llm.common import blocks, mix64, table, utf8

#: The public model of the queries; the operators take a path.
MODEL_PATH = os.environ.get("TESSELLUM_PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
SPACE = "▁"
#: Characters that one vectorised step works on.
SLICE = 1 << 20
#: Words of more characters go to ``stream``; words that are searched in step.
LONG, TOGETHER = 64, 8192
#: A worker remembers verdicts on pairs of pieces and ids of words in tables of fixed size, in which the newest stands: 4, 4 and 8 MB.
PAIR_BITS, WORD_BITS, ARENA = 18, 18, 1 << 21
#: Verdicts that the scalar search remembers.
SCALAR_PAIRS = 1 << 14
#: Code point that stands for a mark that is part of the text.
LITERAL = 0x110000

_BASE = 0x9E3779B97F4A7C15
_POWER = np.cumprod(np.array([1] + [_BASE] * LONG, np.uint64))
_INVERSE = np.cumprod(np.array([1] + [pow(_BASE, -1, 1 << 64)] * LONG, np.uint64))
_TABLE_BITS = 18


def _spread(chars: np.ndarray) -> np.ndarray:
    """A fixed word, not 0, of each code point."""
    return mix64(chars.astype(np.uint64) + np.uint64(1))


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one after another."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


class Pieces:
    """Vocabulary of a merge model: pieces with ranks (lower merges first), bytes for what no piece covers.

    Arrays only besides the names of pieces, so that a broadcast stays within some 12 MB for 32,000 pieces.
    """

    def __init__(self, pieces: list[str], scores: list[float], byte_ids: list[int], unused: set[int]):
        self.pieces, self.byte_ids, self.unused = pieces, byte_ids, unused
        ids = {p: i for i, p in enumerate(pieces) if i not in unused}
        rank = {p: -scores[i] for p, i in ids.items()}
        self.longest = max(map(len, ids))
        self.size = np.array([len(p) for p in pieces], np.int32)
        #: No piece has a space mark behind another character: words part at marks, and all paths meet there.
        self.words_part = all(SPACE not in p.lstrip(SPACE) for p in ids)
        self.lines_part = all("\n" not in p for p in ids)
        raw = [p.replace(SPACE, " ").encode() for p in pieces]
        for value, i in enumerate(byte_ids):
            raw[i] = bytes([value])
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_size = np.array([len(r) for r in raw], np.int64)
        self.raw_at = np.cumsum(self.raw_size) - self.raw_size

        # what stands at a piece's left and right end while it is made, and the rank of the merge that ends it
        symbols = dict(ids)
        edges: list[tuple[list, list]] = []
        for i, p in enumerate(pieces):
            done = None if i in unused else self._merges(p, rank)
            left, right = [], []
            for a, b, k, n in done or []:
                if k == 0:
                    left.append((symbols.setdefault(a, len(pieces) + len(symbols)), rank[a + b]))
                if k == n - 2:
                    right.append((symbols.setdefault(b, len(pieces) + len(symbols)), rank[a + b]))
            edges.append(([], []) if done is None else ([*left, (i, np.inf)], [*right, (i, np.inf)]))
        self.edge_at, self.edge_symbol, self.edge_end = [], [], []
        for side in (0, 1):
            flat = [x for e in edges for x in e[side]]
            self.edge_at.append(np.concatenate(([0], np.cumsum([len(e[side]) for e in edges]))).astype(np.int64))
            self.edge_symbol.append(np.array([x for x, _ in flat], np.int64))
            self.edge_end.append(np.array([x for _, x in flat], np.float64))
        made = [i for i, e in enumerate(edges) if e[0]]
        joins = {(symbols[p[:k]] << 32 | symbols[p[k:]]): rank[p] for p in ids for k in range(1, len(p)) if p[:k] in symbols and p[k:] in symbols}
        order = np.argsort(np.fromiter(joins, np.int64, len(joins)))
        self.join_keys = np.fromiter(joins, np.int64, len(joins))[order]
        self.join_ranks = np.fromiter(joins.values(), np.float64, len(joins))[order]
        self.lengths = sorted({len(pieces[i]) for i in made}, reverse=True)

        # pieces by the hash of their characters, with linear probing
        self.keys, self.place = np.zeros(1 << _TABLE_BITS, np.uint64), np.full(1 << _TABLE_BITS, -1, np.int32)
        for i in made:
            chars = np.frombuffer(pieces[i].encode("utf-32-le", "surrogatepass"), np.uint32)
            if len(chars) > LONG:
                raise ValueError(f"a piece of over {LONG} characters")
            h = (_spread(chars) * _POWER[: len(chars)]).sum(dtype=np.uint64)
            at = int(h >> np.uint64(64 - _TABLE_BITS))
            while self.keys[at]:
                at = (at + 1) % len(self.keys)
            self.keys[at], self.place[at] = h, i
        self._start()

    def _start(self) -> None:
        self.usable = {p: i for i, p in enumerate(self.pieces) if self.edge_at[0][i] < self.edge_at[0][i + 1]}
        self.sizes: dict[str, tuple[int, ...]] = {}
        for p in self.usable:
            self.sizes.setdefault(p[-1], set()).add(len(p))
        self.sizes = {k: tuple(sorted(v, reverse=True)) for k, v in self.sizes.items()}
        self.pair_keys, self.pair_apart = np.full(1 << PAIR_BITS, -1, np.int64), np.zeros(1 << PAIR_BITS, bool)
        self.word_keys = np.zeros(1 << WORD_BITS, np.uint64)
        self.word_at, self.word_size = np.zeros(1 << WORD_BITS, np.int32), np.zeros(1 << WORD_BITS, np.int32)
        self.arena, self.used = np.zeros(ARENA, np.int32), 0
        self.known: dict[tuple[int, int], bool] = {}

    def __getstate__(self):
        own = ("usable", "sizes", "pair_keys", "pair_apart", "word_keys", "word_at", "word_size", "arena", "used", "known")
        return {k: v for k, v in self.__dict__.items() if k not in own}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._start()

    @staticmethod
    def load(content: bytes) -> Pieces:
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_proto=content)
        n = p.vocab_size()
        pieces = [p.id_to_piece(i) for i in range(n)]
        byte_ids = [p.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        unused = {i for i in range(n) if p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i)}
        return Pieces(pieces, [p.get_score(i) for i in range(n)], byte_ids, unused)

    # ---- pairs of neighbours

    @staticmethod
    def _merges(piece: str, ranks: dict[str, float]) -> list[tuple[str, str, int, int]] | None:
        """The merges that make this piece from characters, in order; None if they end in something else."""
        parts, done = list(piece), []
        while len(parts) > 1:
            rank, k = min((ranks.get(parts[k] + parts[k + 1], np.inf), k) for k in range(len(parts) - 1))
            if rank == np.inf:
                return None
            done.append((parts[k], parts[k + 1], k, len(parts)))
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return done

    def _join_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if not len(self.join_keys):
            return np.full(len(a), np.inf)
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.join_keys, key), len(self.join_keys) - 1)
        return np.where(self.join_keys[at] == key, self.join_ranks[at], np.inf)

    def stays_apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the merges leave these pairs of pieces as they are, side by side."""
        i, j = self.edge_at[1][a].copy(), self.edge_at[0][b].copy()
        out = np.ones(len(a), bool)
        live = np.arange(len(a))
        while len(live):
            x_ends, y_ends = self.edge_end[1][i[live]], self.edge_end[0][j[live]]
            across = self._join_rank(self.edge_symbol[1][i[live]], self.edge_symbol[0][j[live]])
            joined = (across < x_ends) & (across <= y_ends) & (across < np.inf)  # of equal merges the left goes first
            out[live[joined]] = False
            right = x_ends <= y_ends
            i[live[right]] += 1
            j[live[~right]] += 1
            live = live[~joined & ~((x_ends == np.inf) & (y_ends == np.inf))]
        return out

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``stays_apart`` with the verdicts that are remembered."""
        key = a.astype(np.int64) << 32 | b
        slot = (mix64(key.view(np.uint64)) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
        out = self.pair_apart[slot]
        new = np.flatnonzero(self.pair_keys[slot] != key)
        if len(new):
            some, back = np.unique(key[new], return_inverse=True)
            verdict = self.stays_apart(some >> 32, some & 0xFFFFFFFF)[back]
            out[new] = verdict
            self.pair_keys[slot[new]], self.pair_apart[slot[new]] = key[new], verdict
            kept = self.pair_keys[slot[new]] == key[new]  # of two pairs of one slot the last key stands: its verdict too
            self.pair_apart[slot[new[kept]]] = verdict[kept]
        return out

    # ---- encoding

    def find(self, h: np.ndarray) -> np.ndarray:
        """Pieces of these hashes, -1 for others."""
        slot = (h >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)
        held = self.keys[slot]
        out = np.where(held == h, self.place[slot], np.int32(-1))
        rest = np.flatnonzero((held != h) & (held != 0))
        while len(rest):
            slot[rest] = (slot[rest] + 1) & ((1 << _TABLE_BITS) - 1)
            held = self.keys[slot[rest]]
            hit = held == h[rest]
            out[rest[hit]] = self.place[slot[rest[hit]]]
            rest = rest[~hit & (held != 0)]
        return out

    def _in_step(self, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each) of words of at most LONG characters, longest first."""
        n, width = len(starts), int(sizes[0])
        at = np.minimum(starts[None, :] + np.arange(width)[:, None], len(codes) - 1)
        chars = codes[at]
        sums = np.zeros((width + 1, n), np.uint64)
        np.cumsum(np.where(np.arange(width)[:, None] < sizes, _spread(chars) * _POWER[:width, None], np.uint64(0)), axis=0, out=sums[1:])
        last = np.full((width + 1, n), -1, np.int32)  # the piece that ends at each boundary on its surviving path
        for end in range(1, width + 1):
            left = np.arange(int(np.searchsorted(-sizes, -end, side="right")))
            for size in self.lengths:
                if size > end:
                    continue
                piece = self.find((sums[end, left] - sums[end - size, left]) * _INVERSE[end - size])
                hit = np.flatnonzero(piece >= 0)
                if not len(hit):
                    continue
                found, before = piece[hit], last[end - size, left[hit]]
                ok = before < 0  # the start, or a character of no piece
                ask = np.flatnonzero(~ok)
                if len(ask):
                    ok[ask] = self.apart(before[ask], found[ask])
                last[end, left[hit[ok]]] = found[ok]
                rest = np.ones(len(left), bool)
                rest[hit[ok]] = False
                left = left[rest]
                if not len(left):
                    break
            last[end, left] = -2  # a character of no piece stands alone, as bytes
        pos, steps = sizes.copy(), []
        live = np.arange(n)
        while len(live):
            piece = last[pos[live], live].astype(np.int64)
            alone = piece < 0
            steps.append((live, np.where(alone, -1 - chars[pos[live] - 1, live].astype(np.int64), piece)))
            pos[live] -= np.where(alone, 1, self.size[np.maximum(piece, 0)])
            live = live[pos[live] > 0]
        counts = np.zeros(n, np.int64)
        for live, _ in steps:
            counts[live] += 1
        first = np.cumsum(counts) - counts
        out = np.zeros(int(counts.sum()), np.int64)
        for k, (live, piece) in enumerate(steps):
            out[first[live] + counts[live] - 1 - k] = piece
        alone = np.flatnonzero(out < 0)
        if len(alone):
            spelled = [self._spelled(int(c)) for c in -1 - out[alone]]
            times = np.ones(len(out), np.int64)
            times[alone] = [len(s) for s in spelled]
            begin = np.cumsum(times) - times
            owner = np.repeat(np.arange(n), counts)
            counts = np.bincount(owner, weights=times, minlength=n).astype(np.int64)
            out = np.repeat(out, times)
            out[_ranges(begin[alone], times[alone])] = [i for s in spelled for i in s]
        return out.astype(np.int32), counts

    def _spelled(self, code: int) -> list[int]:
        """Ids of the bytes of a character."""
        return [self.byte_ids[b] for b in (SPACE if code == LITERAL else chr(code)).encode("utf-8", "surrogatepass")]

    def _searched(self, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each) of words in the given order."""
        order = np.argsort(-sizes, kind="stable")
        parts: list[np.ndarray] = []
        counts = np.zeros(len(starts), np.int64)
        k = 0
        while k < len(order) and sizes[order[k]] > LONG:
            a, n = int(starts[order[k]]), int(sizes[order[k]])
            slices = (codes[lo : min(a + n, lo + 4096)] for lo in range(a, a + n, 4096))
            ids = [np.array(x, np.int32) for x in self.stream(s.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass") for s in slices)]
            counts[order[k]] = sum(map(len, ids))
            parts += ids
            k += 1
        while k < len(order):
            # together go words of like sizes
            more = order[k : k + TOGETHER]
            more = more[2 * sizes[more] >= sizes[more[0]]]
            ids, counts[more] = self._in_step(codes, starts[more], sizes[more])
            parts.append(ids)
            k += len(more)
        flat = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        done = np.cumsum(counts[order]) - counts[order]
        first = np.zeros(len(starts), np.int64)
        first[order] = done
        return flat[_ranges(first, counts)], counts

    def _words(self, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each) of the words of a slice; each distinct word is searched once, if it isn't remembered."""
        lo, hi = int(starts[0]), int(starts[-1] + sizes[-1])
        within = np.arange(hi - lo) - np.repeat(starts - lo, sizes)
        power = np.cumprod(np.concatenate(([np.uint64(1)], np.full(int(sizes.max()), _BASE, np.uint64))))
        key = np.add.reduceat(_spread(codes[lo:hi]) * power[within], starts - lo)
        del within, power
        key = mix64(key ^ mix64(sizes.astype(np.uint64))) | np.uint64(1)
        some, at, back = np.unique(key, return_index=True, return_inverse=True)
        slot = (some >> np.uint64(64 - WORD_BITS)).astype(np.int64)
        hit = self.word_keys[slot] == some
        counts = np.where(hit, self.word_size[slot], 0).astype(np.int64)
        old = self.arena[_ranges(self.word_at[slot[hit]].astype(np.int64), counts[hit])]
        new = np.flatnonzero(~hit)
        ids, counts[new] = self._searched(codes, starts[at[new]], sizes[at[new]])
        first = np.zeros(len(some), np.int64)
        first[hit] = np.cumsum(counts[hit]) - counts[hit]
        first[new] = len(old) + np.cumsum(counts[new]) - counts[new]
        pool = np.concatenate([old, ids])
        short = new[counts[new] <= LONG]
        take = int(counts[short].sum())
        if self.used + take > ARENA:
            self.word_keys[:], self.used = 0, 0
        if take <= ARENA:
            self.arena[self.used : self.used + take] = pool[_ranges(first[short], counts[short])]
            self.word_keys[slot[short]] = some[short]
            begin = self.used + np.cumsum(counts[short]) - counts[short]
            mine = self.word_keys[slot[short]] == some[short]
            self.word_at[slot[short[mine]]], self.word_size[slot[short[mine]]] = begin[mine], counts[short[mine]]
            self.used += take
        return pool[_ranges(first[back], counts[back])], counts[back]

    def encode_texts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each). A literal mark in a text is written as bytes, so that it comes back;
        null and empty texts have no ids."""
        lens = np.fromiter((len(t) + 1 if t else 0 for t in texts), np.int64, len(texts))
        codes = np.frombuffer("".join([" " + t for t in texts if t]).encode("utf-32-le", "surrogatepass"), np.uint32).copy()  # with the model's dummy prefix
        total = np.zeros(len(texts), np.int64)
        if not len(codes):
            return np.zeros(0, np.int32), total
        literal, space = codes == ord(SPACE), codes == 32
        codes[literal], codes[space] = LITERAL, ord(SPACE)
        alone = literal | (codes == 10) if self.lines_part else literal
        start = alone.copy()
        start[1:] |= alone[:-1]
        if self.words_part:
            start[0] |= space[0]
            start[1:] |= space[1:] & ~space[:-1]
        begin = (np.cumsum(lens) - lens)[lens > 0]
        start[begin] = True
        del literal, space, alone
        starts = np.flatnonzero(start)
        sizes = np.diff(np.append(starts, len(codes)))
        doc = np.flatnonzero(lens > 0)[np.searchsorted(begin, starts, side="right") - 1]
        parts, lo = [], 0
        while lo < len(starts):  # slice by slice, cut where words start
            hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + SLICE)))
            ids, counts = self._words(codes, starts[lo:hi], sizes[lo:hi])
            parts.append(ids)
            total += np.bincount(doc[lo:hi], weights=counts, minlength=len(texts)).astype(np.int64)
            lo = hi
        return np.concatenate(parts), total

    def encode(self, text: str) -> list[int]:
        return self.encode_texts([text])[0].tolist()

    def _last(self, text: str, end: int, last: list[int]) -> int:
        """The piece that ends the surviving path to a boundary, from those to the boundaries before; -2: a lone character."""
        for n in self.sizes.get(text[end - 1], ()):
            piece = self.usable.get(text[end - n : end]) if n <= end else None
            if piece is None:
                continue
            before = last[end - n]
            if before < 0:
                return piece
            ok = self.known.get((before, piece))
            if ok is None:
                if len(self.known) >= SCALAR_PAIRS:
                    self.known.clear()
                ok = self.known[before, piece] = bool(self.apart(np.array([before]), np.array([piece]))[0])
            if ok:
                return piece
        return -2

    def stream(self, chars: Iterable[str]) -> Iterator[list[int]]:
        """Ids of a stream of strings with space marks in place, in commits. What is held is what isn't committed."""
        longest = self.longest
        text, last = "", [-1]
        for given in chars:
            for lo in range(0, len(given), longest):
                text += given[lo : lo + longest]
                while len(last) <= len(text):
                    last.append(self._last(text, len(last), last))
                if len(text) < longest:
                    continue
                alive = set(range(len(text) - longest + 1, len(text) + 1))  # where later pieces may start
                while len(alive) > 1:
                    most = max(alive)
                    alive.discard(most)
                    alive.add(most - (int(self.size[last[most]]) if last[most] >= 0 else 1))
                cut = alive.pop()
                if cut > 0:
                    yield self._walk(text, last, cut)
                    text, last = text[cut:], last[cut:]
        if text:
            yield self._walk(text, last, len(text))

    def _walk(self, text: str, last: list[int], end: int) -> list[int]:
        out: list[int] = []
        while end > 0:
            piece = last[end]
            out.extend([piece] if piece >= 0 else reversed(self._spelled(ord(text[end - 1]))))
            end -= int(self.size[piece]) if piece >= 0 else 1
        out.reverse()
        return out

    # ---- decoding

    def decode_bytes(self, ids: np.ndarray) -> np.ndarray:
        return self.raw[_ranges(self.raw_at[ids], self.raw_size[ids])]

    def decode(self, ids: list[int] | np.ndarray) -> str:
        """The text of these ids, without the dummy prefix."""
        return self.decode_bytes(np.asarray(ids, np.int64)).tobytes()[1:].decode("utf-8", "surrogatepass") if len(ids) else ""

    def gives(self, ids: np.ndarray, counts: np.ndarray, column: pa.Array) -> np.ndarray:
        """Whether the ids of each text decode to it."""
        data, offs = utf8(column)
        want = np.diff(offs)
        size = np.bincount(np.repeat(np.arange(len(counts)), counts), weights=self.raw_size[ids], minlength=len(counts)).astype(np.int64)
        same = np.maximum(size - 1, 0) == want
        begin = np.cumsum(size) - size
        first = np.cumsum(counts) - counts
        lo = 0
        while lo < len(counts):  # texts of about SLICE bytes together
            hi = max(lo + 1, int(np.searchsorted(begin, begin[lo] + SLICE)))
            rows = lo + np.flatnonzero(same[lo:hi] & (want[lo:hi] > 0))
            if len(rows):
                got = self.decode_bytes(ids[first[lo] : first[hi - 1] + counts[hi - 1]])
                a = got[_ranges(begin[rows] - begin[lo] + 1, want[rows])]
                b = data[_ranges(offs[rows], want[rows])]
                same[rows] = np.add.reduceat((a != b).astype(np.int64), np.cumsum(want[rows]) - want[rows]) == 0
            lo = hi
        return same


_made: dict[bytes, Pieces] = {}


def read_pieces(path: str) -> Pieces:
    """The vocabulary of a model's file, read by the driver and broadcast; its size is that of the vocabulary."""
    with open(path, "rb") as f:
        content = f.read()
    if content not in _made:
        _made.clear()
        _made[content] = Pieces.load(content)
    return _made[content]


def encode_column(docs: DataFrame, keep: list[str], model_path: str, text_col: str = "text") -> DataFrame:
    """Columns ``keep`` of ``docs`` with ``token_ids``, ``n_tokens`` and ``round_trip``: whether the decoded ids give the text.

    One row for each row, repeated rows and null ids included; null and empty texts have no ids and come back. Of other
    columns nothing is read; no shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_pieces(model_path))
    source = docs.select(*[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keep)], F.col(text_col).alias("_text"))
    types = [f"{f.name} {f.dataType.simpleString()}" for f in source.schema if f.name != "_text"]

    def run(batches):
        p = shared.value
        for b in blocks(batches, "_text"):
            text = b.column("_text")
            ids, counts = p.encode_texts(text.to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], lists, pa.array(counts), pa.array(p.gives(ids, counts, text))], names=[*b.schema.names[:-1], "token_ids", "n_tokens", "round_trip"])

    out = source.mapInArrow(run, ", ".join([*types, "token_ids array<int>, n_tokens long, round_trip boolean"]))
    return out.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], "token_ids", "n_tokens", "round_trip")


def decode_column(tokens: DataFrame, keep: list[str], model_path: str, ids_col: str = "token_ids") -> DataFrame:
    """Columns ``keep`` and ``text``; null ids give null, no ids an empty text."""
    shared = tokens.sparkSession.sparkContext.broadcast(read_pieces(model_path))
    source = tokens.select(*[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keep)], F.col(ids_col).alias("_ids"))
    types = [f"{f.name} {f.dataType.simpleString()}" for f in source.schema if f.name != "_ids"]

    def run(batches):
        p = shared.value
        for b in batches:
            text = [None if ids is None else p.decode(ids) for ids in b.column("_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(text, pa.string())], names=[*b.schema.names[:-1], "text"])

    out = source.mapInArrow(run, ", ".join([*types, "text string"]))
    return out.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], "text")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, token_ids, n_tokens, round_trip."""
    return encode_column(table(spark, sf_dir, "documents"), ["doc_id"], MODEL_PATH)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: doc_id, lang, source, token_ids, n_tokens, round_trip of each row, repeated rows, null ids and
    empty texts included; an empty table gives an empty result."""
    return encode_column(docs, ["doc_id", "lang", "source"], MODEL_PATH)
