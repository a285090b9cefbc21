"""Hashed character n-grams of whole texts as sparse (document, bucket, count) batches in numpy."""

from __future__ import annotations

import functools

import numpy as np

#: Characters that one vectorised step works on; longer texts are cut into overlapping pieces, and no n-gram is lost or counted twice.
PIECE = 1 << 20
#: Rows of one block, so that a row and a bucket fit 32 bits.
MAX_ROWS = 4096


@functools.cache
def _letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def has_letter(texts: list[str | None]) -> list[bool]:
    return [any(map(str.isalpha, t)) if t else False for t in texts]


def _piece_keys(texts: list[str], lead: int, orders: tuple[int, ...], bits: int, wanted: np.ndarray | None) -> np.ndarray:
    """Keys row << bits | bucket of the n-grams that end after the first ``lead`` characters."""
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    cp = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(texts), dtype=np.uint32), lens)
    letter = _letters()[cp]
    cp = np.where(letter, cp, np.uint32(32))
    out = []
    h = cp.copy()
    for n in range(1, max(orders) + 1):
        if n > 1:
            if len(h) < 2:
                break
            h = h[:-1] * np.uint32(0x9E3779B1) + cp[n - 1 :]
        if n not in orders or not len(h):
            continue
        last = len(cp) - len(h)
        ok = row[: len(h)] == row[last:]
        # runs of other characters count as one space
        if n > 1:
            ok &= letter[: len(h)] | letter[1 : 1 + len(h)]
            ok &= letter[last:] | letter[last - 1 : len(cp) - 1]
        else:
            ok &= letter
        if lead:
            ok[: max(0, lead - last)] = False
        x = h ^ (h >> np.uint32(15))
        x = (x + np.uint32(n)) * np.uint32(0x85EBCA6B)
        x = (x ^ (x >> np.uint32(13))) * np.uint32(0xC2B2AE35)
        b = x >> np.uint32(32 - bits)
        if wanted is not None:
            ok &= wanted[b]
        out.append((row[: len(h)][ok] << np.uint32(bits)) | b[ok])
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[at], np.diff(np.append(at, len(keys)))


def sparse_counts(texts: list[str | None], orders: tuple[int, ...], bits: int, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, count) of the n-grams of each lower-cased whole text, sorted by row and bucket.

    Characters other than letters count as spaces. Null counts as empty. At most MAX_ROWS texts. ``wanted``: buckets to
    keep.
    """
    if len(texts) > MAX_ROWS:
        raise ValueError(f"at most {MAX_ROWS} texts a block")
    low = [(t or "").lower() for t in texts]
    overlap = max(orders)  # one more than an n-gram needs, for the look at the character before it
    whole, long = [t if len(t) <= PIECE else "" for t in low], [i for i, t in enumerate(low) if len(t) > PIECE]
    keys, counts = _runs(_piece_keys(whole, 0, orders, bits, wanted))
    if long:
        parts = [(keys, counts)]
        for i in long:
            for at in range(0, len(low[i]), PIECE):
                begin = max(0, at - overlap)
                k, c = _runs(_piece_keys([low[i][begin : at + PIECE]], at - begin, orders, bits, wanted))
                parts.append((k | np.uint32(i << bits), c))
        every = np.concatenate([k for k, _ in parts])
        keys, back = np.unique(every, return_inverse=True)
        counts = np.bincount(back, weights=np.concatenate([c for _, c in parts]), minlength=len(keys)).astype(np.int64)
    return (keys >> np.uint32(bits)).astype(np.int64), (keys & np.uint32((1 << bits) - 1)).astype(np.int64), counts
