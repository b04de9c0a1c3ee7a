"""Vectorised word and shingle hashing over UTF-8 bytes.

A polynomial hash modulo 2**64 of every word comes from one prefix sum over a whole batch, so
no Python code runs per word. Hashes are the same on every machine and in every run.
"""
from __future__ import annotations

import functools

import numpy as np

U = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_P_INVERSE = pow(_P, -1, 1 << 64)

_SPACES = np.zeros(256, dtype=bool)
_SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Byte classes: "space" has words between white space; "alnum" letters, digits and all non-ASCII.
CLASSES = {
    "space": ~_SPACES,
    "alnum": np.array([chr(i).isalnum() if i < 128 else True for i in range(256)]),
}


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: xor-shift and multiply, twice."""
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h ^= h >> U(33)
    h = h * U(0xC4CEB9FE1A85EC53)
    h ^= h >> U(33)
    return h


_BYTES = mix(np.arange(1, 257, dtype=U) * U(_P))


#: Bytes that are hashed at once.
PIECE = 1 << 21


@functools.lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _P, dtype=U), np.full(n, _P_INVERSE, dtype=U)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=U), np.cumprod(down, dtype=U)


def _ends_of_pieces(data: np.ndarray, kind: str) -> list[int]:
    """Where to cut data: after the last byte outside words in each PIECE bytes, or inside a word that fills them."""
    ends, at = [], 0
    while len(data) - at > PIECE:
        outside = np.flatnonzero(~CLASSES[kind][data[at : at + PIECE]])
        at += int(outside[-1]) + 1 if len(outside) else PIECE
        ends.append(at)
    return [*ends, len(data)]


def _runs(data: np.ndarray, kind: str, prefixes: tuple[int, ...]):
    """Words of one piece: first bytes, lengths, unfinished hashes, and those of their beginnings."""
    step = np.diff(CLASSES[kind][data].view(np.int8), prepend=np.int8(0), append=np.int8(0))
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    up, down = _powers(PIECE + 1)
    sums = np.empty(len(data) + 1, dtype=U)
    sums[0] = 0
    np.cumsum(_BYTES[data] * up[: len(data)], dtype=U, out=sums[1:])
    heads = []
    for k in prefixes:
        i = np.flatnonzero(ends - starts > k)
        heads.append((i, (sums[starts[i] + k] - sums[starts[i]]) * down[starts[i]]))
    return starts, ends - starts, (sums[ends] - sums[starts]) * down[starts], heads


def words(texts: list[str | None], kind: str = "space", lower: bool = True, prefixes: tuple[int, ...] = ()):
    """Hashes of all words, the first word of each text (len(texts) + 1 offsets), word byte lengths.

    Null counts as empty. Lower-casing follows str.lower. With prefixes (small lengths), a fourth value has, for each
    length in it, the words that are longer and the hashes of so many of their first bytes. Bytes are hashed in pieces, so a
    long text takes a few bytes of memory for each of its words, not tens for each byte; a word that is cut is put together again.
    """
    raw = [(t.lower() if lower else t).encode() if t else b"" for t in texts]
    at = np.zeros(len(raw) + 1, dtype=np.int64)
    np.cumsum([len(r) + 1 for r in raw], out=at[1:])
    data = np.frombuffer(b" ".join(raw) + b" ", dtype=np.uint8)
    del raw
    starts, sizes, hashes, heads, n, begin = [], [], [], [[] for _ in prefixes], 0, 0
    for end in _ends_of_pieces(data, kind):
        s, size, h, cut = _runs(data[begin:end], kind, prefixes)
        if n and len(s) and starts[-1][-1] + sizes[-1][-1] == begin + s[0]:  # the last word goes on
            power = U(pow(_P, int(sizes[-1][-1]), 1 << 64))
            hashes[-1][-1:] += h[:1] * power
            sizes[-1][-1] += size[0]
            cut = [(i[i > 0], x[i > 0]) for i, x in cut]
            cut, s, size, h = [(i - 1, x) for i, x in cut], s[1:], size[1:], h[1:]
        for k, (i, x) in enumerate(cut):
            heads[k].append((i + n, x))
        if len(s):
            starts.append(s + begin), sizes.append(size), hashes.append(h)
            n += len(s)
        begin = end
    none = np.zeros(0, dtype=np.int64)
    start, size = np.concatenate([none, *starts]), np.concatenate([none, *sizes])
    out = mix(np.concatenate([none.astype(U), *hashes])), np.searchsorted(start, at), size
    if not prefixes:
        return out
    return *out, [(np.concatenate([i for i, _ in x]), mix(np.concatenate([y for _, y in x]) + U(k))) for k, x in zip(prefixes, heads, strict=True)]


def shingles(h: np.ndarray, at: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n-word shingles and the first of each text (offsets). A text of 1 to n - 1 words has one
    shingle of all its words; one without words has none."""
    count = np.diff(at)
    per = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    out_at = np.zeros(len(at), dtype=np.int64)
    np.cumsum(per, out=out_at[1:])
    out = np.zeros(int(out_at[-1]), dtype=U)
    if not len(out):
        return out, out_at
    long = np.repeat(count >= n, per)
    first = np.arange(len(out)) - np.repeat(out_at[:-1], per) + np.repeat(at[:-1], per)
    weights = mix(np.arange(1, n + 1, dtype=U) * U(_P)) | U(1)
    i = first[long]
    acc = np.zeros(len(i), dtype=U)
    for k in range(n):
        acc += h[i + k] * weights[k]
    out[long] = mix(acc)
    for d in np.flatnonzero((count > 0) & (count < n)):
        part = h[at[d] : at[d + 1]]
        out[out_at[d]] = mix((part * weights[: len(part)]).sum(dtype=U, keepdims=True) + U(len(part)))[0]
    return out, out_at
