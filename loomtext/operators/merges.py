"""Merge lists: their order, one word by the literal rule, exact training on counted words."""
from __future__ import annotations

import heapq

import numpy as np


def in_order(merges: list[tuple[bytes, bytes]]) -> bool:
    """Whether applying the merges one after another equals lowest rank first: every part of a merge that merges
    make has been made by lower ranks only, and no two merges give the same bytes."""
    made: dict[bytes, int] = {}
    for rank, (a, b) in enumerate(merges):
        if a + b in made:
            return False
        made[a + b] = rank
    return all(made.get(x, -1) < rank for rank, m in enumerate(merges) for x in m)


def encode_word(word: bytes, ranks: dict[tuple[bytes, bytes], int]) -> list[bytes]:
    """Merge the leftmost of the lowest-ranked neighbours until none has a rank.

    A heap holds the ranks of neighbours over a linked list of symbols, so a word of n bytes takes about n log n steps. Entries
    whose symbols have changed since are skipped.
    """
    parts: list[bytes | None] = [word[i : i + 1] for i in range(len(word))]
    n = len(parts)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(rank, i) for i in range(n - 1) if (rank := ranks.get((parts[i], parts[i + 1]))) is not None]
    heapq.heapify(heap)
    while heap:
        rank, i = heapq.heappop(heap)
        j = after[i]
        if parts[i] is None or j >= n or ranks.get((parts[i], parts[j])) != rank:
            continue
        parts[i], parts[j] = parts[i] + parts[j], None
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (rank := ranks.get((parts[i], parts[k]))) is not None:
                heapq.heappush(heap, (rank, i))
        if (h := before[i]) >= 0 and (rank := ranks.get((parts[h], parts[i]))) is not None:
            heapq.heappush(heap, (rank, h))
    return [p for p in parts if p is not None]


class _Larger(tuple):
    """A pair that sorts first when it is larger."""

    __slots__ = ()

    def __lt__(self, other):
        return tuple.__gt__(self, other)


def _grouped(code: np.ndarray, *values: np.ndarray):
    """Distinct codes, where each begins, and the values, all in order of the codes."""
    order = np.argsort(code, kind="stable")
    code = code[order]
    starts = np.flatnonzero(np.diff(code, prepend=code[:1] - 1))
    return code[starts].tolist(), starts, [v[order] for v in values]


def train(counts: dict[bytes, int], n: int) -> list[tuple[bytes, bytes]]:
    """Up to n merges: always the most frequent pair, of equal ones the greatest in byte order.

    All words lie in one array of symbols, linked to the next and the previous one; each pair has the positions where it has been seen, of
    which those that still hold it are merged at once. Only the links beside a merge are counted anew, each before and after it, so runs such
    as "abab" are exact; of "aaa" the left two are merged. Heap entries are checked when they come up. It takes about 40 bytes of
    memory for each byte of the distinct words.
    """
    size = np.fromiter(map(len, counts), dtype=np.int64, count=len(counts))
    data = np.frombuffer(b"".join(counts), dtype=np.uint8)
    return grown(data, size, np.fromiter(counts.values(), dtype=np.int64, count=len(counts)), [bytes([i]) for i in range(256)], n)


def grown(data: np.ndarray, size: np.ndarray, counts: np.ndarray, names: list[bytes], n: int, least: int = 1, once: bool = False) -> list[tuple[bytes, bytes]]:
    """train on words of any symbols: their numbers, one word after another; the words' sizes and counts; the symbols' bytes, all different. It ends
    before a pair with a count below `least`, and, with `once`, after a merge whose symbol exists already."""
    end = len(data)  # stands for "none"
    kind = np.int32 if end < 2**31 - 1 else np.int64
    symbol = np.append(data.astype(np.int32), -1)
    after, before = np.append(np.arange(1, end + 1, dtype=kind), end), np.append(np.arange(-1, end - 1, dtype=kind), end)
    edge = np.cumsum(size)
    after[edge[size > 0] - 1] = end
    before[(edge - size)[size > 0]] = end
    weight = np.repeat(counts, size)
    names = list(names)  # equal bytes have one number
    number = {s: i for i, s in enumerate(names)}
    total: dict[int, int] = {}
    where: dict[int, list[np.ndarray]] = {}

    def pairs(at: np.ndarray) -> np.ndarray:
        return symbol[at].astype(np.int64) << 32 | symbol[after[at]]

    def add(at: np.ndarray) -> list[int]:
        if not len(at):
            return []
        found, starts, (at, w) = _grouped(pairs(at), at, weight[at])
        for code, c, p in zip(found, np.add.reduceat(w, starts).tolist(), np.split(at, starts[1:]), strict=True):
            total[code] = total.get(code, 0) + c
            where.setdefault(code, []).append(p)
        return found

    def key(code: int) -> _Larger:
        return _Larger((names[code >> 32], names[code & 0xFFFFFFFF]))

    heap = [(-total[code], key(code), code) for code in add(np.flatnonzero(after[:end] < end).astype(kind)) if total[code] >= least]
    heapq.heapify(heap)
    out: list[tuple[bytes, bytes]] = []
    while heap and len(out) < n:
        c, top, code = heapq.heappop(heap)
        now = total.get(code, 0)
        if now != -c or now < least:
            if least <= now < -c:  # it has shrunk since; growth was pushed when it happened
                heapq.heappush(heap, (-now, top, code))
            continue
        out.append(tuple(top))
        both = top[0] + top[1]
        if both in number:
            if once:
                break
        else:
            number[both] = len(names)
            names.append(both)
        a, b = code >> 32, code & 0xFFFFFFFF
        left = np.unique(np.concatenate(where.pop(code)))
        left = left[(symbol[left] == a) & (symbol[after[left]] == b)]
        if a == b:  # every second one of a run
            i = np.arange(len(left))
            begins = np.concatenate([[True], left[1:] != after[left[:-1]]])
            left = left[(i - np.maximum.accumulate(np.where(begins, i, 0))) % 2 == 0]
        right = after[left]
        beyond = after[right]
        old = np.concatenate([before[left], left, right[beyond < end]])
        old = np.unique(old[old < end])
        found, starts, (w,) = _grouped(pairs(old), weight[old])
        for x, gone in zip(found, np.add.reduceat(w, starts).tolist(), strict=True):
            total[x] -= gone
        symbol[left], symbol[right], after[left] = number[both], -2, beyond
        before[beyond[beyond < end]] = left[beyond < end]
        new = np.concatenate([before[left], left[beyond < end]])
        for x in add(np.unique(new[new < end])):
            if total[x] >= least:
                heapq.heappush(heap, (-total[x], key(x), x))
    return out
