"""Byte-level BPE vocabularies read from a tokenizer JSON file, and text cuts that keep its tokens."""
from __future__ import annotations

import functools
import json
import re
import unicodedata
from dataclasses import dataclass

from loomtext.functions.text import cut as cut
from loomtext.sources.files import byte_unicode

#: Fixed value: the pattern that byte-level BPE files of this kind split text with.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@dataclass(frozen=True)
class Vocabulary:
    tokens: list[bytes]  # by id
    singles: list[int]  # id of each byte
    merges: dict[int, int]  # left << 20 | right -> rank << 20 | merged id
    specials: dict[str, int]
    in_rank_order: bool  # ids of merged tokens rise with the rank: the form that rank files describe


@functools.lru_cache(maxsize=2)
def load(path: str) -> Vocabulary:
    """Read a tokenizer JSON of model BPE with byte-level pieces; another kind, or an option that would change its ids, raises ValueError."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    if model["type"] != "BPE" or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec.get("normalizer"):
        raise ValueError(f"{path}: not a plain byte-level BPE")
    pieces = spec["pre_tokenizer"]
    odd = [k for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
    odd += ["add_prefix_space"] * bool(pieces.get("add_prefix_space")) + ["use_regex"] * (not pieces.get("use_regex", True))
    odd += [f"added token {t['content']}" for t in spec.get("added_tokens", []) if t.get("single_word") or t.get("lstrip") or t.get("rstrip")]
    if odd:
        raise ValueError(f"{path}: not supported: {', '.join(odd)}")
    back, ids = {c: b for b, c in byte_unicode().items()}, model["vocab"]
    specials = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    tokens = [b""] * (max([*ids.values(), *specials.values()]) + 1)
    for text, i in ids.items():
        if text not in specials:
            tokens[i] = bytes(back[c] for c in text)
    for text, i in specials.items():
        tokens[i] = text.encode()
    singles = [ids[c] for c, _ in sorted(back.items(), key=lambda x: x[1])]
    merges, last, rising = {}, -1, True
    for rank, m in enumerate(model["merges"]):
        a, b = m.split(" ") if isinstance(m, str) else m
        new = ids[a + b]
        merges.setdefault(ids[a] << 20 | ids[b], rank << 20 | new)
        rising &= new > last
        last = new
    return Vocabulary(tokens, singles, merges, specials, rising and max(singles) < 256)


_SAFE: set[str] = set(map(chr, [*range(0x09, 0x0E), *range(0x20, 0x7F)]))
_UNSAFE: set[str] = set()


def plain(text: str) -> bool:
    """Whether all Unicode tables agree on the classes of the text's characters: those that have been assigned, with
    the same class, since Unicode 3.2. Others go to the tokenizer's own library."""
    new = set(text) - _SAFE
    if not new:
        return True
    if new & _UNSAFE:
        return False
    old = unicodedata.ucd_3_2_0.category
    for c in new:
        kind = unicodedata.category(c)
        same = old(c)[0] == kind[0] != "C"
        (_SAFE if same and (kind[0] != "Z" or c == " ") else _UNSAFE).add(c)
    return not new & _UNSAFE


def special_pattern(specials) -> re.Pattern | None:
    """Longest first, so of two special strings that start alike the longer wins."""
    return re.compile("|".join(map(re.escape, sorted(specials, key=len, reverse=True)))) if specials else None
