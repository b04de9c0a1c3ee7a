"""Text column functions: special-token segments, pre-tokens, byte symbols.

A word is written as a string of symbols "<6869><21>": upper-case hex of each symbol's bytes. Replacing "<a><b>" by
"<ab>" then is a merge, left to right and without overlaps, and hex order is byte order.
"""
from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the pre-token pattern of byte-level BPE.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END = "<|endoftext|>"
#: Special tokens up to which they are sought by one expression of alternatives; more by an automaton.
MANY = 64


def special_splitter(specials: list[str], many: int | None = None) -> Callable[[str], list[str]]:
    """A function from a text to its parts: what stands between special tokens, and these, in turn, as re.split has them with a group.

    The leftmost special token counts, and of those that begin at one place the longest. Many are found by an Aho-Corasick automaton, whose time
    follows the text and what is found in it, not the number of special tokens; a few by an expression.
    """
    if not specials:
        return lambda text: [text]
    if len(specials) <= (MANY if many is None else many):
        return re.compile("(" + "|".join(map(re.escape, sorted(specials, key=len, reverse=True))) + ")").split
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for s in specials:
        automaton.add_word(s, len(s))
    automaton.make_automaton()

    def split(text: str) -> list[str]:
        out, at = [], 0
        for start, size in sorted((end - n + 1, -n) for end, n in automaton.iter(text)):
            if start >= at:  # not inside the one before
                out += [text[at:start], text[start : start - size]]
                at = start - size
        return [*out, text[at:]]

    return split


#: A blank between a non-blank and an ASCII letter or digit always starts a new pre-token.
_CUT = re.compile(r"(?<=\S) (?=[A-Za-z0-9])")


def cut(text: str, most: int = 1 << 18) -> Iterator[str]:
    """The text in pieces of about `most` characters, whose pre-tokens are those of the text: cuts are made only where a pre-token must begin.
    A text without such a place stays whole."""
    at = 0
    while len(text) - at > most:
        m = _CUT.search(text, at + most)
        if not m:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:] if at else text


def pretokenize(text: Column) -> Column:
    """Array of pre-tokens; null for null. (?U): white space and classes are Unicode's."""
    return F.regexp_extract_all(text, F.lit("(?U)" + PATTERN), F.lit(0))


def split_special(text: Column, specials: list[str] | None = None) -> Column:
    """Array of segments, special tokens as segments of their own, longest first; empty segments are dropped.

    The pieces between the special tokens and the tokens themselves come from the same matches, so they interleave; no
    character is set aside as a separator.
    """
    if not specials:
        return F.filter(F.array(text), lambda s: s != "")
    found = "|".join(re.escape(s) for s in sorted(specials, key=len, reverse=True))
    pieces, tokens = F.split(text, found, -1), F.regexp_extract_all(text, F.lit(f"({found})"), F.lit(1))
    return F.filter(F.flatten(F.zip_with(pieces, tokens, lambda p, t: F.array(p, t))), lambda s: s != "")


def symbols(word: Column) -> Column:
    """One symbol per UTF-8 byte."""
    return F.regexp_replace(F.hex(F.encode(word, "UTF-8")), "(..)", "<$1>")


def symbol_list(word: Column) -> Column:
    """The hex strings of a word's symbols."""
    return F.split(word.substr(F.lit(2), F.length(word) - 2), "><")


def apply_merge(word: Column, left: str, right: str) -> Column:
    return F.replace(word, F.lit(f"<{left}><{right}>"), F.lit(f"<{left}{right}>"))


def replaced(word: Column, pairs: list[tuple[str, str]]) -> Column:
    """word with one string after another replaced."""
    if not pairs:
        return word
    literals = F.array(*(F.struct(F.lit(a).alias("f"), F.lit(b).alias("t")) for a, b in pairs))
    return F.aggregate(literals, word, lambda w, p: F.replace(w, p["f"], p["t"]))


def apply_merges(word: Column, merges: list[tuple[str, str]]) -> Column:
    """All merges in rank order; right if merges.in_order(merges) holds."""
    return replaced(word, [(f"<{a}><{b}>", f"<{a}{b}>") for a, b in merges])


def pieces(text: Column, specials: list[str], mark: Callable[[Column], Column] = lambda s: s) -> Column:
    """Array of pre-tokens in order, and of special tokens as `mark` writes them; null for null."""
    segments = F.when(text.isNotNull(), split_special(text, specials))
    return F.flatten(F.transform(segments, (lambda s: F.when(s.isin(*specials), F.array(mark(s))).otherwise(pretokenize(s))) if specials else pretokenize))


def _raw(data: bytes) -> Column:
    return F.unhex(F.lit(data.hex())).cast("string")


def encoded(text: Column, ids: dict[bytes, int], merges: list[tuple[bytes, bytes]], specials: list[str], null: bool = False) -> Column:
    """Array of token ids of a text, as one expression; right if merges.in_order(merges) holds. Null for null.

    The text's bytes are written as characters of these numbers and merged all at once, the symbol of a merge being a character above them, as are
    special tokens. Pre-tokens are kept apart by the byte FF, and special tokens are first marked by FE, which UTF-8 never has. An id then stands in an
    array at its character's number. A symbol without an id raises, or makes the ids null.
    """
    names, pairs = {bytes([i]): chr(i) for i in range(0xFE)}, []
    order: list[bytes | None] = [*names, None, None]
    for k, s in enumerate(specials):
        pairs.insert(0, (f"\xfe{k}", chr(len(order))))  # longer numbers first
        order.append(s.encode())
    for a, b in merges:
        if a in names and b in names:  # others can't apply
            names[a + b] = chr(len(order))
            pairs.append((names[a] + names[b], names[a + b]))
            order.append(a + b)
    marks = F.create_map(*(c for k, s in enumerate(specials) for c in (F.lit(s), _raw(b"\xfe%d" % k)))) if specials else None
    joined = F.call_function("array_join", pieces(text, specials, lambda s: F.element_at(marks, s)), _raw(b"\xff"))
    merged = replaced(F.decode(joined.cast("binary"), "ISO-8859-1"), [*pairs, ("\xff", "")])
    known = F.array(*(F.lit(None if t is None else ids.get(t)).cast("int") for t in order))
    got = F.transform(F.split(merged, ""), lambda c: F.element_at(known, F.ascii(c) + 1))
    if any(t is not None and t not in ids for t in order):
        lacks = F.exists(got, lambda i: i.isNull())
        got = F.when(lacks, F.lit(None) if null else F.raise_error(F.lit("symbol not in the vocabulary"))).otherwise(got)
    return F.when(text == "", F.array().cast("array<int>")).otherwise(got)  # split would leave one empty string


def text_of_hex(data: Column) -> Column:
    """UTF-8 text of a hex string, U+FFFD for what isn't valid."""
    return F.make_valid_utf8(F.unhex(data).cast("string"))


def strip(text: Column) -> Column:
    """Without white space, Unicode's, at either end."""
    return F.regexp_replace(text, F.lit(r"(?U)^\s+|\s+$"), F.lit(""))


def hex_of(text: str) -> str:
    return text.encode().hex().upper()
