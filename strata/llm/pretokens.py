"""Cutting texts where a byte-level tokenizer cuts them, cheaply.

A byte-level pre-tokenizer never lets a piece run across a space that follows a
visible character, so such a text can be cut at its spaces and each part be
looked up in a bounded cache.  Texts in which that might not hold (white space
before and after a space, unusual white space, special strings) are left whole.
"""

from __future__ import annotations

from array import array
from functools import lru_cache
import re
import sys

from public_tokenizers import PATTERN, path
import regex
import tiktoken
from tokenizers import Tokenizer

_RARE_WHITE = re.compile("[\x85\xa0  -     　]")
_WHITE_THEN_SPACE = tuple(w + " " for w in " \t\n\r\x0b\x0c")


def space_parts(text: str, specials: tuple[str, ...]) -> list[str] | None:
    """``text.split(' ')`` if every part stands alone for the tokenizer, else None."""
    if any(x in text for x in _WHITE_THEN_SPACE) or any(x in text for x in specials):
        return None
    if not text.isascii() and _RARE_WHITE.search(text):
        return None
    return text.split(" ")


@lru_cache(maxsize=4)
def library(name: str) -> Tokenizer:
    """The tokenizers library's own reading of a .json file; the reference for all ids."""
    tokenizer = Tokenizer.from_file(path(name))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@lru_cache(maxsize=4)
def special_strings(name: str) -> tuple[str, ...]:
    return tuple(x.content for x in library(name).get_added_tokens_decoder().values())


@lru_cache(maxsize=4)
def merges(name: str) -> tiktoken.Encoding:
    """The same merges through tiktoken, which is several times faster on short pieces."""
    ranks = {}
    letters = _byte_letters()
    for piece, rank in library(name).get_vocab(with_added_tokens=False).items():
        ranks[bytes(letters[c] for c in piece)] = rank
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _byte_letters() -> dict[str, int]:
    """Byte-level vocabularies write visible Latin-1 bytes as themselves, the others from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@lru_cache(maxsize=1)
def splitter() -> regex.Pattern:
    return regex.compile(PATTERN)


@lru_cache(maxsize=4)
def _special_splitter(name: str) -> regex.Pattern:
    longest = sorted(special_strings(name), key=len, reverse=True)
    return regex.compile("|".join(map(regex.escape, longest)) or "(?!)")


def pretokens(text: str, name: str) -> tuple[list[str], int]:
    """The pre-tokens of a whole text, however its white space stands, and how many special strings it holds."""
    parts = _special_splitter(name).split(text)
    cut = splitter().findall
    return [w for part in parts for w in cut(part)], len(parts) - 1


class PartIds(dict):
    """Part after a space -> its ids as little-endian unsigned 32-bit bytes; holds at most ``limit`` parts."""

    def __init__(self, name: str, limit: int = 400_000):
        super().__init__()
        self.name, self.limit = name, limit
        self.encode = merges(name).encode_ordinary

    def __missing__(self, part: str) -> bytes:
        found = little_endian(self.encode(" " + part))
        if len(self) < self.limit:
            self[part] = found
        return found

    def ids(self, text: str) -> bytes:
        """The ids of a whole text, exactly as ``tokenizers`` gives them."""
        parts = space_parts(text, special_strings(self.name))
        if parts is None:
            return little_endian(library(self.name).encode(text, add_special_tokens=False).ids)
        first = little_endian(self.encode(parts[0])) if parts[0] else b""
        return first + b"".join(map(self.__getitem__, parts[1:]))


def little_endian(ids: list[int]) -> bytes:
    packed = array("I", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()
