"""Token ids of texts by a public tokenizer file, with a memo of words."""

from __future__ import annotations

import json
import os
import re
import struct
from codecs import charmap_decode
from functools import lru_cache

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a task per core

#: White space that Python splits at but a tokenizer need not.
ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")
PLAIN_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
#: Signs that are tokens of their own behind a word, whatever their number.
CLOSING = ".,;:!?#$%&*"
#: Words remembered per Python worker, about 80 MB.
MEMO_WORDS = 400_000


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level models use for each byte: printable Latin-1
    stands for itself, the rest follows from U+0100 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, spare = {b: chr(b) for b in kept}, 256
    for b in range(256):
        if b not in table:
            table[b] = chr(spare)
            spare += 1
    return table


#: The letter of each byte, as a table for decoding: text as the byte-level model sees it.
_LETTERS = "".join(_byte_letters()[b] for b in range(256))
#: Words of Latin letters that normalisation leaves as they are; a dotted capital I becomes two.
_LATIN = re.compile("[A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]{1,199}")


@lru_cache(maxsize=4)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _normalisers(path: str) -> list[dict]:
    with open(path, encoding="utf-8") as file:
        norm = json.load(file).get("normalizer") or {}
    return norm.get("normalizers", [norm])


@lru_cache(maxsize=4)
def lowers(path: str) -> bool:
    """Whether the tokenizer lowers letters before it looks them up."""
    return any(p.get("type") == "Lowercase" for p in _normalisers(path))


_FORMATS = [struct.Struct(f"<{n}I") for n in range(32)]


def _packed(ids: list[int]) -> bytes:
    return _FORMATS[len(ids)].pack(*ids) if len(ids) < 32 else struct.pack(f"<{len(ids)}I", *ids)


@lru_cache(maxsize=4)
def splits_at_white_space(path: str) -> bool:
    """Whether words between ASCII white space can be encoded one by one: white space is
    dropped by the splitting pattern, nothing is added in front of a word, no special
    token holds or eats white space, and the normaliser works within a word."""
    with open(path, encoding="utf-8") as file:
        d = json.load(file)
    pre = d.get("pre_tokenizer") or {}
    known = all(
        p.get("type") in ("NFC", "Lowercase")
        or p.get("type") == "Replace" and p.get("pattern") == {"Regex": r"\s+"} and p.get("content") == " "
        for p in _normalisers(path)
    )
    steps = pre.get("pretokenizers", [])
    if not known or len(steps) != 2 or steps[0].get("type") != "Split" or steps[1].get("type") != "ByteLevel":
        return False
    pattern = steps[0].get("pattern", {}).get("Regex", "")
    drops = steps[0].get("behavior") == "Removed" and steps[0].get("invert") and pattern.endswith(r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
    plain = not steps[1].get("add_prefix_space") and not steps[1].get("use_regex")
    special = all(
        not (t["lstrip"] or t["rstrip"] or re.search(r"\s", t["content"])) and re.search(r"[^\W_]", t["content"])
        for t in d.get("added_tokens", [])
    )
    return bool(drops and plain and special)


class WordIds(dict):
    """Word without ASCII white space -> its ids as little-endian 32-bit bytes.

    Latin letters with closing punctuation go straight to the tokenizer's model, which
    costs a fifth of a call with offsets; any other word takes the full encode call. When
    half of the memo is full, the words asked for since are kept and those before dropped.
    """

    def __init__(self, path: str):
        super().__init__()
        self.full = tokenizer(path)
        self.tokenize = self.full.model.tokenize
        self.lower = lowers(path)
        self.before: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return _packed(self.full.encode(text, add_special_tokens=False).ids)

    def core(self, core: str) -> bytes:
        core = core.lower() if self.lower else core
        if not core.isascii():
            core = charmap_decode(core.encode(), "strict", _LETTERS)[0]
        return _packed([p.id for p in self.tokenize(core)])

    def new(self, word: str) -> bytes:
        core = word.rstrip(CLOSING)
        if not _LATIN.fullmatch(core):
            return self.whole(word)
        if len(core) == len(word):
            return self.core(core)
        tail = word[len(core) :]
        ids = self.tails.get(tail)
        if ids is None:
            ids = self.whole(tail)
            if len(self.tails) >= 10_000:
                self.tails.clear()
            self.tails[tail] = ids
        return self.core(core) + ids

    def __missing__(self, word: str) -> bytes:
        ids = self.before.get(word)
        if ids is None:
            ids = self.new(word)
        if len(word) < 200:
            if len(self) >= MEMO_WORDS // 2:
                self.before = dict(self)
                self.clear()
            self[word] = ids
        return ids


@lru_cache(maxsize=4)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def words_of(text: str) -> list[str]:
    """Words between ASCII white space."""
    return PLAIN_WORDS.findall(text) if ODD_SPACE.search(text) else text.split()


def id_bytes(text: str, path: str) -> bytes:
    """Ids of a whole text as little-endian unsigned 32-bit values, no special tokens added."""
    if splits_at_white_space(path):
        return b"".join(map(word_ids(path).__getitem__, words_of(text)))
    return np.array(tokenizer(path).encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
