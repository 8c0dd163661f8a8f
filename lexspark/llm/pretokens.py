"""Byte-level BPE by distinct pre-token.

The tokenizer file splits a text into pre-tokens and codes each on its own, so a pre-token
always has the same ids. Texts of plain characters are split by one compiled expression;
all other texts, and those that hold a special token's string, go to the tokenizers library
as a whole. Where the file's ids are the ranks of its merges, plain texts are coded by
tiktoken with the file's own pieces and ids, which gives the same ids several times faster
and keeps no memo; else the library codes them.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Iterable

import numpy as np

#: Characters whose classes have not changed for long: Latin, Cyrillic, general punctuation, the euro sign.
PLAIN = [*range(0x0000, 0x0180), *range(0x0400, 0x0460), *range(0x2010, 0x2028), 0x20AC]
BLANK = {*range(9, 14), 0x20, 0x85, 0xA0}


def _class(points: Iterable[int]) -> str:
    return "".join(f"\\u{c:04x}" for c in points)


def splitter() -> tuple[re.Pattern, re.Pattern]:
    """What a plain text matches as a whole, and its pre-tokens."""
    letter = _class(c for c in PLAIN if unicodedata.category(chr(c))[0] == "L")
    number = _class(c for c in PLAIN if unicodedata.category(chr(c))[0] == "N")
    blank = _class(sorted(BLANK))
    # The pattern of the public byte-level vocabulary.
    pieces = f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{blank}{letter}{number}]+|[{blank}]+(?![^{blank}])|[{blank}]+"
    return re.compile(f"[{_class(PLAIN)}]*"), re.compile(pieces)


def _byte_names() -> dict[int, str]:
    """The public byte-level scheme: printable bytes stand for themselves, the others for characters from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


#: Longest run of blanks, or of other characters without one, that the fast coder gets; longer ones go to the library.
LONGEST_RUN = 1_000


def _ranks(path: str, special: list[str]) -> dict[bytes, int] | None:
    """Bytes to ids, if every merge makes the id that follows the one before it: then an id is a rank."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    if model.get("ignore_merges") or model.get("dropout") or model.get("type") != "BPE":
        return None
    ids = {k: i for k, i in model["vocab"].items() if k not in special}
    for i, merge in enumerate(model["merges"]):
        if ids.get("".join(merge if isinstance(merge, list) else merge.split(" "))) != 256 + i:
            return None
    bytes_of = {c: b for b, c in _byte_names().items()}
    return {bytes(map(bytes_of.__getitem__, k)): i for k, i in ids.items()} if len(ids) == 256 + len(model["merges"]) else None


class Vocabulary:
    """A byte-level BPE file of the tokenizers library. It holds no texts or pre-tokens once a call has ended."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.plain, self.pieces = splitter()
        self.blanks = re.compile(rf"\s{{{LONGEST_RUN}}}")
        self.names = _byte_names()
        self.path = path
        self._fast = None

    def fast(self):
        """tiktoken's coder with this file's pieces, made when it is first asked for; False if ids aren't ranks."""
        if self._fast is None:
            ranks = _ranks(self.path, self.special)
            if ranks is None:
                self._fast = False
            else:
                import tiktoken

                # The pattern of the public byte-level vocabulary.
                pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
                self._fast = tiktoken.Encoding(os.path.basename(self.path), pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return self._fast

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def regular(self, text: str) -> bool:
        """Whether the expression here splits the text as the library does."""
        return self.plain.fullmatch(text) is not None and not any(s in text for s in self.special)

    def split(self, text: str) -> list[str]:
        """The pre-tokens of any text; special tokens' strings stay whole."""
        if self.regular(text):
            return self.pieces.findall(text)
        split = self.tokenizer.pre_tokenizer.pre_tokenize_str
        parts = re.split("(" + "|".join(map(re.escape, self.special)) + ")", text) if self.special else [text]
        return [p for part in parts if part for p in ([part] if part in self.special else (part[a:b] for _, (a, b) in split(part)))]

    def count(self, piece: str) -> int:
        """How many ids a pre-token has."""
        if piece in self.special or not self.regular(piece):
            return len(self.whole(piece))
        return len(self.model.tokenize(piece.encode().decode("latin-1").translate(self.names)))

    def _long_run(self, text: str) -> bool:
        return len(text) >= LONGEST_RUN and (max(map(len, text.split()), default=0) >= LONGEST_RUN or self.blanks.search(text) is not None)

    def encode(self, text: str) -> bytes:
        """The ids of the text, each as four bytes, lowest first."""
        if (fast := self.fast()) and self.regular(text) and not self._long_run(text):
            return fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()
        return np.array(self.whole(text), dtype="<u4").tobytes()


_open: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """One for each Python process; it is of the file's size."""
    if path not in _open:
        _open[path] = Vocabulary(path)
    return _open[path]


def public_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
