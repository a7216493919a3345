"""Encode each different piece of text once.

A single space between two characters that are not white space always starts a
pre-token of the byte-level pattern, so a text may be cut there and its pieces
encoded one by one. Pieces repeat far more often than texts do; their encodings
are kept in a bounded dictionary per Python worker. A space and letters are one
pre-token, so such words that a slice has for the first time need the tokenizer's
model only and are given to it in one call, with line feeds between them.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
from collections.abc import Callable

import numpy as np

#: Pieces kept per worker; beyond it the dictionary starts anew.
KEPT_PIECES = 1 << 20
#: Longer pieces are encoded each time they come, so that memory stays bounded.
LONGEST_KEPT = 200

# A space beside white space; the pattern starts with a plain space, which is quick to find.
_uncut = re.compile(r" (?:(?<=\s )|\s)")
_cut = re.compile(r"(?<=\S)(?= \S)")


_SIGNS = frozenset(".,;:!?")


def word_and_sign(piece: str) -> tuple[str, ...]:
    """A word with one sign after it in two, else the piece."""
    if piece[-1:] in _SIGNS and (piece[1:-1] if piece[:1] == " " else piece[:-1]).isalpha():
        return piece[:-1], piece[-1]
    return (piece,)


class Kept(dict):
    """Encodings by piece; one that is missing is encoded when it is asked for."""

    def __init__(self, encode: Callable[[str], bytes], before: str):
        self.encode, self.before = encode, before

    def __missing__(self, piece: str) -> bytes:
        ids = self.encode(self.before + piece)
        if len(piece) <= LONGEST_KEPT:
            if len(self) >= KEPT_PIECES:
                self.clear()
            self[piece] = ids
        return ids


class PieceCache:
    """``encode`` gives the ids of one piece as little-endian unsigned 32-bit bytes."""

    def __init__(self, encode: Callable[[str], bytes],
                 together: Callable[[set[str]], dict[str, bytes]] | None = None):
        #: Encodes what it can of the new pieces of a slice that start with a space.
        self.together = together
        self.plain = Kept(encode, "")
        #: Pieces that start with a space, without it.
        self.spaced = Kept(encode, " ")

    def ids(self, texts: list[str]) -> list[bytes]:
        if self.together:
            new: set[str] = set()
            for text in texts:
                new.update(text.split(" ")[1:])
            new.difference_update(self.spaced)
            if len(self.spaced) + len(new) <= KEPT_PIECES:
                self.spaced.update(self.together(new))
        return [self._ids(t) for t in texts]

    def _ids(self, text: str) -> bytes:
        if not text:
            return b""
        if text[0] == " " or text[-1] == " " or _uncut.search(text):
            return b"".join(map(self.plain.__getitem__, _cut.split(text)))
        first, *rest = text.split(" ")
        return self.plain[first] + b"".join(map(self.spaced.__getitem__, rest))


#: What byte-level models have for each byte: itself if it is printable.
_PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_SIGNS = {b: b if b in _PRINTED else 256 + sum(x not in _PRINTED for x in range(b)) for b in range(256)}
_space, _line = chr(BYTE_SIGNS[32]), chr(BYTE_SIGNS[10])


#: Letters that every version of Unicode has had, and signs: after a space two pre-tokens.
_letters_and_signs = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([!-/:-@\[-`{-~]*)").fullmatch


def letters_by_model(tok, words: Kept) -> Callable[[set[str]], dict[str, bytes]] | None:
    """Encodings of those of some pieces that are letters, and signs after them, for what stands
    after a space; adds them to ``words``. None if ``tok`` has added tokens that such pieces
    could hold, or no id for a line feed."""
    from tokenizers import Tokenizer, pre_tokenizers

    added = [t.content for t in tok.get_added_tokens_decoder().values()]
    cut = tok.model.token_to_id(_line)
    if cut is None or any(_letters_and_signs(t) or _letters_and_signs(f"a{t}") for t in added):
        return None
    bare = Tokenizer(tok.model)
    bare.pre_tokenizer = pre_tokenizers.Split(_line, "isolated")

    def add(new: list[str], signs: str) -> None:
        ids = np.array(bare.encode_batch_fast([signs], add_special_tokens=False)[0].ids, "<u4")
        ends = 4 * np.flatnonzero(ids == cut)
        if len(ends) == len(new) - 1:
            raw = ids.tobytes()
            parts = map(slice, [0, *(ends + 4).tolist()], [*ends.tolist(), len(raw)])
            words.update(zip(new, map(raw.__getitem__, parts)))

    def together(pieces: set[str]) -> dict[str, bytes]:
        found = [m.groups() for p in pieces if len(p) < LONGEST_KEPT and (m := _letters_and_signs(p))]
        new = list({f" {word}" for word, _ in found}.difference(words))
        if len(words) + len(new) > KEPT_PIECES:
            words.clear()
            new = list({f" {word}" for word, _ in found})
        plain, other = [x for x in new if x.isascii()], [x for x in new if not x.isascii()]
        if plain:
            add(plain, "\n".join(plain).replace(" ", _space).replace("\n", _line))
        if other:
            add(other, "\n".join(other).encode().decode("latin-1").translate(BYTE_SIGNS))
        return {word + signs: words[f" {word}"] + (words[signs] if signs else b"") for word, signs in found}

    return together


_caches: dict[str, PieceCache] = {}


def tokenizer_cache(path: str) -> PieceCache:
    """Pieces by a tokenizers file, special strings as its default; one per worker."""
    if path not in _caches:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()

        pack = struct.pack

        def library(piece: str) -> bytes:
            ids = tok.encode_batch_fast([piece], add_special_tokens=False)[0].ids
            return pack(f"<{len(ids)}I", *ids)

        words = Kept(library, "")
        together = letters_by_model(tok, words) if cuts_at_spaces(path) else None
        encode = lambda piece: b"".join([words[t] for t in word_and_sign(piece)])
        _caches[path] = PieceCache(encode, together)
    return _caches[path]


def file_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def cuts_at_spaces(path: str) -> bool:
    """Whether this tokenizers file is the byte-level kind that may be cut."""
    import json

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    before = spec.get("pre_tokenizer") or {}
    return (
        spec.get("normalizer") is None
        and before.get("type") == "ByteLevel"
        and before.get("use_regex", True)
        and not before.get("add_prefix_space", True)
        and not any(" " in t["content"] or t.get("lstrip") or t.get("rstrip") or t.get("single_word")
                    for t in spec.get("added_tokens", []))
    )
