"""Token counters for the budget fit.

A counter is a function from text to its number of tokens. It may say more about itself:

* ``max_chars_per_token``: the longest text one token stands for;
* ``joins(left, right)``: the tokens that a newline between these two lines adds to the
  counts of what stands before and after it, whatever stands further away; None where
  that cannot be said. With it a fit counts each line once.
"""

from __future__ import annotations

import string
from collections.abc import Callable

_SOLID = frozenset(string.ascii_letters + string.digits + string.punctuation)
_LETTERS = frozenset(string.ascii_letters)
_SPLITS_WORDS = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}


def tokenizer_counter(path: str) -> Callable[[str], int]:
    """The counter of a tokenizer file (JSON of the tokenizers library), special tokens not
    added. Byte-level tokenizers that split texts into words, letters and blanks apart, also
    say how lines join: a newline between a visible character and a letter is a piece of its
    own there. Others are counted text by text."""
    import json

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()

    def count(text: str) -> int:
        return len(tokenizer.encode(text, add_special_tokens=False).ids)

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    before = spec["pre_tokenizer"] or {}
    by_bytes = spec["normalizer"] is None and all(before.get(k) == v for k, v in _SPLITS_WORDS.items())
    plain = not any(
        t["lstrip"] or t["rstrip"] or t["single_word"] or "\n" in t["content"] for t in spec["added_tokens"]
    )
    if by_bytes and plain:
        # One letter of a byte-level token is one byte, so at most one character.
        count.max_chars_per_token = max(map(len, tokenizer.get_vocab(with_added_tokens=True)))
        newline = count("\n")

        def joins(left: str, right: str) -> int | None:
            apart = left[-1:] in _SOLID and right[:1] in _LETTERS
            return newline if apart else None

        count.joins = joins
    return count


def tokenizer_encoder(path: str) -> Callable[[str], tuple[list[int], list[int]]]:
    """Ids and where each token starts, by the same file, and for tokenizers whose joints
    are known ``cuts(left, right)``: True after a line's end that follows a visible character,
    where a visible character follows."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()

    def encode(text: str) -> tuple[list[int], list[int]]:
        e = tokenizer.encode(text, add_special_tokens=False)
        return e.ids, [start for start, _ in e.offsets]

    if hasattr(tokenizer_counter(path), "joins"):
        encode.cuts = lambda left, right: (
            left[-1:] == "\n" and left[-2:-1] in _SOLID and right[:1] in _SOLID
        )
    return encode


class LineCounts:
    """Counts of parts of one conversation, each line counted once where ``count`` says how
    lines join; lines whose joint is unknown are counted together.

    ``lines`` are the last lines of the conversation, ``lead`` a line that may be put before
    any of them.
    """

    def __init__(self, count: Callable[[str], int], lines: list[str], lead: str | None = None):
        self.count, self.lines, self.lead = count, lines, lead
        self.joins = getattr(count, "joins", lambda left, right: None)
        n = len(lines)
        self.after = [None] * n  # tokens the newline after a line adds
        for i in range(n - 1):
            self.after[i] = self.joins(lines[i], lines[i + 1])
        #: For each line the end of the lines that are counted together with it.
        self.end = [n] * n
        for i in range(n - 2, -1, -1):
            self.end[i] = self.end[i + 1] if self.after[i] is None else i + 1
        self.tails: dict[int, int] = {}
        self._lead_count: int | None = None

    def _tail(self, start: int) -> int:
        """Tokens of the lines from ``start`` on; what follows is counted before, the last first."""
        todo = []
        while start < len(self.lines) and start not in self.tails:
            todo.append(start)
            start = self.end[start]
        for s in reversed(todo):
            e = self.end[s]
            own = self.count("\n".join(self.lines[s:e]))
            self.tails[s] = own + (self.after[e - 1] + self.tails[e] if e < len(self.lines) else 0)
        return self.tails[todo[0] if todo else start]

    def of(self, start: int) -> int:
        """Tokens of the lead and the lines from ``start`` on."""
        if self.lead is None:
            return self._tail(start)
        joint = self.joins(self.lead, self.lines[start])
        if joint is not None:
            if self._lead_count is None:
                self._lead_count = self.count(self.lead)
            return self._lead_count + joint + self._tail(start)
        e = self.end[start]
        own = self.count("\n".join([self.lead, *self.lines[start:e]]))
        return own + (self.after[e - 1] + self._tail(e) if e < len(self.lines) else 0)
