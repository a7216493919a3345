"""Token ids of whole slices of texts: split by Arrow, different words encoded together.

For tokenizers whose tokens never reach over white space and that drop it, so that the
ids of a text are those of its words, one after the other.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words kept per worker; beyond it the dictionary starts anew.
KEPT_WORDS = 1 << 20
#: Longer words are encoded each time they come, so that memory stays bounded.
LONGEST_KEPT = 200
SIGNS = [".", ",", ";", ":", "!", "?"]


def _normalizers(path: str) -> list[dict]:
    with open(path, encoding="utf-8") as f:
        norm = json.load(f).get("normalizer") or {"type": "Sequence", "normalizers": []}
    return norm.get("normalizers", [norm])


def drops_white_space(path: str) -> bool:
    """Whether this tokenizers file splits at white space, drops it, and has a normaliser
    that looks at single characters only (beside composing them and joining white space)."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    plain = all(
        n["type"] in ("NFC", "Lowercase") or (n["type"], n.get("content"), (n.get("pattern") or {}).get("Regex"))
        == ("Replace", " ", r"\s+")
        for n in _normalizers(path)
    )
    first = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
    pattern = (first.get("pattern") or {}).get("Regex", "")
    # Kept are the matches; what stands for any other sign excludes white space.
    splits = first.get("type") == "Split" and first.get("invert") and first.get("behavior") == "Removed"
    solid = r"[^\s" in pattern and " " not in pattern and r"\s" not in pattern.replace(r"[^\s", "")
    added = any(
        any(c.isspace() for c in t["content"]) or t["lstrip"] or t["rstrip"] or t["single_word"]
        for t in spec.get("added_tokens", [])
    )
    return bool(plain and splits and solid and not added and spec.get("post_processor") is None)


def vocabulary_size(path: str) -> int:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    return 1 + max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec.get("added_tokens", []))])


def gathered(flat: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces ``codes`` of ``flat``, one after the other, and where each ends; ``sizes`` are
    those of the pieces in ``flat``."""
    begins = np.cumsum(sizes) - sizes
    counts = sizes[codes]
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    whole = np.int32 if max(total, len(flat)) < 1 << 31 else np.int64
    where = np.repeat((begins[codes] - (ends - counts)).astype(whole), counts)
    where += np.arange(total, dtype=whole)
    return flat[where], ends


class WordEncoder:
    """Ids by word. A word of letters and one sign after it is two pieces for the tokenizer,
    and case makes no difference to it; so the letters, in lower case, are looked up and kept
    for all such words. What is new in a slice goes to the library in one call."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.width = np.dtype("<u2" if vocabulary_size(path) <= 1 << 16 else "<u4")
        self.lower = any(n["type"] == "Lowercase" for n in _normalizers(path))
        self.kept: dict[str, bytes] = {}
        self.signs = [self._one_by_one([s])[0] for s in SIGNS]
        #: One id that words without this sign never give, to stand between them.
        self.between = next((s for s, ids in zip(SIGNS, self.signs) if len(ids) == self.width.itemsize), None)
        # Lower-case ASCII letters are neither normalised nor split: the model alone will do.
        self.bare = Tokenizer(self.tok.model)
        self.bare.pre_tokenizer = pre_tokenizers.Split(" ", "removed")

    def _one_by_one(self, words: list[str]) -> list[bytes]:
        made = self.tok.encode_batch_fast(words, add_special_tokens=False)
        return [np.array(e.ids, self.width).tobytes() for e in made]

    def _together(self, words: list[str], tok) -> list[bytes]:
        """Words without the sign ``between``, as one text with that sign after each."""
        if self.between is None or not words:
            return self._one_by_one(words)
        text = f" {self.between} ".join(words)
        ids = np.array(tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.width)
        cut = np.flatnonzero(ids == np.frombuffer(self.signs[SIGNS.index(self.between)], self.width)[0])
        if len(cut) != len(words) - 1:
            return self._one_by_one(words)
        size = self.width.itemsize
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip([0, *((cut + 1) * size).tolist()], [*(cut * size).tolist(), len(raw)])]

    def _pieces(self, pieces: list[str], letters: np.ndarray) -> list[bytes]:
        kept = self.kept
        found = list(map(kept.get, pieces))
        new = [i for i, ids in enumerate(found) if ids is None]
        if not new:
            return found
        if len(kept) + len(new) > KEPT_WORDS:
            kept.clear()
        plain = [i for i in new if letters[i] and pieces[i].isascii() and pieces[i].islower()]
        bare = set(plain)
        rest = [i for i in new if i not in bare]
        solid = [i for i in rest if self.between and self.between not in pieces[i]]
        single = [i for i in rest if not self.between or self.between in pieces[i]]
        for part, encode in (
            (plain, lambda w: self._together(w, self.bare)), (solid, lambda w: self._together(w, self.tok)),
            (single, self._one_by_one),
        ):
            words = [pieces[i] for i in part]
            made = encode(words)
            kept.update(zip(words, made))
            for i, word, ids in zip(part, words, made):
                found[i] = ids
                if len(word) > LONGEST_KEPT:
                    del kept[word]
        return found

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's start; one more than there are texts).
        A null text has none."""
        texts = pc.replace_substring(pc.fill_null(texts, ""), "\n", " ")
        lists = pc.split_pattern(texts, " ")
        cells = pc.dictionary_encode(lists.flatten())
        words = cells.dictionary
        sign = pc.fill_null(pc.index_in(pc.utf8_slice_codeunits(words, -1), pa.array(SIGNS)), len(SIGNS))
        core = pc.if_else(pc.less(sign, len(SIGNS)), pc.utf8_slice_codeunits(words, 0, -1), words)
        letters = pc.utf8_is_alpha(core)
        core = pc.if_else(letters, pc.ascii_lower(core) if self.lower else core, words)
        pieces = pc.dictionary_encode(core)
        kinds = pc.utf8_is_alpha(pieces.dictionary).to_numpy(zero_copy_only=False)
        known = [*self._pieces(pieces.dictionary.to_pylist(), kinds), *self.signs, b""]
        flat = np.frombuffer(b"".join(known), self.width)
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // self.width.itemsize
        # Each word is its piece and its sign, which may be none.
        after = np.where(letters.to_numpy(zero_copy_only=False), sign.to_numpy(zero_copy_only=False), len(SIGNS))
        both = np.stack([pieces.indices.to_numpy(zero_copy_only=False), after + len(pieces.dictionary)], 1).ravel()
        flat, ends = gathered(flat, sizes, both)
        ids, ends = gathered(flat, np.diff(ends[1::2], prepend=0), cells.indices.to_numpy(zero_copy_only=False))
        offsets = lists.offsets.to_numpy(zero_copy_only=False)
        return ids, np.concatenate([[0], ends])[offsets - offsets[0]]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One per Python worker."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
