"""Operator 7: byte-level BPE by a rank queue over hierarchical bitmaps.

Each pre-token is a linked list of byte positions. Every merge rank that occurs has
a bucket of the positions whose pair has that rank; 64-bit words tell
which buckets hold anything and a summary which words do, and find-first-set on the two
levels gives the next rank. A
merge changes at most two neighbouring pairs; entries of pairs that are gone are
skipped when they come up. The work for a pre-token of n bytes is O(n) queue steps,
however long it is.

Null texts count as empty. Repeated rows are encoded again, in the same way; extra
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from colloquy.llm import texts
from colloquy.llm.chunks import Kept, PieceCache

#: Ranks of joined ids kept per worker.
KEPT_PAIRS = 1 << 18

_BIT = [1 << i for i in range(64)]
_SIGNS = frozenset(".,;:!?")


def encode_pretoken(data: bytes, ranks: dict[bytes, int], single: list[int],
                    pairs: dict[tuple[int, int], int]) -> list[int]:
    """Ids of one pre-token. ``single``: id by byte; ``pairs`` remembers the rank of two
    joined ids (-1: none)."""
    whole = ranks.get(data)
    if whole is not None:
        return [whole]
    n = len(data)
    ids = [single[b] for b in data]
    if n < 3:
        return ids
    after, before, ends = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    # Buckets of positions by rank; a bitmap word per 64 ranks; a summary bit per word.
    buckets: dict[int, list[int]] = {}
    words: dict[int, int] = {}
    summary = 0
    get = pairs.get
    pair_rank = [get(k) for k in zip(ids, ids[1:])]
    todo = list(enumerate(pair_rank))
    pair_rank.append(-1)
    while True:
        for i, r in todo:
            if r is None:
                j = after[i]
                r = ranks.get(data[i : ends[j]], -1)
                if len(pairs) < KEPT_PAIRS:
                    pairs[ids[i], ids[j]] = r
            pair_rank[i] = r
            if r < 0:
                continue
            if r in buckets:
                buckets[r].append(i)
            else:
                buckets[r] = [i]
                word = r >> 6
                if word in words:
                    words[word] |= _BIT[r & 63]
                else:
                    words[word] = _BIT[r & 63]
                    summary |= 1 << word
        if not summary:
            return [x for x in ids if x >= 0]
        word = (summary & -summary).bit_length() - 1
        bits = words[word]
        rank = word << 6 | (bits & -bits).bit_length() - 1
        bits &= bits - 1
        if bits:
            words[word] = bits
        else:
            del words[word]
            summary ^= 1 << word
        positions = buckets.pop(rank)
        if len(positions) > 1:
            positions.sort()
        changed = []
        for i in positions:
            # Stale: merged away, at the end, or another pair by now.
            if ids[i] < 0 or pair_rank[i] != rank:
                continue
            j = after[i]
            ids[i], ends[i] = rank, ends[j]
            ids[j] = pair_rank[j] = -1
            k = after[i] = after[j]
            pair_rank[i] = -1
            if k < n:
                before[k] = i
                changed.append(i)
            h = before[i]
            if h >= 0:
                pair_rank[h] = -1
                changed.append(h)
        todo = [(i, get((ids[i], ids[after[i]]))) for i in changed]


def split_piece(piece: str, split: regex.Pattern) -> list[str]:
    """The piece's pre-tokens; a word with or without a sign after it needs no search."""
    word = piece[1:] if piece[:1] == " " else piece
    if word.isalpha():
        return [piece]
    if word[-1:] in _SIGNS and word[:-1].isalpha():
        return [piece[:-1], piece[-1]]
    return [m[0] for m in split.finditer(piece)]


@lru_cache(maxsize=4)
def coder(path: str, pattern: str) -> tuple[PieceCache, np.ndarray, np.ndarray]:
    """Per worker: the piece cache, and every id's bytes as (offsets, bytes)."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
    # White space as tiktoken's \\s has it: U+001C to U+001F are none.
    split = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
    pairs: dict[tuple[int, int], int] = {}
    single = [ranks[bytes([b])] for b in range(256)]

    def pretoken(t: str) -> bytes:
        ids = encode_pretoken(t.encode(), ranks, single, pairs)
        return struct.pack(f"<{len(ids)}I", *ids)

    known = Kept(pretoken, "")
    encode = lambda piece: b"".join([known[t] for t in split_piece(piece, split)])
    by_id = [b""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        by_id[i] = token
    offsets = np.zeros(len(by_id) + 1, np.int32)
    np.cumsum([len(x) for x in by_id], out=offsets[1:])
    return PieceCache(encode), offsets, np.frombuffer(b"".join(by_id), np.uint8)


def decode(ids: bytes, offsets: np.ndarray, data: np.ndarray) -> bytes:
    """The bytes of little-endian unsigned 32-bit ids."""
    tokens = pa.BinaryArray.from_buffers(
        pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)]
    )
    taken = tokens.take(pa.array(np.frombuffer(ids, "<u4")))
    lo, hi = np.frombuffer(taken.buffers()[1], np.int32)[[taken.offset, taken.offset + len(taken)]]
    return taken.buffers()[2].to_pybytes()[lo:hi] if len(taken) else b""


def encode_decode(df: DataFrame, ranks_path: str, pattern: str, id_column: str = "doc_id",
                  text_column: str = "text", with_ids: bool = False) -> DataFrame:
    """Per row: id, n_tokens, digests of ids and decoded bytes; ids if asked for."""
    id_type = df.schema[id_column].dataType.simpleString()
    more = ", ids array<int>" if with_ids else ""

    def make(batch: pa.RecordBatch) -> dict:
        cache, offsets, data = coder(ranks_path, pattern)
        ids = cache.ids(texts.strings(batch, text_column))
        out = {
            id_column: batch.column(id_column),
            "n_tokens": [len(x) >> 2 for x in ids],
            "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
            "decoded_sha256": [hashlib.sha256(decode(x, offsets, data)).hexdigest() for x in ids],
        }
        return out | ({"ids": [np.frombuffer(x, "<i4") for x in ids]} if with_ids else {})

    return texts.map_slices(
        df.select(id_column, text_column), text_column, make,
        f"`{id_column}` {id_type}, n_tokens bigint, ids_sha256 string, decoded_sha256 string{more}",
    )


def op7_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_decode(
        texts.documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN,
    )
