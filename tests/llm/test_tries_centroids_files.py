"""Prefix trie, centroid clusters and token files against brute force."""

import hashlib
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from colloquy.llm import centroids, prefix_trie, token_files, word_ids
from colloquy.session import scratch_dir

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


# --- centroid clusters --------------------------------------------------------


def clusters_by_hand(rows, k=8, rounds=10, seed=3):
    bound = centroids.LARGEST / centroids.SCALE
    kept = []
    for key, v in rows:
        if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v):
            kept.append((key, [int(np.floor(1024 * min(max(float(x), -bound), bound))) for x in v]))
    digest = lambda key: hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    cents = [v for _, v in sorted(kept, key=lambda r: (digest(r[0]), r[1]))[:k]]

    def assign():
        out = []
        for _, v in kept:
            ds = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in cents]
            out.append((ds.index(min(ds)), min(ds)))
        return out

    for _ in range(rounds):
        at = [a for a, _ in assign()]
        for c in range(len(cents)):
            mine = [v for (_, v), a in zip(kept, at) if a == c]
            if mine:
                cents[c] = [sum(x) // len(mine) for x in zip(*mine)]
    found = assign()
    whole = sum(d for _, d in found)
    per = {c: sum(d for a, d in found if a == c) for c in range(len(cents))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted(
        ((-1 if key is None else key), a, d, per[a], whole, sha[a]) for (key, _), (a, d) in zip(kept, found)
    )


def cluster_rows(df, **kw):
    return sorted(((-1 if r[0] is None else r[0]), *r[1:]) for r in centroids.cluster(df, **kw).collect())


def vector_fixture(n=90):
    r = np.random.default_rng(4)
    rows = [(i, (r.standard_normal(64) * 0.1 + (i % 5)).tolist()) for i in range(n)]
    rows += [(200, rows[0][1]), (200, rows[0][1]), (201, rows[3][1]), (None, rows[4][1])]  # repeats and ties
    rows += [(300, None), (301, []), (302, [0.5] * 63), (303, [0.5] * 65), (304, [0.5] * 63 + [None]),
             (305, [float("nan")] * 64), (306, [float("inf")] + [0.0] * 63), (307, [-0.0] * 64)]
    return rows


def test_clusters_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(centroids, "BLOCK_ROWS", 7)
    rows = vector_fixture()
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumns(
        {"cluster": F.lit(1), "key": F.lit("x"), "v": F.lit("y"), "distance": F.lit(0)}
    )
    assert cluster_rows(df.repartition(5)) == clusters_by_hand(rows)


def test_clusters_of_few_and_of_no_vectors(spark):
    schema = "vec_id bigint, embedding array<float>"
    few = [(i, [float(i)] * 64) for i in range(3)]
    got = cluster_rows(spark.createDataFrame(few, schema))
    assert got == clusters_by_hand(few) and len({r[1] for r in got}) == 3
    none = centroids.cluster(spark.createDataFrame([], schema))
    assert none.count() == 0 and none.columns[:3] == ["vec_id", "cluster", "distance"]


def test_clusters_of_huge_components_stay_longs(spark):
    rows = [(1, [1e300] * 64), (2, [-1e300] * 64), (3, [5e-324] * 64)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    assert cluster_rows(df, k=1) == clusters_by_hand(rows, k=1)


# --- token files --------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 3, 4, 5, 1000])
def test_numbers_round_trip(n):
    r = np.random.default_rng(n)
    numbers = (2 ** (32 * r.random(n))).astype(np.uint32)
    control, data = token_files.pack_numbers(numbers)
    assert len(control) == -(-n // 4)
    assert len(data) == sum(max(1, (int(x).bit_length() + 7) // 8) for x in numbers) + (-n % 4)
    assert (token_files.unpack_numbers(control, data, n) == numbers).all()


def test_numbers_at_the_borders_of_lengths():
    numbers = np.array([0, 255, 256, 65535, 65536, (1 << 24) - 1, 1 << 24, (1 << 32) - 1], np.uint32)
    assert (token_files.unpack_numbers(*token_files.pack_numbers(numbers), len(numbers)) == numbers).all()


def text_fixture():
    r = random.Random(9)
    words = ["The", "don't", "naïve", "ﬁne", "123", "x1y", "<|endoftext|>", "a<|startoftext|>b", "日本", "é", "İ", "Σας", "!!!"]
    make = lambda n: "".join(r.choice(words) + r.choice([" ", "  ", "\n", "\t", " ", " ", "\x1c", "\r\n ", " ́"]) for _ in range(n))
    rows = [(i, make(r.randrange(40))) for i in range(60)]
    rows += [(None, "no id"), (70, None), (71, ""), (72, " \n\t "), (73, "ab" * 30000), (74, make(20000)), (-5, "first")]
    rows += [(80, "same text")] * 30 + [(80, "other text")] * 2
    return rows


def token_rows_by_hand(rows):
    tok = Tokenizer.from_file(WORD_BPE)
    made = [(key, [*tok.encode(text or "", add_special_tokens=False).ids, 2]) for key, text in rows]
    return made


def test_token_files_equal_the_library(spark, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_TOKENS", 500)
    rows = text_fixture()
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4).withColumns(
        {"key": F.lit("k"), "ids": F.lit(1), "shard": F.lit("s"), "tie": F.lit(None).cast("string")}
    )
    path = scratch_dir(spark, "files")
    token_files.write(df, path, WORD_BPE)
    got = token_files.read(spark, path, with_ids=True).collect()
    want = token_rows_by_hand(rows)
    packed = lambda ids: struct.pack(f"<{len(ids)}I", *ids)
    assert sorted(((r.doc_id is not None, r.doc_id or 0), bytes(r.ids)) for r in got) == sorted(
        ((key is not None, key or 0), packed(ids)) for key, ids in want
    )
    start = 0
    for r in sorted(got, key=lambda r: r.start):
        assert (r.start, 4 * r.n_tokens, r.ids_crc32) == (start, len(r.ids), zlib.crc32(r.ids))
        start += r.n_tokens
    keys = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert keys[0] is None and keys[1:] == sorted(keys[1:])
    ranks = spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()
    assert [r.n for r in ranks] == sorted((r.n for r in ranks), reverse=True)
    assert sum(r.n for r in ranks) == start
    # Files hold ascending ranges of ids.
    blocks = spark.read.parquet(f"{path}/blocks").orderBy("shard", "block").collect()
    assert sum(len(b["keys"]) for b in blocks) == len(rows) and len(blocks) > 3


def test_token_files_of_no_documents(spark):
    path = scratch_dir(spark, "files")
    token_files.write(spark.createDataFrame([], "doc_id bigint, text string"), path, WORD_BPE)
    assert token_files.read(spark, path).count() == 0


def test_forgotten_words_are_encoded_again(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(word_ids, "KEPT_WORDS", 3)
    words = word_ids.WordEncoder(WORD_BPE)
    tok = Tokenizer.from_file(WORD_BPE)
    for text in ("one two three four five one", "six two " + "z" * 300, "six " + "z" * 300):
        ids, starts = words.ids(pa.array([text, None]))
        assert ids.tolist() == tok.encode(text, add_special_tokens=False).ids and starts.tolist() == [0, len(ids), len(ids)]


def test_only_tokenizers_that_drop_white_space():
    assert word_ids.drops_white_space(WORD_BPE)
    assert not word_ids.drops_white_space(public_tokenizers.path("byte_bpe_50k.json"))


# --- prefix trie --------------------------------------------------------------


def trie_by_hand(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own.setdefault(c, []).append((turn is not None, turn or 0, digest, role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        first = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        built[c] = tuple(own.get(first, [])[:h] + v[h:])
    members, ends = {}, {}
    for c, v in built.items():
        for d in range(len(v) + 1):
            members.setdefault(v[:d], []).append(c)
        ends.setdefault(v, []).append(c)
    kids = {}
    for path in members:
        if path:
            kids.setdefault(path[:-1], []).append(path)
    totals = {}
    for path in sorted(members, key=len, reverse=True):
        below = [totals[k] for k in kids.get(path, [])]
        own_saved = (len(members[path]) - 1) * (len(path[-1][1]) if path else 0)
        totals[path] = (sum(b[0] for b in below) or 1, own_saved + sum(b[1] for b in below))
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids.get(p, [])), *totals[p],
         hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest())
        for p, m in members.items()
    )


def trie_rows(df, **kw):
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted(tuple(r[n] for n in names) for r in prefix_trie.prefix_trie(df, **kw).collect())


def conversation_fixture():
    r = random.Random(2)
    rows = []
    for c in [*range(0, 40), *range(100, 130), *range(-120, -90), 777, 1005]:
        shared = [("system", "be kind"), ("user", "hello ß😀")]
        turns = shared[: r.randrange(3)] + [(r.choice(["user", "assistant"]), r.choice(["a", "bb", "", "hello"])) for _ in range(r.randrange(5))]
        rows += [(c, k, *t) for k, t in enumerate(turns)]
    rows += [(5, None, "user", "null turn"), (6, 1, None, None), (6, 1, "user", "same number"), (6, 1, "user", "same number")]
    rows += [(None, 0, "user", "nobody"), (31, 0, "", "x"), (32, 0, "x", "")]
    rows += [(2000 + i, k, "user", "the same" * (k + 1)) for i in range(40) for k in range(3)]  # copies
    rows += [(3000, k, "user", str(k)) for k in range(60)]  # one that is long
    r.shuffle(rows)
    return rows


TURNS = "conv_id bigint, turn bigint, role string, text string"


@pytest.mark.parametrize("most", [1, 8, 1 << 14])
def test_trie_equals_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(prefix_trie, "BLOCK_TURNS", 7)
    monkeypatch.setattr(prefix_trie, "DEPTHS_TOGETHER", 5)
    rows = conversation_fixture()
    if most == 1:  # Every node is cut out by a round of its own table.
        rows = [r for r in rows if r[0] in (0, 5, 6, 31, 32, 2000, 2001, None)]
    df = spark.createDataFrame(rows, TURNS).repartition(3).withColumns({"key": F.lit(1), "d": F.lit("d"), "conv": F.lit(0)})
    assert trie_rows(df, most=most) == trie_by_hand(rows)


def test_trie_of_no_conversations(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], TURNS)).count() == 0
    assert prefix_trie.prefix_trie(spark.createDataFrame([(None, 1, "user", "x")], TURNS)).count() == 0


def test_turnless_conversations_are_members_of_the_root(spark):
    # Heads of conversations that are not there: the own turns are all cut off.
    lost = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 == 5)
    rows = [(lost, 0, "user", "gone"), (lost, 1, "user", "gone too")]
    assert trie_rows(spark.createDataFrame(rows, TURNS)) == trie_by_hand(rows) == [
        (lost, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lost).encode()).hexdigest())
    ]


def test_tree_totals_of_deep_and_wide_forests():
    r = np.random.default_rng(3)
    for shape in ("chain", "star", "random", "two chains"):
        n = 3000
        parent = {
            "chain": np.arange(n) - 1, "star": np.where(np.arange(n) > 0, 0, -1),
            "random": np.array([-1, -1, *(r.integers(0, i) for i in range(2, n))]),
            "two chains": np.where(np.arange(n) < 2, -1, np.arange(n) - 2),
        }[shape]
        own, value = r.integers(1, 9, n), r.integers(-5, 9, (2, n))
        depth, weight, want = np.zeros(n, np.int64), own.copy(), value.copy()
        for i in range(n):
            depth[i] = 0 if parent[i] < 0 else depth[parent[i]] + 1
        for i in range(n - 1, -1, -1):
            if parent[i] >= 0:
                weight[parent[i]] += weight[i]
                want[:, parent[i]] += want[:, i]
        mixed = r.permutation(n)
        back = np.argsort(mixed)
        renamed = np.where(parent[mixed] < 0, -1, back[parent[mixed]])
        got = prefix_trie.tree_totals(renamed, depth[mixed], weight[mixed], value[:, mixed])
        assert (got == want[:, mixed]).all(), shape
