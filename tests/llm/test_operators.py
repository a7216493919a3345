"""Small fixtures against brute force: nulls, empty and long texts, ties, repeated rows,
empty tables and extra columns whose names clash."""

import base64
import hashlib
import random
import struct
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from colloquy.llm import (
    chunks, jaccard_join, licenses, multi_index, packing, quality_cascade, rank_queue_bpe, suffix_dedup, token_counts,
    toxicity, url_templates,
)
from colloquy.llm.components import components
from colloquy.session import scratch_dir

BPE = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = ["the", "anea", "on", "thion", "ered", "ing", "ß", "niño", "a1", "x"]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", ".", ","]) for _ in range(n))


def fixture():
    base = prose(1, 120)
    rows = [(i, prose(100 + i, 60)) for i in range(12)]
    rows += [(20, base), (21, base), (22, base + " more words"), (23, base.upper()), (24, prose(7, 40) + base)]
    rows += [(30, None), (31, ""), (32, " \n\t "), (33, "one two"), (34, "one two"), (35, "ONE two")]
    rows += [(40, "ab" * 4000), (41, prose(3, 6000)), (42, "same line\n" * 40), (43, "<|endoftext|> x  y z\x1c")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(fixture(), "doc_id bigint, text string").withColumns({
        "id": F.lit(1), "cls": F.lit("c"), "n_words": F.lit(2), "kept": F.lit("k"), "score": F.lit(None).cast("double"),
        "rest": F.lit("r"), "col": F.lit(0),
    })


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], "doc_id bigint, text string")


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_quality_rules(docs, nothing):
    got = by_id(quality_cascade.judge(docs))
    for i, text in fixture():
        words = (text or "").encode().split()
        lines = [x for x in (text or "").split("\n") if x.encode().strip()]
        grams = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
        twice = {g for g in grams if grams.count(g) > 1} if len(grams) < 500 else None
        r = got[i]
        assert (r.n_words, r.n_dup_lines) == (len(words), len(lines) - len(set(lines)))
        assert r.word_chars == sum(len(w.decode()) for w in words)
        if twice is not None:
            at = {k + j for k, g in enumerate(grams) if g in twice for j in range(8)}
            assert r.n_repeat_words == len(at)
            assert r.base_failed == (len(words) < 20 or 100 * len(at) > 30 * len(words))
    assert got[30].base_failed and not got[30].kept and got[0].kept
    assert quality_cascade.judge(nothing).count() == 0


def test_rule_order_prefers_rejections_per_cost(docs):
    import time

    rules = {"slow": lambda d: bool(time.sleep(0.002)) or d.n_words > 50, "quick": lambda d: d.n_words > 50}
    assert quality_cascade.rule_order(docs, rules=rules) == ["quick", "slow"]


def test_near_vectors(spark):
    r = np.random.default_rng(0)
    v = r.standard_normal((60, 6))
    v[10:20] = v[0] + 0.02 * r.standard_normal((10, 6))
    v[30] = v[31] * 3
    v[40] = v[41]
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    rows += [(100, None), (101, [0.0] * 6), (102, [float("nan")] * 6), (103, [1.0, None, 1.0, 1.0, 1.0, 1.0]),
             (104, []), (105, [1.0, 2.0]), (106, [2.0, 4.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("key", F.lit("clash"))
    got = by_id(multi_index.near_duplicates(df), "vec_id")
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    near = unit @ unit.T >= 0.95
    label = np.arange(60)
    for _ in range(60):
        label = np.array([label[near[i]].min() for i in range(60)])
    for i in range(60):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (near[i].sum() - 1, label[i], label[i] == i)
    assert all(got[i].n_links == 0 and got[i].kept for i in (100, 101, 102, 103, 104))
    assert (got[105].n_links, got[106].component_id) == (1, 105)
    assert multi_index.near_duplicates(df.limit(0)).count() == 0


def test_calibration_reaches_recall():
    r = np.random.default_rng(1)
    x = r.standard_normal((600, 8))
    x = np.concatenate([x, x + 0.05 * r.standard_normal(x.shape)])
    x /= np.linalg.norm(x, axis=1)[:, None]
    books = (multi_index.kmeans(x[:, :4], 8), multi_index.kmeans(x[:, 4:], 8))
    visits, recall = multi_index.cells_needed(x, books, 0.95, 0.99)
    assert recall >= 0.99 and visits <= 64
    d = multi_index.half_distances(x[:, :4], books[0])[:, :, None] + multi_index.half_distances(x[:, 4:], books[1])[:, None]
    near = multi_index.nearest_cells(x, books, 5)
    assert np.allclose(np.take_along_axis(d.reshape(len(x), -1), near, 1), np.sort(d.reshape(len(x), -1), 1)[:, :5])


def test_few_pairs_just_above_the_threshold_are_linked(spark):
    r = np.random.default_rng(3)
    x = r.standard_normal((30_000, 24))
    x /= np.linalg.norm(x, axis=1)[:, None]
    away = r.standard_normal((500, 24))
    away -= (away * x[:500]).sum(1)[:, None] * x[:500]
    away /= np.linalg.norm(away, axis=1)[:, None]
    x = np.concatenate([x, 0.951 * x[:500] + (1 - 0.951 ** 2) ** 0.5 * away])
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(x)), "embedding": list(x)}))
    got = by_id(multi_index.near_duplicates(df), "vec_id")
    pairs = {i for i in range(500) if got[i].n_links}
    assert len(pairs) >= 498 and all(got[30_000 + i].component_id == i for i in pairs)
    assert sum(g.n_links for g in got.values()) == 2 * len(pairs)


def test_gradients():
    net = toxicity.Network(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    ids = np.array([[1, 2, 3, 0], [2, 2, 1, 3]])
    x = np.random.default_rng(0).standard_normal((4, 2 * toxicity.EMBEDDING))
    x[0] = 0
    y = np.array([1.0, 0.0])
    g, _ = net.gradients(x, ids, y)
    for name in ("out", "attend", "attend_v", "h_f", "h_b", "x_b", "hb_f"):
        v = net.p[name].reshape(-1)
        i, e = len(v) // 2, 1e-3
        v[i] += e
        up = net.gradients(x, ids, y)[1]
        v[i] -= 2 * e
        down = net.gradients(x, ids, y)[1]
        v[i] += e
        assert abs(g[name].reshape(-1)[i] - (up - down) / 2 / e) < 1e-4


def test_toxicity(spark, nothing):
    r = random.Random(0)
    rows = []
    for i in range(400):
        words = prose(i, r.randint(5, 150)).split()
        if i % 4 == 0:
            words.insert(r.randrange(len(words)), r.choice(["villain", "rotter"]))
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    rows += [(900, None, 1), (901, "", 0), (902, "...", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int").withColumn("held_out", F.lit(5))
    net = toxicity.fit(df, df)
    got = by_id(toxicity.score_documents(df.select("doc_id", "text", "held_out"), net))
    held = [x for x in rows[:400] if zlib.crc32(str(x[0]).encode()) % 3 == 1]
    assert len(held) > 100 and all(got[i].held_out for i, _, _ in held)
    assert sum(got[i].predicted == y for i, _, y in held) >= 0.95 * len(held)
    assert got[900].score == got[901].score == got[902].score == 0
    assert toxicity.fit(nothing, spark.createDataFrame([], "doc_id bigint, toxic int")) is None
    assert toxicity.score_documents(nothing, None).count() == 0


def test_all_windows_are_scored():
    assert toxicity.windows_of(0).tolist() == []
    for n in range(1, 200):
        starts = toxicity.windows_of(n)
        assert starts[0] == 0 and starts[-1] + toxicity.WINDOW >= n and set(np.diff(starts)) <= {toxicity.STRIDE}


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


@pytest.mark.parametrize("frequent", [True, False])
def test_jaccard(spark, docs, nothing, frequent, monkeypatch):
    if not frequent:
        monkeypatch.setattr(jaccard_join, "FREQUENT_COLUMNS", 1)
        monkeypatch.setattr(jaccard_join, "BLOCK_ENTRIES", 500)
    r = random.Random(2)
    rows = fixture()
    for i in range(60):  # chains of edited copies
        words = prose(500 + i // 6, 80).split()
        for _ in range(r.randint(0, 5)):
            words[r.randrange(80)] = f"edit{r.randint(0, 9)}"
        rows.append((200 + i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("cls", F.lit("x"))
    got = by_id(jaccard_join.similar_components(df))
    sets = {i: shingles(t) for i, t in rows}
    label = {i: i for i in sets}
    for _ in range(30):
        for i, a in sets.items():
            for j, b in sets.items():
                if a and b and 100 * len(a & b) >= 75 * len(a | b):
                    label[i] = min(label[i], label[j])
    assert {i: (x.n_shingles, x.component_id) for i, x in got.items()} == {i: (len(sets[i]), label[i]) for i in sets}
    assert jaccard_join.similar_components(nothing).count() == 0


def test_whole_sets_are_fetched_of_near_copies_only(spark, monkeypatch):
    """Signatures tell texts apart that only share passages."""
    monkeypatch.setattr(jaccard_join, "FREQUENT_COLUMNS", 1)  # as in tables with too many to be known
    r = random.Random(7)
    words = prose(700, 240).split()
    rows = []
    for i in range(120):  # a fifteenth of the shingles of a copy differ from the text's
        copy = list(words)
        for k in range(3):
            copy[r.randrange(240)] = f"edit{i}x{k}"
        rows.append((i, " ".join(copy)))
    for i in range(240):
        rows.append((1000 + i, " ".join([*words[i % 120 : i % 120 + 120], *(f"own{i}x{k}" for k in range(120))])))
    written, write = {}, jaccard_join.materialize

    def counted(df, label):
        made = write(df, label)
        written.setdefault(label, []).append(made)
        return made

    monkeypatch.setattr(jaccard_join, "materialize", counted)
    got = by_id(jaccard_join.similar_components(spark.createDataFrame(rows, "doc_id bigint, text string")))
    assert {x.component_id for i, x in got.items() if i < 1000} == {0}
    assert all(x.component_id == i for i, x in got.items() if i >= 1000)
    assert sum(x.count() for x in written["needed"]) <= 120


def test_components(spark):
    r = random.Random(5)
    links = [(i, i + 1) for i in range(0, 40)] + [(r.randint(100, 160), r.randint(100, 160)) for _ in range(50)]
    got = {x.id: x.component for x in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    label = {x: x for p in links for x in p if p[0] != p[1]}
    for _ in range(60):
        for a, b in links:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    assert got == label


def test_licences(docs):
    got = by_id(licenses.scan_documents(docs))
    assert all(x.n_matches == 0 and x.licences == "" for x in got.values())
    known = {licenses.normalise(s): n for n, s in licenses.SENTENCES.items()}
    first = frozenset(s.split()[0] for s in known)
    s = licenses.SENTENCES
    text = (f"Intro.\n{s['mit-title']}\nCopyright someone.\n{s['mit-condition']}.\n{s['as-is']}.\n"
            f"Other\n{s['apache2-notice']}.\n{s['as-is']}. {s['cc-by-nc4-notice']}.")
    assert licenses.scan(text, known, first)[0] == ["MIT", "Apache-2.0", "CC-BY-NC-4.0"]
    far = f"{s['mit-condition']}.\n" + "no\n" * 6 + f"{s['as-is']}."
    assert licenses.scan(far, known, first)[0] == []


APACHE_HEADER = """
# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
"""
ASF_HEADER = """/*
 * Licensed to the Apache Software Foundation (ASF) under one or more
 * contributor license agreements.  See the NOTICE file distributed with
 * this work for additional information regarding copyright ownership.
 * The ASF licenses this file to You under the Apache License, Version 2.0
 * (the "License"); you may not use this file except in compliance with
 * the License.  You may obtain a copy of the License at
 */"""
MIT_TEXT = """MIT License

Copyright (c) 2020 Somebody Else

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
"""
GPL_HEADER = """ * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
"""


def test_licences_wrapped_over_lines(spark):
    mit = MIT_TEXT.replace("MIT License\n", "The MIT License (MIT)\n").replace("\n", "\r\n")
    rows = [APACHE_HEADER, ASF_HEADER, MIT_TEXT, mit, GPL_HEADER, MIT_TEXT.replace("MIT License\n", ""),
            "Copyright 2001 X.\nAll rights reserved.\nMore", "-" * 70 + " Licensed under CC BY 4.0", "no dot\nReleased under\nthe MIT License\nno dot",
            "Released under\n\nthe MIT License", "Released under. The MIT License", GPL_HEADER + MIT_TEXT]
    got = by_id(licenses.scan_documents(spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")))
    want = ["Apache-2.0", "Apache-2.0", "MIT", "MIT", "GPL-3.0-or-later", "MIT", "All-Rights-Reserved", "CC-BY-4.0", "MIT", "", "", "GPL-3.0-or-later,MIT"]
    assert [got[i].licences for i in range(len(rows))] == want
    assert [got[i].n_matches for i in (0, 1, 2, 4, 11)] == [1, 1, 1, 1, 2]
    assert [got[i].first_sentence for i in (0, 2, 6, 8)] == [0, 0, 1, 1]
    known = licenses.known_sentences()
    first = frozenset(s.split()[0] for s in known)
    for text in (APACHE_HEADER, MIT_TEXT, GPL_HEADER):
        marks = [name for *_, name in licenses.marked(text, known, first, licenses.beginnings(known))]
        assert len(marks) == {APACHE_HEADER: 3, MIT_TEXT: 4, GPL_HEADER: 2}[text]


def test_packing(docs, nothing):
    tok = Tokenizer.from_file(BPE)
    rows = packing.pack_documents(docs, BPE, capacity=64).collect()
    ids = {i: tok.encode(t or "", add_special_tokens=False).ids + [2] for i, t in fixture()}
    at = dict.fromkeys(ids, 0)
    for r in sorted(rows, key=lambda r: (r.doc_id, r.piece)):
        mine = ids[r.doc_id][r.start : r.start + r.length]
        assert r.start == at[r.doc_id] and r.length <= 64 and (r.piece == 0 or r.length == 64)
        assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(mine)}I", *mine))
        at[r.doc_id] += r.length
    assert at == {i: len(x) for i, x in ids.items()}
    places = {}
    for r in sorted(rows, key=lambda r: r.offset):
        assert places.get(r.sequence_id, 0) == r.offset
        places[r.sequence_id] = r.offset + r.length
    assert max(places.values()) <= 64
    assert packing.pack_documents(nothing, BPE).count() == 0


def test_plan_uses_every_piece_once():
    r = random.Random(3)
    for _ in range(30):
        counts = {r.randint(1, 100): r.randint(1, 30) for _ in range(r.randint(1, 40))}
        used = {}
        plan = packing.pack_lengths(counts, 100)
        for lengths, times in plan:
            assert sum(lengths) <= 100 and times > 0
            for x in lengths:
                used[x] = used.get(x, 0) + times
        assert used == counts
    assert sum(t for _, t in packing.pack_lengths({70: 5, 20: 5, 10: 5}, 100)) == 5
    assert sum(t for _, t in packing.pack_lengths({40: 2, 30: 2, 25: 1, 35: 1}, 100)) == 2


def library():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe(docs, nothing):
    lib, got = library(), by_id(rank_queue_bpe.encode_decode(docs, RANKS, public_tokenizers.PATTERN, with_ids=True))
    for i, text in fixture():
        want = lib.encode_ordinary(text or "")
        assert got[i].ids == want and got[i].n_tokens == len(want)
        assert got[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert rank_queue_bpe.encode_decode(nothing, RANKS, public_tokenizers.PATTERN).count() == 0


def test_pieces_encode_as_the_whole():
    lib, tok = library(), Tokenizer.from_file(BPE)
    ours = rank_queue_bpe.coder(RANKS, public_tokenizers.PATTERN)[0]
    theirs = packing.tokenizer_cache(BPE)
    parts = ["a", "b", " ", "  ", "\n", " \n", "the", "'s", "é", "1", "22", "!!", ".", " ,", "\x1c", "\x0b", "😀", " ",
             "<|endoftext|>", "A"]
    r = random.Random(4)
    for _ in range(600):
        x = "".join(r.choice(parts) for _ in range(r.randint(0, 30)))
        for cache, ids in ((ours, lib.encode_ordinary(x)), (theirs, tok.encode(x, add_special_tokens=False).ids)):
            assert cache.ids([x])[0] == struct.pack(f"<{len(ids)}I", *ids), repr(x)


def test_new_words_of_a_slice_are_encoded_in_few_calls(monkeypatch):
    tok, calls = Tokenizer.from_file(BPE), []
    monkeypatch.setattr(chunks, "_caches", {})
    kept = packing.tokenizer_cache(BPE)
    missing = chunks.Kept.__missing__
    monkeypatch.setattr(chunks.Kept, "__missing__", lambda self, piece: calls.append(piece) or missing(self, piece))
    r = random.Random(6)
    letters = "abcxyzABZéßñ\u00d8\u024fĊĠ"
    word = lambda: "".join(r.choices(letters, k=r.randint(1, 9))) + r.choice(["", "", "", ".", "!?", "'", "$$$", "_"])
    rows = [" ".join(["start", *(word() for _ in range(200))]) for _ in range(20)]
    rows += ["it's a<|endoftext|> b <|endoftext|>c don't x1 \u01c5 ²a ａ ", "a b", "a  b c", ""]
    want = [tok.encode(x, add_special_tokens=False).ids for x in rows]
    assert kept.ids(rows) == [struct.pack(f"<{len(x)}I", *x) for x in want]
    assert len(calls) < 60


def test_token_counts_use_the_cache(spark, docs, nothing, monkeypatch):
    tok, cache = Tokenizer.from_file(BPE), scratch_dir(spark, "cache")
    want = {i: (len((t or "").encode()), n := len(tok.encode(t or "", add_special_tokens=False).ids), n > 50) for i, t in fixture()}
    for _ in range(2):
        got = by_id(token_counts.cached_counts(docs, BPE, cache, 50))
        assert {i: (x.n_bytes, x.n_tokens, x.over_limit) for i, x in got.items()} == want
    stored = spark.read.parquet(cache)
    assert stored.count() == stored.select("digest").distinct().count() == len({t or "" for _, t in fixture()})
    other = public_tokenizers.path("piece_bpe_32k.model")
    assert token_counts.cached_counts(docs, other, cache, 50).where("n_tokens IS NULL").count() == 0
    assert token_counts.cached_counts(nothing, BPE, scratch_dir(spark, "cache"), 50).count() == 0


def test_url_filters(spark):
    urls = ["http://A.Example.org/en/12?x", "https://example.org/es/1", "http://x.com/de/5#t", "http://x.com/fr/5",
            "http://y.net/bad/1", "http://y.net/bad/2", "http://y.net/ok/3", "no scheme", None, "://", "http://org", "http://org/",
            "http://y.net/bad/1"] + [f"http://y.net/bad/{i}" for i in range(100, 140)] + [f"http://y.net/ok/{i}" for i in range(200, 240)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").withColumn("rule", F.lit("clash"))
    labels = spark.createDataFrame(
        [(i, True) for i in range(100, 140)] + [(i, False) for i in range(200, 240)], "document bigint, bad boolean")
    got = by_id(url_templates.judge(df, labels), "page_id")
    assert (got[0].host, got[0].path, got[0].rule, got[0].verdict) == ("a.example.org", "/en/12", "example.org/en/1", "block")
    assert [got[i].verdict for i in range(1, 5)] == ["block", "block", "allow", "block"]
    assert got[6].verdict == "allow" and got[12].verdict == "block" and got[4].rule is None
    assert all((got[i].host, got[i].path) == ("", "") for i in (7, 8, 9))
    assert got[10].rule is None and got[11].rule == "org/"
    assert url_templates.judge(df.limit(0), labels.limit(0)).count() == 0


def url_verdicts(spark, groups):
    """``groups``: (url without its number, labels as text: b bad, g good, - none)."""
    pages = [(i, f"{url}{i}", mark) for i, (url, mark) in enumerate((u, m) for u, marks in groups for m in marks)]
    df = spark.createDataFrame([p[:2] for p in pages], "page_id bigint, url string")
    labels = spark.createDataFrame([(i, m == "b") for i, _, m in pages if m != "-"], "document bigint, bad boolean")
    rows = url_templates.judge(df, labels).collect()
    return {(f"http://{r.host}" + r.path.rstrip("0123456789")): r for r in rows}


def word(i):
    return "s" + "".join(chr(97 + int(x)) for x in str(i))


def test_url_filters_keep_a_bad_section_of_many(spark):
    for sections in (31, 60):
        got = url_verdicts(spark, [("http://w.net/spam/", "b" * 30)] + [(f"http://w.net/{word(i)}/", "g" * 5) for i in range(sections)])
        assert got.pop("http://w.net/spam/").verdict == "block"
        assert len(got) == sections and all(r.verdict == "allow" for r in got.values())


def test_url_filters_tell_deep_branches_apart(spark):
    for depth in (4, 5, 9):
        top = "http://w.net/" + "/".join(["top"] * depth)
        got = url_verdicts(spark, [(f"{top}/spam/x/", "b" * 30), (f"{top}/ok/x/", "g" * 90)])
        assert (got[f"{top}/spam/x/"].verdict, got[f"{top}/ok/x/"].verdict) == ("block", "allow")


def test_url_filters_merge_branches_of_any_level(spark):
    # Without labels of its own, a branch has its siblings' share, not that of all hosts.
    groups = [("http://good.net/a/", "g" * 300)]
    for k in range(4):
        at = "/".join(["http://w.net" + str(k), *["top"] * k])
        groups += [(f"{at}/one/x/", "b" * 12), (f"{at}/two/x/", "b" * 12), (f"{at}/new/x/", "-")]
    got = url_verdicts(spark, groups)
    assert got.pop("http://good.net/a/").verdict == "allow"
    assert [r.verdict for r in got.values()] == ["block"] * 12
    assert got["http://w.net2/top/top/new/x/"].template == "/top/top/{any}/x/{n}"


def test_toxicity_draws_each_label(spark, monkeypatch):
    rows = [(i, "text " * (1 + (9999 if i % 2 else 0)), int(i % 20 == 0)) for i in range(1200)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    drawn = []
    monkeypatch.setattr(toxicity, "TRAIN_TEXTS", 100)
    monkeypatch.setattr(toxicity, "train", lambda docs, labels: drawn.extend(labels) or toxicity.Network(1))
    net = toxicity.fit(df, df)
    there = [zlib.crc32(str(i).encode()) % 3 != 1 and t for i, _, t in rows]
    short = sum(zlib.crc32(str(i).encode()) % 3 != 1 and not i % 2 for i, *_ in rows)
    toxic = min(50, sum(there))
    assert (len(drawn), sum(drawn)) == (100, toxic)
    shift = np.log(sum(there) / (short - sum(there)) * (100 - toxic) / toxic)
    assert net.p["out_b"][0] == pytest.approx(shift, rel=1e-5)


def brute_passages(rows):
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - 99):
            w = b[s : s + 100]
            if w in seen:
                gone[s : s + 100] = True
            seen.add(w)
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[i] = (len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    return out


@pytest.mark.parametrize("part_runs", [2, 10_000])
def test_repeated_passages(spark, nothing, part_runs):
    shared, rows = prose(9, 60), fixture()
    rows += [(300 + i, prose(i, 20) + shared + prose(50 + i, 20)) for i in range(15)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("ranges", F.lit("clash"))
    got = by_id(suffix_dedup.dedup_passages(df, part_runs=part_runs))
    assert {i: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for i, x in got.items()} == brute_passages(rows)
    assert suffix_dedup.dedup_passages(nothing).count() == 0


def test_suffix_array():
    r = np.random.default_rng(0)
    for n in [*range(1, 50), 300]:
        for k in (1, 2, 50):
            x = r.integers(1, k + 1, n)
            assert suffix_dedup.suffix_array(x).tolist() == sorted(range(n), key=lambda i: x[i:].tolist())


def test_pipeline_stages(spark, docs, tmp_path):
    labels = [(i, 1, 0) for i in range(12)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    frame = docs.unionByName(docs.limit(1).withColumn("doc_id", F.lit(None).cast("bigint")))
    assert [n for n, _ in corpus_pipeline.STAGES][2:] == ["near_copies", "repeated_passages", "packing"]
    kept = frame
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = kept
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == frame.columns, name
        ids = {r.doc_id for r in kept.collect()}
        if name == "quality_rules":
            assert ids == {r.doc_id for r in quality_cascade.judge(before).where("kept").collect()}
        if name == "near_copies":
            found = jaccard_join.similar_components(before.select("doc_id", "text"))
            assert ids == {r.doc_id for r in found.collect() if r.doc_id is None or r.doc_id == r.component_id}
        if name == "repeated_passages":
            want = brute_passages([(r.doc_id, r.text) for r in before.collect() if r.doc_id is not None])
            for r in kept.collect():
                if r.doc_id is not None:
                    assert len(r.text.encode()) <= want[r.doc_id][0] - want[r.doc_id][1]
    last = corpus_pipeline.STAGES[-1][1](spark, kept, str(tmp_path))
    assert {r.doc_id for r in last.collect()} == {r.doc_id for r in kept.collect()}


def test_copies_stage_keeps_unique_texts_of_repeated_ids(spark):
    one, other = prose(1, 80), prose(2, 80)
    rows = [(1, one), (5, one + " end"), (5, other), (7, other), (9, None), (9, prose(3, 80)), (None, one)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("digest", F.lit("clash"))
    kept = corpus_pipeline.near_copies(spark, df, "")
    assert kept.columns == df.columns
    assert sorted(((r.doc_id or 0), r.text or "") for r in kept.collect()) == sorted(
        ((i or 0), t or "") for i, t in rows if (i, t) not in ((5, one + " end"), (7, other)))


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_on_an_empty_table(spark, tmp_path, stage):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = dict(corpus_pipeline.STAGES)[stage](spark, spark.createDataFrame([], schema), str(tmp_path))
    assert got.count() == 0 and (stage == "packing" or got.columns == ["doc_id", "text", "lang", "source", "n_chars"])


def test_signatures_bound_the_difference():
    rng = np.random.default_rng(5)
    for _ in range(200):
        both = rng.integers(0, 1 << 63, rng.integers(0, 400), dtype=np.uint64)
        x, y = (np.unique(np.concatenate([both, rng.integers(0, 1 << 63, rng.integers(1, 300), dtype=np.uint64)]))
                for _ in range(2))
        bits = [np.frombuffer(jaccard_join.signature(s), np.uint8) for s in (x, y)]
        d = jaccard_join.differing(*bits)
        assert d <= len(np.setxor1d(x, y)) and d == jaccard_join.differing(*bits[::-1])
        assert jaccard_join.differing(bits[0], bits[0]) == 0
