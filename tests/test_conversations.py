import random

import pytest
from pyspark.sql import functions as F

from colloquy import schemas
from colloquy.functions import text as X
from colloquy.functions.token_counts import LineCounts, tokenizer_counter, tokenizer_encoder
from colloquy.operators import budget, conversations as C, corpus as R, training

TURNS = "conv_id long, turn long, role string, content string"
SEVEN = [
    ("system", "sys"), ("user", "demo one"), ("assistant", "demo answer"),
    ("user", "demo two"), ("assistant", "demo answer 2"),
    ("human", "Now it's your turn. Real question"), ("gpt", "Node:\n1: real gold"),
]


def table(spark, *conversations):
    rows = [
        (c, t, role, content)
        for c, turns in enumerate(conversations)
        for t, (role, content) in enumerate(turns)
    ]
    return spark.createDataFrame(rows, TURNS)


def test_last_turns_ignore_demos_and_system(spark):
    got = C.conversation_parts(table(spark, SEVEN), ["conv_id"]).first()
    assert got["user"] == "Now it's your turn. Real question"
    assert got["assistant"] == got["gold_workflow"] == "Node:\n1: real gold"
    assert got["system"] == "sys"


def test_missing_parts_are_empty(spark):
    got = C.conversation_parts(table(spark, [("tool", "x")]), ["conv_id"]).first()
    assert (got["system"], got["user"], got["assistant"]) == ("", "", "")
    assert got["gold_workflow"] == "x"


def test_nested_items_fall_through_empty_lists(spark):
    chat = [("user", "q"), ("assistant", "a")]
    rows = [(0, "a", None, None, [], chat), (1, "b", None, None, chat, None), (2, "c", None, None, None, None)]
    items = spark.createDataFrame(rows, "idx long, " + ", ".join(
        f"{f.name} {f.dataType.simpleString()}" for f in schemas.ITEM.fields))
    got = C.explode_items(items, ["idx"], prefer="conversations").orderBy("idx", "turn").collect()
    assert [(r["idx"], r["turn"], r["content"]) for r in got] == [
        (0, 0, "q"), (0, 1, "a"), (1, 0, "q"), (1, 1, "a")]


def test_role_default_and_aliases(spark):
    rows = table(spark, [(None, "a"), ("human", "b"), ("gpt", None), ("tool", "d")])
    got = C.normalize_roles(rows).orderBy("turn").collect()
    assert [(r["role"], r["content"]) for r in got] == [
        ("user", "a"), ("user", "b"), ("assistant", ""), ("tool", "d")]


def test_strip_is_python_strip(spark):
    texts = [" a ", "\t\n b c  ", "\x1c x\x1f", "", "  "]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(X.strip(F.col("t"))).collect()] == [t.strip() for t in texts]


def test_corpus_ids_and_filters(spark):
    turns = table(
        spark, [("user", "q0"), ("assistant", "a0")], [("user", "q1")],
        [("user", "q2"), ("assistant", "a2")], [("user", "  "), ("assistant", "a3")],
    ).withColumnRenamed("conv_id", "idx")
    heads = spark.createDataFrame(
        [(0, None, None, None), (1, "x", "s", None), (2, "x", "s", "t"), (3, None, "s", "")],
        "idx long, id string, source string, task_type string")
    got = R.retrieval_corpus(turns, heads).orderBy("id", "index").collect()
    assert [(r["id"], r["index"]) for r in got] == [("s::3", 3), ("s::x", 2), ("unknown::0", 0)]
    plain = R.retrieval_corpus_plain_ids(turns, heads).orderBy("index").collect()
    assert [(r["id"], r["task_type"]) for r in plain] == [("0", None), ("x", "t")]


# --- budget -----------------------------------------------------------------


def tokens(messages):
    return max(1, len("\n".join(f"{r}: {c}" for r, c in messages)) // 4)


def naive_fit(messages, limit):
    if tokens(messages) <= limit:
        return "full", messages
    head = messages[:1] if messages[0][0] == "system" else []
    body = messages[len(head):]
    if len(body) < 2 or len(body) % 2:
        return "malformed", None
    for k in range(1, (len(body) - 2) // 2 + 1):
        rest = head + body[2 * k:]
        if tokens(rest) <= limit:
            return f"drop_{k}_demo", rest
    return "dropped", None


def random_conversations(n, seed=7):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        size = rng.randint(1, 12)
        turns = [("system", "s" * rng.randint(0, 60))] if rng.random() < 0.5 else []
        turns += [
            (("user", "assistant")[i % 2], "é" * rng.randint(0, 120)) for i in range(size)
        ]
        out.append(turns)
    return out


@pytest.mark.parametrize("block", [2, C.BLOCK_TURNS])
def test_budget_fit_equals_the_rule(spark, monkeypatch, block):
    monkeypatch.setattr(C, "BLOCK_TURNS", block)
    conversations = random_conversations(150)
    turns = table(spark, *conversations)
    fitted = budget.fit_budget(turns, ["conv_id"], 90)
    tags = {r["conv_id"]: r["tag"] for r in fitted.collect()}
    sets = {
        r["conv_id"]: [(m["role"], m["content"]) for m in r["messages"]]
        for r in budget.sft_dataset(turns, ["conv_id"], 90).collect()
    }
    for c, messages in enumerate(conversations):
        tag, kept = naive_fit(messages, 90)
        assert tags[c] == tag
        assert sets.get(c) == kept
    assert len(set(tags.values())) > 4


def test_budget_cases_and_stats(spark):
    short = [("system", "s"), ("user", "hi"), ("assistant", "ok")]
    demos = [("system", "s")] + [("user", "a" * 5000), ("assistant", "b" * 5000)] * 2
    demos += [("user", "c" * 200), ("assistant", "gold")]
    huge = [("user", "x" * 20000), ("assistant", "y" * 20000)] * 3
    turns = table(spark, short, demos, huge)
    fitted = budget.fit_budget(turns, ["conv_id"])
    tags = {r["conv_id"]: r["tag"] for r in fitted.collect()}
    assert tags == {0: "full", 1: "drop_2_demo", 2: "dropped"}
    kept = budget.kept_turns(turns, ["conv_id"], fitted).filter("conv_id = 1").orderBy("turn").collect()
    assert [(r["turn"], len(r["content"])) for r in kept] == [(0, 1), (1, 200), (2, 4)]
    stats = budget.budget_stats(fitted, 2048).first()
    assert (stats["total"], stats["kept"], stats["dropped"], stats["truncated"]) == (3, 2, 1, 1)
    assert stats["outcomes"] == {"full": 1, "drop_2_demo": 1, "dropped": 1}


def test_items_without_turns_are_full(spark):
    items = spark.createDataFrame([(0,), (9,)], "conv_id long")
    got = budget.fit_budget(table(spark, [("user", "q")]), ["conv_id"], items=items).collect()
    assert {r["conv_id"]: (r["tag"], r["tokens_after"]) for r in got} == {0: ("full", tokens([("user", "q")])), 9: ("full", tokens([]))}


def test_budget_with_tokenizer(spark):
    def load():
        return lambda text: len(text.split())

    def rule(messages, limit):
        def count(ms):
            return len("\n".join(f"{r}: {c}" for r, c in ms).split())
        if count(messages) <= limit:
            return "full"
        head = messages[:1] if messages[0][0] == "system" else []
        body = messages[len(head):]
        if len(body) < 2 or len(body) % 2:
            return "malformed"
        for k in range(1, (len(body) - 2) // 2 + 1):
            if count(head + body[2 * k:]) <= limit:
                return f"drop_{k}_demo"
        return "dropped"

    rng = random.Random(3)
    conversations = [
        [(r, " ".join("w" * rng.randint(1, 9) for _ in range(rng.randint(1, 12)))) for r, _ in c]
        for c in random_conversations(80, seed=5)
    ]
    got = budget.fit_budget_with_tokenizer(
        table(spark, *conversations), ["conv_id"], 40, load)
    tags = {r["conv_id"]: r["tag"] for r in got.collect()}
    assert tags == {c: rule(m, 40) for c, m in enumerate(conversations)}


BYTE_LEVEL = "/opt/tokenizers/byte_bpe_50k.json"


def odd_lines(rng):
    """Lines whose joints are known, and such that end in blanks, begin in blanks or are empty."""
    return rng.choice(["Some words, 12.", "ends in blanks  ", "\n\nbegins", "", "e\u0301\u3000", "a\n b\n", "<|endoftext|>", "don't 's"])


@pytest.mark.parametrize("lead", [None, "system: be brief", "system: blank "])
def test_line_counts_are_those_of_the_joined_text(lead):
    rng = random.Random(11)
    real = tokenizer_counter(BYTE_LEVEL)
    for make in (real, lambda text: real(text)):  # the second says nothing about joints
        for _ in range(60):
            lines = [f"{rng.choice(['user', 'assistant', '', ' x'])}: {odd_lines(rng)}" for _ in range(rng.randint(1, 9))]
            counts = LineCounts(make, lines, lead)
            for start in rng.sample(range(len(lines)), len(lines)):
                whole = [*([lead] if lead is not None else []), *lines[start:]]
                assert counts.of(start) == real("\n".join(whole))


def test_a_fit_with_known_joints_tokenises_at_most_twice(spark, tmp_path):
    seen = str(tmp_path / "seen")
    conversations = [
        [("system", "be brief")] * (c % 2) + [(r, f"turn {i} of {c} says this") for i in range(60) for r in ("user", "assistant")]
        for c in range(4)
    ]

    def load(known=True):
        def make():
            real = tokenizer_counter(BYTE_LEVEL)

            def count(text):
                with open(seen, "a") as f:
                    f.write(f"{len(text)}\n")
                return real(text)

            if known:
                count.joins = real.joins
            return count

        return make

    def fitted(known):
        open(seen, "w").close()
        rows = budget.fit_budget_with_tokenizer(table(spark, *conversations), ["conv_id"], 300, load(known)).collect()
        with open(seen) as f:
            return sorted(rows), sum(int(n) for n in f)

    chars = sum(len("\n".join(f"{r}: {t}" for r, t in c)) for c in conversations)
    (rows, few), (same, many) = fitted(True), fitted(False)
    assert rows == same and all(r["tag"].startswith("drop_") and r["n_dropped"] > 40 for r in rows)
    assert few <= 2 * chars < 10 * chars < many


def test_a_tokenizer_that_is_wrong_about_its_joints_fails(spark):
    def load():
        def count(text):
            return len(text.split())

        count.joins = lambda left, right: -1
        return count

    chat = [("user", "a b c d"), ("assistant", "e f g h")] * 4
    with pytest.raises(Exception, match="joins"):
        budget.fit_budget_with_tokenizer(table(spark, chat), ["conv_id"], 14, load).collect()


def test_counters_say_what_they_know():
    assert tokenizer_counter(BYTE_LEVEL).max_chars_per_token >= 13
    word = tokenizer_counter("/opt/tokenizers/word_bpe_49k.json")
    assert word("two words") == 2 and not hasattr(word, "joins") and not hasattr(word, "max_chars_per_token")


# --- masked examples --------------------------------------------------------


def nested(spark, *conversations):
    return spark.createDataFrame(
        list(enumerate(conversations)),
        "conv_id long, messages array<struct<role:string,content:string>>")


def test_only_the_last_answer_is_unmasked(spark):
    chat = [("system", "s"), ("user", "u"), ("assistant", "gold")]
    got = training.masked_examples(nested(spark, chat), ["conv_id"], 2048).first()
    full = "".join(f"<|{r}|>\n{c}\n" for r, c in chat)
    prefix = "".join(f"<|{r}|>\n{c}\n" for r, c in chat[:-1]) + "<|assistant|>\n"
    assert got["input_ids"] == [ord(ch) for ch in full]
    assert got["labels"] == [-100] * len(prefix) + [ord(ch) for ch in full[len(prefix):]]
    assert got["attention_mask"] == [1] * len(full)


def test_masking_skips_and_shared_front(spark):
    chat = [("user", "u" * 30), ("assistant", "gold")]
    rows = nested(spark, chat, [("user", "u")], [("user", "u"), ("user", "v")])
    cut = training.masked_examples(rows, ["conv_id"], 10).orderBy("conv_id").collect()
    assert [r["reason"] for r in cut] == ["no_label", "no_answer", "no_answer"]
    with pytest.raises(RuntimeError):
        training.require_examples(training.masked_examples(rows, ["conv_id"], 10))
    # A prefix that is not the front of the text is cut back to what both share.
    odd = training.masked_examples(
        nested(spark, chat), ["conv_id"], 2048, generation_prompt="<|assistant|>XX").first()
    shared = len("<|user|>\n" + "u" * 30 + "\n<|assistant|>")
    assert odd["labels"][:shared] == [-100] * shared and odd["labels"][shared] == ord("\n")


def test_custom_tokenizer_and_padding(spark):
    def load():
        return lambda text: [len(w) for w in text.split()]

    rows = nested(spark, [("user", "a bb ccc"), ("assistant", "dd e")])
    ex = training.masked_examples(
        rows, ["conv_id"], 100, encode=training.tokenizer_udf(load))
    assert ex.first()["labels"][-2:] == [2, 1]
    padded = training.pad_examples(ex.filter("reason = 'kept'"), 7).first()
    assert len(padded["input_ids"]) == len(padded["labels"]) == len(padded["attention_mask"]) == 8
    assert padded["input_ids"][-1] == 7 and padded["labels"][-1] == -100 and padded["attention_mask"][-1] == 0
    assert training.pad_examples(ex, 7).count() == 1


def test_one_encoding_gives_the_examples_of_two(spark, tmp_path):
    rng = random.Random(5)
    roles = ["system", "user", "assistant", "user", "assistant"]
    chats = [
        [(r, rng.choice(["Word and 12.", " blank first", "\n\nlines", "", "e\u0301 \u4e2d", "it's\n"]) * rng.randint(1, 3))
         for r in roles[rng.randint(0, 2):rng.randint(3, 5)]]
        for _ in range(60)
    ] + [[], [("assistant", "alone")], [("user", "u"), ("assistant", "x " * 30_000)]]
    rows = nested(spark, *chats)
    seen = str(tmp_path / "seen")

    def load_both():
        encode = tokenizer_encoder(BYTE_LEVEL)
        return lambda text: encode(text)[0]

    def load_once():
        real = tokenizer_encoder(BYTE_LEVEL)

        def encode(text):
            with open(seen, "a") as f:
                f.write("1\n")
            return real(text)

        encode.cuts = real.cuts
        return encode

    def load_unsure():
        real = tokenizer_encoder(BYTE_LEVEL)
        return lambda text: real(text)

    for length in (5, 40, 2048):
        two = training.masked_examples(rows, ["conv_id"], length, encode=training.tokenizer_udf(load_both))
        for load in (load_once, load_unsure):
            one = training.masked_examples_encoded_once(rows, ["conv_id"], length, load)
            assert sorted(one.collect()) == sorted(two.collect())
    solid = nested(spark, *[[("user", f"question {i}"), ("assistant", f"answer {i}")] for i in range(20)], [("user", "u")])
    open(seen, "w").close()
    got = training.masked_examples_encoded_once(solid, ["conv_id"], 2048, load_once).collect()
    assert [r["reason"] for r in got].count("kept") == 20
    with open(seen) as f:
        assert len(f.readlines()) == 20
    assert training.masked_examples_encoded_once(rows.where("false"), ["conv_id"], 9, load_once).count() == 0
