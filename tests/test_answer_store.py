"""Prediction that goes on where an earlier run stopped."""

import os
import uuid

import pytest
from pyspark.sql import functions as F

from colloquy.sources import answer_store

CHAT = "id long, messages array<struct<role:string,content:string>>"


def asked(spark, *texts):
    return spark.createDataFrame([(i, [("user", t)]) for i, t in enumerate(texts)], CHAT)


def caller(folder, fail=lambda text: None):
    """A generator that leaves one file per call."""

    def load():
        def generate(messages, model, tuned):
            text = messages[-1]["content"] or ""
            fail(text)
            open(os.path.join(folder, uuid.uuid4().hex), "w").close()
            return f"{model} {text}"

        return generate

    return load


def calls(folder):
    return len(os.listdir(folder))


def options(**more):
    return {"model": "m", "finetuned": False, "slices": 4, "run": "r1", **more}


@pytest.fixture
def places(tmp_path):
    (tmp_path / "calls").mkdir()
    return str(tmp_path / "answers"), str(tmp_path / "calls")


def test_a_second_run_generates_only_the_rest_and_equal_prompts_once(spark, places):
    path, log = places
    few = asked(spark, "a", "b", "a", "")
    first = answer_store.predict_rest(few, ["id"], path, caller(log), **options())
    assert {r["id"]: r["workflow"] for r in first.collect()} == {0: "m a", 1: "m b", 2: "m a", 3: "m"}
    assert calls(log) == 3
    more = asked(spark, "b", "c", "a", "a", "d" * 100_000)
    second = answer_store.predict_rest(more, ["id"], path, caller(log), **options(run="r2"))
    assert {r["id"]: r["run"] for r in second.collect()} == {0: "r1", 1: "r2", 2: "r1", 3: "r1", 4: "r2"}
    assert calls(log) == 5
    other = answer_store.predict_rest(more, ["id"], path, caller(log), **options(finetuned=True))
    assert other.count() == 5 and calls(log) == 9


def test_a_run_that_dies_keeps_its_committed_slices(spark, places):
    path, log = places
    texts = [f"t{i}" for i in range(24)]
    some = asked(spark, *texts)
    digest = answer_store.prompt_digest(F.col("messages"), "m", False)
    by_slice = some.select(F.pmod(F.xxhash64(digest), F.lit(4)).alias("s"), F.col("messages")[0]["content"].alias("t"))
    last = {r["t"] for r in by_slice.where("s = 3").collect()}
    assert last and len(last) < 24

    def die(text):
        if text in last:
            raise SystemExit("lost")

    with pytest.raises(Exception):
        answer_store.predict_rest(some, ["id"], path, caller(log, die), **options())
    assert calls(log) == 24 - len(last)
    assert answer_store.read_answers(spark, path).count() == 24 - len(last)
    again = answer_store.predict_rest(some, ["id"], path, caller(log), **options())
    assert {r["workflow"] for r in again.collect()} == {f"m {t}" for t in texts}
    assert calls(log) == 24


def test_a_part_without_its_commit_is_not_read(spark, places):
    path, log = places
    answer_store.predict_rest(asked(spark, "a"), ["id"], path, caller(log), **options()).collect()
    [part] = os.listdir(path)
    os.remove(os.path.join(path, part, "_SUCCESS"))
    assert answer_store.read_answers(spark, path).count() == 0
    assert answer_store.predict_rest(asked(spark, "a"), ["id"], path, caller(log), **options()).count() == 1
    assert calls(log) == 2


@pytest.mark.parametrize("retry", [True, False])
def test_failed_prompts_are_tried_again_on_request(spark, places, retry):
    path, log = places

    def fail(text):
        if text == "bad":
            raise ValueError("no")

    both = asked(spark, "bad", "good")
    got = answer_store.predict_rest(both, ["id"], path, caller(log, fail), **options())
    assert {r["id"]: r["error"] for r in got.collect()} == {0: "ValueError: no", 1: None}
    got = answer_store.predict_rest(both, ["id"], path, caller(log), **options(run="r2", retry_failed=retry))
    assert {r["id"]: (r["workflow"], r["error"], r["run"]) for r in got.collect()} == {
        0: ("m bad", None, "r2") if retry else ("", "ValueError: no", "r1"),
        1: ("m good", None, "r1"),
    }
    assert calls(log) == 1 + retry


def test_null_messages_and_empty_tables(spark, places):
    path, log = places
    odd = spark.createDataFrame([(0, None), (1, []), (2, [(None, None)]), (3, [("user", "")])], CHAT)
    got = {r["id"]: r for r in answer_store.predict_rest(odd, ["id"], path, caller(log), **options()).collect()}
    assert set(got) == {0, 1, 2, 3}
    assert got[0]["error"].startswith("TypeError") and got[1]["error"].startswith("IndexError")
    assert got[2]["workflow"] == got[3]["workflow"] == "m"
    assert answer_store.predict_rest(odd.where("false"), ["id"], path, caller(log), **options()).count() == 0
