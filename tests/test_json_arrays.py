"""JSON arrays cut by ranges, against Python's own parser."""

import json
import random

import pytest
from pyspark.sql import functions as F

from colloquy.sources import json_arrays, json_items as J
from colloquy.operators.running import running_total
from colloquy.session import scratch_dir


def elements(spark, path):
    rows, files = json_arrays.read_elements(spark, str(path))
    counts = {r["file"].rsplit("/", 1)[1]: r["n"] for r in files.collect()}
    found = {}
    for r in rows.collect():
        found.setdefault(r["file"].rsplit("/", 1)[1], {})[r["pos"]] = json.loads(r["text"])
    return {f: [found.get(f, {})[i] for i in range(n)] for f, n in counts.items()}


def awkward(n, seed=5):
    r = random.Random(seed)
    bits = ['"', "\\", "}", "{", "]", "[", ",", "é", "日本", "😀", "\n", "\t", "/", "x", "\\\\", '\\"', "},{", '"}, {"', " "]
    text = lambda: "".join(r.choice(bits) for _ in range(r.randrange(12)))
    shapes = [
        lambda: {"a": text(), "b": [text(), {"c": text()}]}, lambda: {}, lambda: {"k" + text(): None}, lambda: [],
        lambda: [text(), [[]]], text, lambda: 7, lambda: None, lambda: {"deep": {"deep": {"deep": [{"x": text()}]}}},
    ]
    return [r.choice(shapes)() for _ in range(n)]


@pytest.fixture
def cut_at(spark, monkeypatch):
    """Ranges of so many bytes where the arrays are read, and small chunks."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}
    write = json_arrays.materialize

    def set_to(size, chunk=None):
        def cut(df, label):
            # Only the arrays are to be read in such ranges, not what is written from them.
            if label != "array-chunks":
                return write(df, label)
            for n in names:
                spark.conf.set(n, str(size))
            assert df.rdd.getNumPartitions() > 2 or size > 1000
            path = scratch_dir(spark, label)
            df.write.parquet(path)
            for n, v in before.items():
                spark.conf.set(n, v)
            return spark.read.schema(df.schema).parquet(path)

        monkeypatch.setattr(json_arrays, "materialize", cut)
        if chunk:
            monkeypatch.setattr(json_arrays, "CHUNK_BYTES", chunk)

    yield set_to
    for n, v in before.items():
        spark.conf.set(n, v)


@pytest.mark.parametrize("size, chunk, ascii_only", [(17, 5, False), (64, 1, True), (1 << 20, 4 << 20, True)])
def test_every_cut_gives_the_same_elements(spark, tmp_path, cut_at, size, chunk, ascii_only):
    items = awkward(8 if size < 60 else 40)
    (tmp_path / "a.json").write_text(" " + json.dumps(items, ensure_ascii=ascii_only) + "\n", encoding="utf-8")
    (tmp_path / "b.json").write_text(json.dumps(items[::-1], indent=2, ensure_ascii=ascii_only), encoding="utf-8")
    cut_at(size, chunk)
    assert elements(spark, tmp_path) == {"a.json": items, "b.json": items[::-1]}


def test_one_element_over_many_ranges(spark, tmp_path, cut_at):
    items = [{"t": "}" * 60 + '"{[' * 20}, {"t": "short"}]
    (tmp_path / "a.json").write_text(json.dumps(items))
    cut_at(20, 10)
    assert elements(spark, tmp_path) == {"a.json": items}


def test_small_arrays(spark, tmp_path):
    given = {"empty.json": "[]", "blank.json": " [ \n ] ", "nested.json": "[[]]", "one.json": "[{}]", "two.json": "[1, 2]", "null.json": "[null]"}
    for name, text in given.items():
        (tmp_path / name).write_text(text)
    assert elements(spark, tmp_path) == {name: json.loads(text) for name, text in given.items()}


@pytest.mark.parametrize("text", ['{"a": 1}', '[{"a": 1}', '[{"a": 1}]]', '[1, , 2]', '[1] x', 'x [1]', '["a]', "[1,]", "[1] [2]"])
def test_files_that_are_no_list_fail(spark, tmp_path, text):
    (tmp_path / "a.json").write_text(text)
    with pytest.raises(Exception, match="not a JSON list"):
        rows, files = json_arrays.read_elements(spark, str(tmp_path))
        assert rows.collect() is files.collect()


def test_one_file_of_several_ranges_reads_as_several_files(spark, tmp_path, cut_at):
    items = [
        {"id": str(i), "source": None, "task_type": "t", "messages": None,
         "conversations": [{"role": "user", "content": "q} " * (i % 9)}, {"role": "assistant", "content": '"a"\\' * i}]}
        for i in range(40)
    ]
    (tmp_path / "one").mkdir()
    (tmp_path / "many").mkdir()
    (tmp_path / "one" / "all.json").write_text(json.dumps(items))
    for k in range(0, 40, 7):
        (tmp_path / "many" / f"{k:02}.json").write_text(json.dumps(items[k : k + 7]))
    cut_at(100)
    one = {r["idx"]: r for r in J.read_train(spark, str(tmp_path / "one")).collect()}
    many = {r["idx"]: r for r in J.read_train(spark, str(tmp_path / "many")).collect()}
    assert one == many and sorted(one) == list(range(40))
    assert [one[i]["id"] for i in range(40)] == [x["id"] for x in items]


@pytest.mark.parametrize("per_file", [4, 1_000])
def test_arrays_have_whole_files_whatever_repeats(spark, tmp_path, per_file):
    """Equal and null keys, some over the end of a file or over several files."""
    r = random.Random(1)
    keys = [None, None, 3, 3, 3, *[7] * 11, *range(10, 60)]
    rows = [(f, k, f"{f}-{k}-{n}") for f in ("a", None, "b c") for n, k in enumerate(keys)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "f string, k int, t string").repartition(3)
    path = tmp_path / "out"
    for _ in range(2):
        json_arrays.write_arrays(df, F.to_json(F.struct("t")), str(path), ["f"], ["k"], per_file)
    for f, folder in (("a", "f=a"), (None, "f=__HIVE_DEFAULT_PARTITION__"), ("b c", "f=b c")):
        texts = [x.read_text() for x in sorted((path / folder).glob("shard=*/*.txt"))]
        files = [json.loads(x) for x in texts]
        found = [x["t"] for y in files for x in y]
        assert [len(x) for x in files] == [*[per_file] * (len(keys) // per_file), *[len(keys) % per_file] * (len(keys) % per_file > 0)]
        assert sorted(found) == sorted(t for g, _, t in rows if g == f)
        order = [t.split("-")[1] for t in found]
        assert order == [str(k) for k in keys]


def test_running_total(spark):
    rows = [(k, i, (i * 7) % 5) for k in "ab" for i in range(50)]
    df = spark.createDataFrame(rows, "k string, i int, n int").repartition(6)
    got = {(r.k, r.i): r.before for r in running_total(df, ["i"], "n", "before", ["k"]).collect()}
    assert got == {(k, i): sum((j * 7) % 5 for j in range(i)) for k, i, _ in rows}
    whole = {r.i: r.before for r in running_total(df.where("k = 'a'"), ["i"], "n", "before").collect()}
    assert whole == {i: got["a", i] for i in range(50)}
