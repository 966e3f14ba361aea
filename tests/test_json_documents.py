"""The split reader of JSON documents against the json module, for blocks of any size."""

import json
import random

import pytest
from pyspark.sql import types as T

from tidegauge.sources.json_documents import read_records_in_parts
from tidegauge.sources.tables import read_json_document

SCHEMA = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("s", T.StringType()),
    T.StructField("n", T.StructType([T.StructField("a", T.ArrayType(T.StructType([T.StructField("x", T.StringType())])))]))])


def texts(n, rng):
    return ["".join(rng.choice(['{', '}', '[', ']', '"', "\\", "a", "é", ",", ":", "\n", " "]) for _ in range(rng.randrange(12)))
            for _ in range(n)]


def records(n=400):
    rng = random.Random(1)
    return [{"id": i, "s": texts(1, rng)[0] if i % 5 else None,
             "n": {"a": [{"x": x} for x in texts(rng.randrange(4), rng)]} if i % 3 else None} for i in range(n)]


def canonical(rows):
    return sorted(json.dumps(r, sort_keys=True) for r in rows)


@pytest.fixture
def blocks(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")

    def size(n):
        spark.conf.set(names[0], str(n))
        spark.conf.set(names[1], "1")

    yield size
    for name in names:
        spark.conf.unset(name)


@pytest.mark.parametrize("size", [700, 5000, 1 << 27])
@pytest.mark.parametrize("form", ["array", "indented", "keyed", "lines"])
def test_equals_the_json_module(spark, tmp_path, blocks, size, form):
    rows = records()
    text = {"array": lambda: json.dumps(rows), "indented": lambda: json.dumps(rows, indent=2, ensure_ascii=False),
            "keyed": lambda: json.dumps({f'k{{"}}{i}': r for i, r in enumerate(rows)}) + "\n",
            "lines": lambda: "\n".join(map(json.dumps, rows))}[form]()
    path = tmp_path / "doc.json"
    path.write_text(text)
    blocks(size)
    found = read_records_in_parts(spark, str(path), SCHEMA, form == "keyed")
    assert canonical(r.asDict(recursive=True) for r in found.collect()) == canonical(rows)
    if size == 700:
        assert found.rdd.getNumPartitions() > 20  # one file, many tasks


def test_several_files_and_one_long_record(spark, tmp_path, blocks):
    long = {"id": 1, "s": "}{" * 4000, "n": None}
    (tmp_path / "a.json").write_text(json.dumps([long, *records(5)]))
    (tmp_path / "b.json").write_text("[]")
    (tmp_path / "c.json").write_text(json.dumps(records(7)))
    blocks(300)
    found = read_json_document(spark, str(tmp_path), SCHEMA).collect()
    assert canonical(r.asDict(recursive=True) for r in found) == canonical([long, *records(5), *records(7)])


@pytest.mark.parametrize("text", ['[{"id":1},{"id":2', '[{"id":1}', '[{"id":"a', '[{"id":1}, 5, {"id":2}]', '[{"id":"x"}]'])
def test_malformed_documents_raise(spark, tmp_path, text):
    (tmp_path / "bad.json").write_text(text)
    with pytest.raises(Exception):
        read_json_document(spark, str(tmp_path / "bad.json"), SCHEMA).collect()


@pytest.mark.parametrize("text, keyed, rows", [("[]", False, 0), ("{}", True, 0), ("", False, 0), (" [ ] \n", False, 0),
                                               ('{"id": 4}', False, 1), ('{"k": {"id": 4}}', True, 1)])
def test_small_documents(spark, tmp_path, text, keyed, rows):
    (tmp_path / "doc.json").write_text(text)
    assert read_json_document(spark, str(tmp_path / "doc.json"), SCHEMA, keyed).count() == rows
