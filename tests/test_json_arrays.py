"""JSON arrays read by byte ranges against a plain parser."""

import json
import random

import pytest

from affinis.sources import readers


@pytest.fixture
def small_ranges(spark):
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, "97")
    yield
    spark.conf.set(name, before)


def value(dice, depth=0):
    kind = dice.random()
    if kind < 0.4 or depth > 3:
        return "".join(dice.choices(["a", "}", "{", "]", "[", '"', "\\", "é", "漢", "\n", ",", ":", "🙂", "\\\\", '\\"'], k=dice.randint(0, 12)))
    if kind < 0.6:
        return [value(dice, depth + 1) for _ in range(dice.randint(0, 3))]
    if kind < 0.8:
        return {f"k{i}}}": value(dice, depth + 1) for i in range(dice.randint(0, 3))}
    return dice.choice([None, True, 1.5, -3])


def read(spark, path):
    rows = readers.json_array_records(spark, str(path)).collect()
    return [json.loads(r.record) for r in sorted(rows, key=lambda r: (r.file, r.number))]


@pytest.mark.parametrize("indent,ascii", [(None, False), (2, True), (None, True), (1, False)])
def test_records_equal_plain(spark, small_ranges, tmp_path, indent, ascii):
    dice = random.Random(indent or 5)
    records = [{"n": n, "v": value(dice), "w": {"x": value(dice)}} for n in range(300)]
    records[7]["v"] = "}{ long \\ " * 200  # larger than many ranges
    path = tmp_path / "array.json"
    path.write_text(json.dumps(records, indent=indent, ensure_ascii=ascii), encoding="utf-8")
    assert spark.read.option("lineSep", "}").text(str(path)).rdd.getNumPartitions() > 5
    assert read(spark, path) == records


def test_small_files(spark, tmp_path):
    for name, text in {"a": "[]", "b": " [ ] \n", "c": '[{"n": 1}]', "d": '[{"n": {}}, {"n": []},\n{"n": "}"}]\n[{"n": 2}]', "e": "", "f": '[1, "x}", {"n": 3}, null]'}.items():
        (tmp_path / f"{name}.json").write_text(text)
    assert read(spark, tmp_path) == [{"n": 1}, {"n": {}}, {"n": []}, {"n": "}"}, {"n": 2}, {"n": 3}]


def test_registry(spark, small_ranges, tmp_path):
    records = [{"id": f"https://x/{n}", "name": f"Univ {n}" + '}"}]' + chr(92) + '"', "status": "active", "types": ["Education"]} for n in range(200)]
    path = tmp_path / "registry.json"
    path.write_text(json.dumps(records))
    got = readers.read_registry(spark, str(path)).select("id", "name", "status", "types").collect()
    assert sorted((r.id, r.name, r.status, r.types) for r in got) == sorted((r["id"], r["name"], r["status"], r["types"]) for r in records)
