"""Arrays of JSON that are cut at any byte."""
import json
import random

import pytest

from tessella.operators.runs import GuardError
from tessella.sources import corpora, json_array


def value(rng, depth=0):
    kind = rng.randint(0, 7 if depth < 3 else 4)
    if kind < 3:
        return "".join(rng.choice(['"', "\\", ",", "[", "]", "{", "}", "a", "é", "∀", "\n", " ", "\\\\", '\\"']) for _ in range(rng.randint(0, 12)))
    if kind < 5:
        return rng.choice([None, True, 0, -1.5, 10**12])
    if kind < 6:
        return [value(rng, depth + 1) for _ in range(rng.randint(0, 4))]
    return {f"k{i}": value(rng, depth + 1) for i in range(rng.randint(0, 4))}


@pytest.fixture
def narrow(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield lambda n: spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("split", [7, 61, 100_000])
def test_any_split(spark, tmp_path, narrow, split):
    rng = random.Random(split)
    rows = {}
    for name, n in (("a", 40), ("b", 1), ("c", 0), ("d", 25)):
        rows[name] = [{"i": i, "x": value(rng)} for i in range(n)]
        text = json.dumps(rows[name], ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1]))
        (tmp_path / f"{name}.json").write_text(rng.choice(["", " \n"]) + text + rng.choice(["", "\n"]), encoding="utf-8")
    narrow(split)
    got = json_array.elements(spark, str(tmp_path)).collect()
    have = {}
    for r in got:
        have.setdefault(r.file[-6], []).append(json.loads(r.text))
    for name, own in rows.items():
        assert sorted(have.get(name, []), key=lambda r: r["i"]) == own
    if split < 100:
        assert spark.read.option("lineSep", ",").text(str(tmp_path)).rdd.getNumPartitions() > 20


def test_scalars_and_long_elements(spark, tmp_path, narrow):
    (tmp_path / "x.json").write_text(json.dumps([1, "two", None, [3, [4, ","]], "z" * 5000, {"a": "]" * 3000}]))
    narrow(50)
    assert sorted(r.text for r in json_array.elements(spark, str(tmp_path)).collect()) == sorted(json.dumps(x) for x in [1, "two", None, [3, [4, ","]], "z" * 5000, {"a": "]" * 3000}])


def test_wrong_files_are_refused(spark, tmp_path):
    (tmp_path / "x.json").write_text('[{"a": 1}, {"a": 2}')
    with pytest.raises(GuardError, match="inside"):
        json_array.elements(spark, str(tmp_path))
    (tmp_path / "x.json").write_text('[{"a": 1}, {"a": }]')
    with pytest.raises(Exception, match="(?i)malformed"):
        json_array.read(spark, str(tmp_path), "a int").collect()
    assert sorted(r.a or 0 for r in json_array.read(spark, str(tmp_path), "a int", "PERMISSIVE").collect()) == [0, 1]


def test_conditions_of_the_reader_see_elements_alone(spark, tmp_path):
    (tmp_path / "x.json").write_text('[{"a": [1]}, {"a": [2, 3]}, {"a": []}, {"a": [4]}]')
    rows = json_array.read(spark, str(tmp_path), "a array<int>").where("size(a) >= 1").selectExpr("explode(a) x").where("x is not null")
    assert sorted(r.x for r in rows.collect()) == [1, 2, 3, 4]


def test_round_trip(spark, tmp_path, narrow):
    rows = [(i, f'"{i}", [x] \\ \n') for i in range(300)] + [(None, None)]
    df = spark.createDataFrame(rows, "id long, text string").repartition(5)
    json_array.write(df, str(tmp_path / "a"))
    narrow(200)
    assert sorted(map(repr, map(tuple, corpora.read_json_array(spark, str(tmp_path / "a"), "id long, text string").collect()))) == sorted(map(repr, rows))
    json_array.write(df.where("false"), str(tmp_path / "e"))
    assert json_array.read(spark, str(tmp_path / "e"), "id long, text string").count() == 0
