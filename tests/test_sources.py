"""Dumps cut into splits of any size are read as if they were whole."""

import json
import random

import pytest

from corpuslens.sources import readers
from corpuslens.sources.arrays import read_array
from corpuslens.sources.writers import write_array

SETTINGS = {"spark.sql.files.maxPartitionBytes": "{}b", "spark.sql.files.openCostInBytes": "{}b"}
SCHEMA = "url string, text string, n bigint, deep struct<a: array<struct<b: string>>>"


@pytest.fixture
def split_bytes(spark):
    before = {name: spark.conf.get(name) for name in SETTINGS}

    def use(size):
        for name, form in SETTINGS.items():
            spark.conf.set(name, form.format(size))

    yield use
    for name, value in before.items():
        spark.conf.set(name, value)


def _entries(rng, n):
    signs = ['"', "\\", "}", "{", "[", "]", ",", ":", "\n", "é", "\U0001f600", "a", " ", "\\\"", "}}", " "]

    def text():
        return "".join(rng.choice(signs) for _ in range(rng.choice([0, 1, 5, 40, 200])))

    for i in range(n):
        yield {"url": f"{i:05d}", "text": text(), "n": rng.choice([None, i]), "more": [[], {}, {text(): [text()]}],
               "deep": {"a": [{"b": text()} for _ in range(rng.choice([0, 1, 6]))]}}


def _plain(entry):
    return (entry["url"], entry["text"], entry["n"], [b["b"] for b in entry["deep"]["a"]])


def _rows(frame):
    return [(r["url"], r["text"], r["n"], [b["b"] for b in r["deep"]["a"]]) for r in frame.orderBy("ord_raw").collect()]


@pytest.mark.parametrize("size", [16, 300, 50000])
def test_array_equals_whole_file(spark, tmp_path, split_bytes, size):
    rng = random.Random(size)
    split_bytes(size)
    expected = []
    for name, indent in (("b one", None), ("a%20", 2), ("c", None)):
        entries = list(_entries(rng, {16: 1, 300: 8}.get(size, 60)))
        # Entries that are no objects stand between.
        mixed = [x for e in entries for x in (e, 7, "}{", None, [[{"url": "inner"}]])]
        (tmp_path / f"{name}.json").write_text(" \n" + json.dumps(mixed, indent=indent, ensure_ascii=rng.random() < 0.5) + "\n")
        expected.append((name, [_plain(e) for e in entries]))
    frame = read_array(spark, str(tmp_path), SCHEMA)
    assert _rows(frame) == [row for _, rows in sorted(expected) for row in rows]
    assert sorted(r["ord_raw"] for r in frame.select("ord_raw").collect()) == list(range(3 * len(entries)))


def test_array_over_many_tasks(spark, tmp_path, split_bytes):
    split_bytes(4000)
    entries = list(_entries(random.Random(5), 150))
    (tmp_path / "dump.json").write_text(json.dumps(entries))
    frame = read_array(spark, str(tmp_path), SCHEMA)
    assert frame.rdd.getNumPartitions() > 8
    assert _rows(frame) == [_plain(e) for e in entries]


def test_odd_files(spark, tmp_path):
    for name, body in (("a", ""), ("b", "[]"), ("c", " \n"), ("d", '{"url": "one"}'), ("e", '﻿[{"url": "two"}, {}]'),
                       ("f", '[{"url": 5, "n": "x"}, {"url": "bad" "n"}]'), ("g", '{"url": "l1"}\n{"url": "l2"}\n')):
        (tmp_path / f"{name}.json").write_text(body)
    found = read_array(spark, str(tmp_path), SCHEMA).orderBy("ord_raw").collect()
    assert [r["url"] for r in found] == ["one", "two", None, "5", None, "l1", "l2"]
    for n, body in enumerate(['[{"url": "x"}', '[{"url": "x"}, {"url": "y"', '[{"url": "x}]']):
        broken = tmp_path / f"broken{n}"
        broken.mkdir()
        (broken / "dump.json").write_text(body)
        with pytest.raises(Exception, match="ends within"):
            read_array(spark, str(broken), SCHEMA).collect()


def test_lines_in_tiny_splits(spark, tmp_path, split_bytes):
    sizes = [3, 80, 1, 40]
    for n, size in enumerate(sizes):
        (tmp_path / f"{n}.json").write_text("\n".join(json.dumps({"url": f"{n}-{i:04d}"}) for i in range(size)))
    expected = [f"{n}-{i:04d}" for n, size in enumerate(sizes) for i in range(size)]
    for size in (40, 300, 100000):
        split_bytes(size)
        posts = readers.read_posts(spark, str(tmp_path), lines=True)
        found = posts.orderBy("ord_raw").collect()
        assert [r["url"] for r in found] == expected
        assert len({r["ord_raw"] for r in found}) == len(found)


def test_arrays_are_written_and_read(spark, tmp_path):
    entries = [_plain(e) for e in _entries(random.Random(9), 50)]
    frame = spark.createDataFrame([(u, t, n) for u, t, n, _ in entries], "url string, text string, n bigint")
    write_array(frame.repartitionByRange(3, "url").sortWithinPartitions("url"), str(tmp_path / "out"))
    for file in (tmp_path / "out").glob("part-*"):
        assert isinstance(json.loads(file.read_text()), list)
    found = read_array(spark, str(tmp_path / "out"), SCHEMA).orderBy("ord_raw").collect()
    assert [(r["url"], r["text"], r["n"]) for r in found] == [e[:3] for e in entries]
    write_array(frame.limit(0), str(tmp_path / "none"))
    assert read_array(spark, str(tmp_path / "none"), SCHEMA).count() == 0
