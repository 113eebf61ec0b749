"""The source of records: splits against whole files, what cannot be read, streams with restarts."""

import gzip
import json
import os
import random

import pytest

from quillon.sources import records


@pytest.fixture
def source(spark):
    return records.registered(spark)


def _read(spark, at, **options):
    return [tuple(r) for r in spark.read.format("quillon_records").options(**options).load(str(at)).collect()]


def test_splits_of_any_size_give_every_line_once(source, tmp_path):
    r = random.Random(4)
    lines = ["x" * r.choice([0, 1, 2, 15, 16, 17, 40]) for _ in range(200)]
    raw = "\n".join(lines).encode()
    (tmp_path / "a.txt").write_bytes(raw)
    want, place = [], 0
    for line in lines:
        if line:
            want.append((place, line))
        place += len(line) + 1
    for most in (1, 2, 16, 17, 100, 1 << 20):
        parts = records.splits(records.listed(str(tmp_path)), most)
        assert len(parts) == -(-len(raw) // most)
        got = [(row["at"], row["content"]) for p in parts for b in records._batches(str(tmp_path), p) for row in b.to_pylist()]
        assert sorted(got) == want, most
    assert sorted((at, c) for _, at, _, c, _ in _read(source, tmp_path, splitBytes="64")) == want


def test_kinds_and_what_cannot_be_read(source, tmp_path):
    (tmp_path / "a.jsonl").write_bytes(b'{"k": 1}\r\n\n  \n\xff\xfe\n{"k": 2}')
    (tmp_path / "b.json").write_text('[{"k": 3}, {"k": "é"}]')
    (tmp_path / "c.json").write_text('{"k": 5}')
    (tmp_path / "d.json").write_text('{"k": ')
    (tmp_path / "e.txt.gz").write_bytes(gzip.compress(b"one\ntwo\n"))
    (tmp_path / "lines.jsonl").mkdir()
    (tmp_path / "lines.jsonl" / "part-0.txt").write_text('{"k": 6}\n')
    for aside in ("f.parquet", "_g.jsonl", ".h.jsonl"):
        (tmp_path / aside).write_text("{}\n")
    (tmp_path / "empty.jsonl").write_text("")
    got = {(f, at): (k, c, e) for f, at, k, c, e in _read(source, tmp_path)}
    assert got == {
        ("a.jsonl", 0): ("jsonl", '{"k": 1}', None),
        ("a.jsonl", 14): ("jsonl", "��", "no UTF-8 at byte 0"),
        ("a.jsonl", 17): ("jsonl", '{"k": 2}', None),
        ("b.json", 0): ("json", '{"k": 3}', None),
        ("b.json", 1): ("json", '{"k": "é"}', None),
        ("c.json", 0): ("json", '{"k": 5}', None),
        ("d.json", 0): ("json", '{"k": ', "no JSON"),
        ("e.txt.gz", 0): ("txt", "one", None),
        ("e.txt.gz", 4): ("txt", "two", None),
        ("lines.jsonl/part-0.txt", 0): ("jsonl", '{"k": 6}', None),
    }


def test_checked_keeps_what_does_not_fit(source, tmp_path):
    (tmp_path / "a.jsonl").write_bytes(b'{"k": 1, "v": "a"}\n{"v": null, "more": 2}\n{"k": "x"}\n[1]\n{"k": 1\nnull\n\xff\n')
    rows = records.checked(source.read.format("quillon_records").load(str(tmp_path)), "k long, v string").orderBy("at").collect()
    assert [(tuple(r["record"]) if r["record"] else None, r["error"]) for r in rows] == [
        ((1, "a"), None), ((None, None), None), (None, "another type"), (None, "no object"), (None, "no JSON"), (None, "no object"), (None, "no UTF-8 at byte 0"),
    ]
    assert all(r["content"] for r in rows)


def test_empty_folder_and_options(source, tmp_path):
    assert _read(source, tmp_path) == []
    (tmp_path / "a.part").write_text("x\n")
    assert [c for _, _, _, c, _ in _read(source, tmp_path, kind="txt")] == ["x"]
    with pytest.raises(Exception, match="kind is one of"):
        _read(source, tmp_path, kind="csv")


def test_stream_reads_each_file_once_over_restarts(source, tmp_path):
    into, log, out, checkpoint = (str(tmp_path / n) for n in ("in", "log", "out", "checkpoint"))
    os.mkdir(into)

    def write(name, keys, time):
        with open(f"{into}/_{name}", "w") as f:
            f.writelines(json.dumps({"k": k}) + "\n" for k in keys)
        os.rename(f"{into}/_{name}", f"{into}/{name}")
        os.utime(f"{into}/{name}", (time, time))

    def run():
        s = source.readStream.format("quillon_records").options(log=log, splitBytes="20").load(into)
        s.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out).awaitTermination()
        return sorted(json.loads(r["content"])["k"] for r in source.read.parquet(out).collect())

    write("b.jsonl", range(10), 2000)
    write("c.jsonl", range(10, 20), 3000)
    assert run() == list(range(20))
    assert run() == list(range(20))
    write("a.jsonl", range(20, 25), 1000)  # older than what was read
    assert run() == list(range(25))
    with open(f"{into}/b.jsonl", "a") as f:
        f.write('{"k": 99}\n')  # grew after it was listed
    write("d.jsonl", range(25, 30), 3000)
    assert run() == list(range(30))


def test_an_entry_past_the_checkpoint_is_read_again_as_it_was(tmp_path):
    options = {"path": str(tmp_path / "in"), "log": str(tmp_path / "log"), "filesPerBatch": "1"}
    os.mkdir(options["path"])
    (tmp_path / "in" / "a.txt").write_text("one\n")
    (tmp_path / "in" / "b.txt").write_text("two\n")
    first = records.StreamReader(options)
    assert [first.latestOffset()["entry"] for _ in range(3)] == [1, 2, 2]
    before = first.partitions({"entry": 0}, {"entry": 1})
    with open(tmp_path / "in" / "a.txt", "a") as f:
        f.write("more\n")
    again = records.StreamReader(options)
    assert again.latestOffset() == {"entry": 2}
    assert again.partitions({"entry": 0}, {"entry": 1}) == before
    assert [row["content"] for p in before for b in again.read(p) for row in b.to_pylist()] == ["one"]
    assert again.partitions({"entry": 2}, {"entry": 2}) == [records.NOTHING]
