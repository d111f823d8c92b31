"""Data sources: ranges, members, pushed filters, odd files."""

from __future__ import annotations

import gzip
import json
import random
import zipfile

import pytest
from pyarrow import fs as pafs
from pyspark.sql import functions as F

from tremolo.sources import annotated, readers, sinks


@pytest.fixture(scope="module", autouse=True)
def sources(spark):
    annotated.register(spark)


def corpus(n, seed=1):
    draw = random.Random(seed)
    out = []
    for i in range(n):
        lines = [f"{i}|t|Titel é {i}", f"{i}|a|" + "word " * draw.randint(0, 30)] + [f"{i}\t{k}\t{k + 3}\tm{k}\tT1\tUMLS:C{k}" for k in range(draw.randint(0, 4))]
        out.append("\n".join(lines))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_every_block_is_read_once_whatever_the_ranges(tmp_path, seed):
    draw = random.Random(seed)
    made = corpus(40, seed)
    path = tmp_path / "c.txt"
    path.write_text("".join(b + "\n" * draw.choice([2, 2, 3, 5]) for b in made) if seed else "\n\n\n" + "\n\n".join(made))
    size = path.stat().st_size
    for width in (1, 7, 50, 333, size + 9):
        got = [b for at in range(0, size, width) for b in annotated.blocks(pafs.LocalFileSystem(), annotated.Range(str(path), at, min(size, at + width)), read_bytes=draw.choice([3, 64, 1 << 20]))]
        assert [b.strip("\n") for b in got] == made


def test_blocks_agree_with_the_text_reader(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a.txt").write_text("\n\n".join(corpus(30, 1)) + "\n")
    with gzip.open(tmp_path / "p" / "b.txt.gz", "wt") as f:
        f.write("\n\n".join(corpus(9, 2)))
    (tmp_path / "p" / "empty.txt").write_text("")
    key = lambda r: tuple(map(str, r))
    got = spark.read.format("pubtator_blocks").option("rangeBytes", 100).load(str(tmp_path / "p"))
    want = readers.pubtator(spark, str(tmp_path / "p" / "a.txt")).unionByName(readers.pubtator(spark, str(tmp_path / "p" / "b.txt.gz")))
    assert sorted(got.collect(), key=key) == sorted(want.collect(), key=key) and got.rdd.getNumPartitions() > 5
    one = got.where("pmid = '3'")
    assert one.count() == want.where("pmid = '3'").count() > 0
    assert "PushedFilters" in one._jdf.queryExecution().toString() or "pmid" in one._jdf.queryExecution().toString()


def test_standoff_with_texts(spark, tmp_path):
    (tmp_path / "ann").mkdir()
    (tmp_path / "txt").mkdir()
    (tmp_path / "ann" / "d1.ann").write_text("T1\t22298006 0 5\theart\nT2\tCONCEPT_LESS 6 9\tbad\r\nT3\t22298006 0 5;8 9\tsplit\nT4\tbroken\nR1\tother\n\n")
    (tmp_path / "ann" / "d2.ann").write_text("T1\t22298006 0 3\tnot\n")
    (tmp_path / "ann" / "d3.ann").write_text("")
    (tmp_path / "txt" / "d1.txt").write_text("heart bad day")
    rows = spark.read.format("standoff_documents").option("texts", str(tmp_path / "txt")).load(str(tmp_path / "ann"))
    got = {(r.doc_id, r.ann_id): (r.status, r.start, r.end, r.text, r.in_text) for r in rows.collect()}
    assert got == {
        ("d1", "T1"): ("ok", 0, 5, "heart bad day", True), ("d1", "T2"): ("concept_less", 6, 9, "heart bad day", True), ("d1", "T3"): ("discontinuous", 0, 9, "heart bad day", False),
        ("d1", "T4"): ("malformed", None, None, "heart bad day", False), ("d2", "T1"): ("ok", 0, 3, "", False),
    }
    assert rows.where("doc_id = 'd2'").count() == 1 and rows.where(F.col("status").isin("ok", "malformed")).count() == 3
    assert rows.where("doc_id = 'none'").count() == 0
    lines = {(r.doc_id, r.ann_id): (r.status, r.start, r.end) for r in readers.standoff(spark, str(tmp_path / "ann")).collect()}
    assert lines == {k: v[:3] for k, v in got.items()}


def test_members_and_answers(spark, tmp_path):
    for name, questions in (("a", [{"id": "1", "type": "factoid", "body": "q", "exact_answer": [["x", "y"], ["x"]]}, {"id": "2", "type": "yesno", "exact_answer": "yes"}]), ("b", [{"id": "3", "type": "factoid"}])):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as z:
            z.writestr(f"in/{name}.json", json.dumps({"questions": questions}))
            z.writestr("other.txt", "x")
    rows = spark.read.format("zipped_questions").load(str(tmp_path))
    assert sorted((r.archive, r.member, r.id, r.type, tuple(r.answers)) for r in rows.collect()) == [("a.zip", "in/a.json", "1", "factoid", ("x", "y")), ("a.zip", "in/a.json", "2", "yesno", ("yes",)), ("b.zip", "in/b.json", "3", "factoid", ())]
    assert rows.where("type = 'factoid'").count() == 2 and rows.where("member = 'in/b.json'").count() == 1 and rows.rdd.getNumPartitions() == 2


def test_frozen_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "PART_BYTES", 5)
    for folder, files in (("a", {"x": "12345678901", "sub/y": "", "z": "1"}), ("b", {"x": "12345678901", "sub/y": "no", "new": "1"})):
        for name, body in files.items():
            (tmp_path / folder / name).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / folder / name).write_text(body)
    a, b = (sinks.relative(sinks.file_hashes(spark, str(tmp_path / f)), str(tmp_path / f)) for f in "ab")
    assert {r.path: r.n_bytes for r in a.collect()} == {"x": 11, "sub/y": 0, "z": 1}
    assert {r.path: r.status for r in sinks.frozen_changes(a, b).collect()} == {"x": "same", "sub/y": "changed", "z": "gone", "new": "new"}
