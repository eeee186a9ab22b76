"""Damage of archives on disk, read back through Spark."""

import glob
import gzip
import os

import pytest

from assay.llm import warc
from assay.scratch import scratch_path


def archive(spark, n, compression):
    path = scratch_path(spark, "warc-damage")
    df = spark.createDataFrame([(i, f"page {i} " * (i + 1)) for i in range(n)], "page_id long, html string")
    warc.write_warc(df.coalesce(1), path, compression=compression)
    (file,) = [f for f in glob.glob(f"{path}/class=*/part-*")]
    return path, file


def ids(rows):
    return sorted(int(r.record_id) for r in rows if r.kind == "record")


def flip(file, at):
    with open(file, "rb+") as f:
        f.seek(at)
        byte = f.read(1)[0]
        f.seek(at)
        f.write(bytes([byte ^ 0x40]))
    for crc in glob.glob(f"{os.path.dirname(file)}/.*.crc"):
        os.remove(crc)


def test_members_are_plain_gzip(spark):
    path, file = archive(spark, 30, "gzip")
    data = open(file, "rb").read()
    plain = gzip.decompress(data)
    assert plain.count(b"WARC/1.1\r\n") == 30
    assert data.count(warc.MEMBER) >= 30
    rows = warc.read_warc(spark, path).collect()
    assert ids(rows) == list(range(30)) and all(r.kind == "record" for r in rows)


@pytest.mark.parametrize("compression", ["none", "gzip"])
@pytest.mark.parametrize("place", [0.0, 0.37, 0.62, 0.999])
def test_a_flipped_byte_costs_one_record(spark, compression, place):
    path, file = archive(spark, 50, compression)
    size = os.path.getsize(file)
    flip(file, int(size * place))
    rows = warc.read_warc(spark, path).collect()
    assert len(ids(rows)) >= 49
    lost = [r for r in rows if r.kind == "gap"]
    assert len(ids(rows)) == 50 or lost
    spans = sorted({(r.offset, r.length) for r in rows})
    assert sum(n for _, n in spans) == size


def test_head_of_a_broken_member_with_many_records(spark):
    path, file = archive(spark, 40, "none")
    packed = bytearray(gzip.compress(open(file, "rb").read(), mtime=0))
    packed[len(packed) * 3 // 4] ^= 0x10
    rows = list(warc.salvage("x.warc.gz", bytes(packed)))
    found = [r for r in rows if r[3] == "record"]
    assert len(found) >= 10 and {r[4] for r in found} == {"head of a broken member"}
    assert [r[3] for r in rows if r[3] == "gap"] == ["gap"]


def test_records_of_all_sizes(spark, monkeypatch):
    monkeypatch.setattr(warc, "CLASSES", [(10, 3), (100, 2)])
    rows = [(i, "x" * size + str(i)) for i, size in enumerate([0, 1, 2, 3, 4, 50, 60, 70, 500, 600])]
    path = scratch_path(spark, "warc-sizes")
    df = spark.createDataFrame([*rows, (99, None)], "page_id long, html string").coalesce(1)
    warc.write_warc(df, path)
    per_file = {k: [open(f, "rb").read().count(b"WARC/1.1\r\n") for f in glob.glob(f"{path}/class={k}/part-*")] for k in range(3)}
    assert sorted(per_file[0]) == [3, 3] and sorted(per_file[1]) == [1, 2] and per_file[2] == [1, 1]
    got = {int(r.record_id): (r.payload_bytes, r.payload) for r in warc.read_warc(spark, path).collect()}
    assert got == {i: (len(t or ""), (t or "").encode()) for i, t in [*rows, (99, None)]}


def test_empty_table(spark):
    path = scratch_path(spark, "warc-empty")
    for compression in ("none", "gzip"):
        warc.write_warc(spark.createDataFrame([], "page_id long, html string"), path, compression=compression)
        assert warc.read_warc(spark, path).collect() == []
