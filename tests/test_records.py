"""Shards of framed records: checksums, ranges, damage, writing, and examples within."""

from __future__ import annotations

import os
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F
from wayline.sources import checksums, files, records


def plain_crc(b):
    table = []
    for i in range(256):
        for _ in range(8):
            i = (i >> 1) ^ (0x82F63B78 if i & 1 else 0)
        table.append(i)
    c = 0xFFFFFFFF
    for x in b:
        c = table[(c ^ x) & 255] ^ (c >> 8)
    return c ^ 0xFFFFFFFF


def framed_bytes(contents):
    mask = lambda c: ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF
    out = b""
    for c in contents:
        n = struct.pack("<Q", len(c))
        out += n + struct.pack("<I", mask(plain_crc(n))) + c + struct.pack("<I", mask(plain_crc(c)))
    return out


def contents_of(seed, n, most=900):
    rng = random.Random(seed)
    return [rng.randbytes(rng.choice([0, 1, 7, rng.randrange(most)])) for _ in range(n)]


def test_checksums():
    assert hex(checksums.crc32c([b"123456789"])[0]) == "0xe3069283" and checksums.crc32c([]).tolist() == []
    rng = random.Random(0)
    strings = [rng.randbytes(n) for n in [*range(140), 4_097, 0, 64, 128]]
    assert checksums.crc32c(strings).tolist() == [plain_crc(s) for s in strings]
    w = np.frombuffer(rng.randbytes(800), dtype=np.uint8).reshape(-1, 8)
    assert checksums.masked_of_lengths(w).tolist() == checksums.masked(checksums.crc32c([x.tobytes() for x in w])).tolist()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("shards")
    for k in range(3):
        (d / f"a-train.tfrecord-{k:05d}-of-00003").write_bytes(framed_bytes(contents_of(k, 150)))
    (d / "empty").write_bytes(b"")
    (d / "_left").write_bytes(b"not a shard")
    return d


@pytest.mark.parametrize("range_bytes", [0, 97, 1_000, 10_000, 1 << 20])
def test_ranges_give_the_rows_of_one_task(spark, folder, range_bytes):
    """However shards are cut, records come once, in their places; also where a content holds bytes that look like lengths."""
    df = records.framed(spark, str(folder), range_bytes)
    assert (df.rdd.getNumPartitions() > 3) == (0 < range_bytes < 60_000)
    placed = records.with_places(df, records.framed(spark, str(folder), range_bytes, contents=False))
    got = sorted((os.path.basename(r["path"]), r["place"], bytes(r["content"])) for r in placed.collect())
    assert got == sorted((f"a-train.tfrecord-{k:05d}-of-00003", i, c) for k in range(3) for i, c in enumerate(contents_of(k, 150)))
    assert placed.where("fault is not null or size <> octet_length(content)").count() == 0


def test_paths_and_patterns(spark, folder, tmp_path):
    one = str(folder / "a-train.tfrecord-00001-of-00003")
    assert records.framed(spark, one).count() == records.framed(spark, f"file://{one}").count() == 150
    assert records.framed(spark, f"{folder}/a-*-0000[01]-*").count() == 300
    assert records.framed(spark, str(folder / "empty")).count() == 0
    with pytest.raises(Exception, match="nowhere"):
        records.framed(spark, str(tmp_path / "nowhere")).count()


def test_records_that_hold_shards(spark, tmp_path):
    """A record of framed bytes is read whole if its shard is one range."""
    inner = framed_bytes(contents_of(9, 20))
    (tmp_path / "s").write_bytes(framed_bytes([inner, b"x", inner]))
    assert [bytes(r["content"]) for r in records.framed(spark, str(tmp_path), 0).orderBy("start").collect()] == [inner, b"x", inner]


def damaged(contents, kind, k):
    """A shard in which record k is damaged."""
    before = len(framed_bytes(contents[:k]))
    b = bytearray(framed_bytes(contents))
    if kind == "length":
        b[before + 2] ^= 1
    elif kind == "content":
        b[before + 12 + len(contents[k]) // 2] ^= 16
    else:
        b = b[: before + 12 + len(contents[k]) // 2]
    return bytes(b), before


@pytest.mark.parametrize("kind", ["length", "content", "end"])
@pytest.mark.parametrize("range_bytes", [0, 301, 5_000])
def test_damage_is_found_and_the_rest_read(spark, tmp_path, kind, range_bytes):
    contents = [bytes([i]) * (50 + 7 * i) for i in range(60)]
    shard, at = damaged(contents, kind, 25)
    (tmp_path / "s").write_bytes(shard)
    rows = records.framed(spark, str(tmp_path), range_bytes, bad="keep").orderBy("start").collect()
    assert [(r["start"], r["fault"]) for r in rows if r["fault"]] == [(at, kind)]
    rest = contents[:25] + (contents[26:] if kind != "end" else [])
    assert [bytes(r["content"]) for r in rows if r["fault"] is None] == rest
    with pytest.raises(Exception, match=rf"damaged record \({kind}\) in .* at {at}"):
        records.framed(spark, str(tmp_path), range_bytes).count()


def test_two_damaged_lengths_and_random_bytes_at_the_end(spark, tmp_path):
    contents = contents_of(4, 80)
    b = bytearray(framed_bytes(contents))
    starts = [len(framed_bytes(contents[:k])) for k in (10, 11, 40)]
    for s in starts:
        b[s + 8] ^= 255
    (tmp_path / "s").write_bytes(bytes(b) + random.Random(1).randbytes(500))
    for range_bytes in (0, 777):
        rows = records.framed(spark, str(tmp_path), range_bytes, bad="keep").orderBy("start").collect()
        assert [bytes(r["content"]) for r in rows if r["fault"] is None] == [c for k, c in enumerate(contents) if k not in (10, 11, 40)]
        # in one range a stretch that cannot be read is one row
        assert {starts[0], starts[2]} <= {r["start"] for r in rows if r["fault"] == "length"}


def test_sparse_shard_over_two_gigabytes(spark, tmp_path):
    """Offsets beyond 32 bits, without reading what lies between."""
    n = (1 << 31) + 5
    length = struct.pack("<Q", n)
    head = framed_bytes([b"first"]) + length + checksums.masked(checksums.crc32c([length])).tobytes()
    with open(tmp_path / "s", "wb") as f:
        f.write(head)
        f.seek(len(head) + n + 4)
        f.write(framed_bytes([b"last"]))
    rows = records.framed(spark, str(tmp_path), 0, contents=False).orderBy("start").collect()
    assert [r["size"] for r in rows] == [5, n, 4]
    last = records.Shard(str(tmp_path / "s"), len(head) + n + 4 + 20)
    assert last.first_from(len(head) + n - 100, last.total) == len(head) + n + 4


def test_written_shards(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.range(500).select("id", F.expr("cast(repeat(cast(id as string), cast(id % 9 as int)) as binary)").alias("content")).repartition(4)
    records.write_framed(df, path)
    names = sorted(os.listdir(path))
    assert len(names) == 4 and all(n.startswith("part-") for n in names)
    wanted = sorted(str(i).encode() * (i % 9) for i in range(500))
    assert sorted(bytes(r["content"]) for r in records.framed(spark, path, 333).collect()) == wanted
    records.write_framed(df.limit(7).coalesce(1), path)
    assert records.framed(spark, path).count() == 507
    records.write_framed(df.where("id < 20"), path, "overwrite")
    assert records.framed(spark, path).count() == 20
    with pytest.raises(Exception, match="must not be null"):
        records.write_framed(spark.range(1).select(F.lit(None).cast("binary").alias("content")), path)
    assert records.framed(spark, path).count() == 20


def test_examples_there_and_back(spark):
    rows = [(1, [0.5, -1.0, 2.0], [3, -4], "go", [b"\xff", b""]), (2, [], None, "", []), (3, [1.0], [1 << 40], "é", [b"x"])]
    schema = "traj long, action array<float>, ids array<long>, text string, blobs array<binary>"
    coded = files.as_examples(spark.createDataFrame(rows, schema), ["action", "ids", "text", "blobs"])
    bad = spark.createDataFrame([(4, b"\x0a\xff\xff\xff\xff\xff"), (5, b"\x0a")], "traj long, content binary")
    both = coded.select("traj", "content").union(bad).withColumn("fault", F.lit(None).cast("string"))
    got = {r["traj"]: r for r in files.parse_examples(both, "action array<float>, ids array<long>, text string, blobs array<binary>, more array<long>").collect()}
    assert got[1]["action"] == [0.5, -1.0, 2.0] and got[1]["ids"] == [3, -4] and got[1]["text"] == "go" and [bytes(b) for b in got[1]["blobs"]] == [b"\xff", b""] and got[1]["more"] is None
    assert got[2]["action"] == [] and got[2]["ids"] == [] and got[2]["text"] == "" and got[3]["ids"] == [1 << 40] and got[3]["text"] == "é"
    assert got[4]["fault"] == got[5]["fault"] == "fields" and got[4]["action"] is None and got[1]["fault"] is None
    wrong = files.parse_examples(both, "text array<float>").where("traj = 1").first()
    assert wrong["fault"] == "fields" and wrong["text"] is None


def test_steps_of_episodes(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0, 3.0, 4.0], ["x", "y"]), ("b", [], []), ("c", [5.0, 6.0], []), ("d", None, None)], "traj string, action array<double>, text array<string>")
    got = [tuple(r) for r in files.episode_steps(df, {"action": 2, "text": 1}).orderBy("traj", "t").collect()]
    assert got == [("a", 0, [1.0, 2.0], "x"), ("a", 1, [3.0, 4.0], "y"), ("c", 0, [5.0, 6.0], None)]
