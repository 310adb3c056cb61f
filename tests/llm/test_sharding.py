"""Sharding against its law, brute force, and odd inputs."""

import hashlib
import zlib

import pytest

import scorewright.llm.sharding as sharding
from helpers import DOCS, ODD
from scorewright.llm.sharding import shard, write_shards

NAMES = ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]


def brute_force(rows, shards):
    """Shard of each row by one pass over all rows in the order of the key."""
    keyed = []
    for doc_id, text in rows:
        data = (text or "").encode()
        keyed.append((int(hashlib.md5(data).hexdigest()[:15], 16), doc_id is not None, doc_id or 0, len(data) + 8, zlib.crc32(data)))
    keyed.sort()
    total, at, begin, together = sum(k[3] for k in keyed), 0, {}, {}
    for h, _, _, size, _ in keyed:
        begin.setdefault(h, at)
        together[h] = together.get(h, 0) + size
        at += size
    at, out, used = 0, [], {}
    for h, known, doc_id, size, crc in keyed:
        twice = 2 * begin[h] + together[h] if together[h] * 100 * shards <= total else 2 * at + size
        place = twice * shards // (2 * total)
        slot = used.get(place, 0)
        used[place] = slot + 1
        out.append((doc_id if known else None, size, crc, "bytes", place, slot, None))
        at += size
    return out


def sharded(spark, rows, shards, parts=3):
    found = shard(spark.createDataFrame(rows, DOCS).repartition(parts), shards)
    assert found.columns == NAMES
    return [tuple(row) for row in found.collect()]


def order(rows):
    return sorted(rows, key=lambda r: (r[4], r[5]))


def test_odd_rows(spark):
    # The two equal rows may change places.
    assert sorted(map(str, sharded(spark, ODD, 5))) == sorted(map(str, brute_force(ODD, 5)))


def test_no_rows(spark):
    empty = shard(spark.createDataFrame([], DOCS))
    assert empty.columns == NAMES and empty.collect() == []


def test_copies_beyond_a_shard_are_cut_and_others_stay_together(spark, monkeypatch):
    """A third of all rows is one text, some of them even one row; many small groups."""
    monkeypatch.setattr(sharding, "RANGE_ROWS", 100)
    rows = [(i, f"text {i % 700} " + "x" * (i % 40)) for i in range(2000)]
    rows += [(i, "the same text in many documents") for i in range(2000, 2600)] + [(7, "one row")] * 500
    got = sharded(spark, rows, 6)
    assert order(got) == order(brute_force(rows, 6))
    sizes = [sum(r[1] for r in got if r[4] == s) for s in range(6)]
    assert max(sizes) - min(sizes) <= sum(sizes) / 6 / 100 + max(r[1] for r in got)
    small = {}
    for doc_id, _, crc, _, place, _, _ in got:
        if doc_id < 2000 and doc_id != 7:
            small.setdefault(crc, set()).add(place)
    assert all(len(places) == 1 for places in small.values())


@pytest.mark.parametrize("parts", [1, 7])
def test_partitions_change_nothing(spark, parts):
    rows = [(i, "wort " * (i * i % 97)) for i in range(500)]
    assert order(sharded(spark, rows, 24, parts)) == order(brute_force(rows, 24))


def test_one_huge_row(spark):
    """A text of two megabytes is a shard of its own, and those that its bytes cover stay empty."""
    rows = [(1, "ä" * 1_000_000)] + [(i, "short") for i in range(2, 50)]
    assert order(sharded(spark, rows, 8)) == order(brute_force(rows, 8))


def test_overfull_ranges_are_subdivided(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RANGE_ROWS", 20)
    rows = spark.createDataFrame([(i, "short" if i % 3 else f"text {i}" * 9) for i in range(900)], DOCS)
    narrow = sharding._narrow(rows, "doc_id", "text").cache()
    n, size = 900, narrow.groupBy().sum("size").first()[0]
    cuts, sums = sharding.splitters(narrow, n, size, 2)
    assert cuts == sorted(set(cuts)) and sum(v[0] for v in sums.values()) == n
    # No range holds the 600 copies of one text.
    assert max(v[0] for v in sums.values()) < 200


def test_files_hold_every_row_in_its_shard(spark, tmp_path):
    rows = [(i, f"text {i % 30}", "s", i) for i in range(300)] + [(None, None, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, size string, _h long")
    write_shards(docs, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(str, back.select("doc_id", "text", "size", "_h").collect())) == sorted(map(str, docs.collect()))
    placed = {(r.doc_id, r.shard, r._slot) for r in back.collect()}
    assert placed == {(r.doc_id, r.shard, r.slot) for r in shard(docs, 4).collect()}
