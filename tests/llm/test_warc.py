import gzip
import hashlib
import io

import pytest
from pyarrow import fs as arrow_fs

from veilspark.llm import warc
from veilspark.llm.common import scratch

BIG = "x" * 150
ROWS = [(i, f"http://h/{i}", ("<p>%d</p>" % (i % 7)) * (40 if i % 3 else 1)) for i in range(60)] + [
    (None, None, BIG), (None, "u\r\nX-Page-ID: 1", BIG), (305, "a", None), (307, "b", ""),
    (300, "c", BIG), (300, "c", BIG), (301, "d", BIG), (None, "z", "q" * 200), (None, "y", "q" * 200), (400, "k", "é漢😀" * 30),
]


def pages(spark, parts):
    return spark.createDataFrame([r + ("clash",) for r in ROWS], "page_id long, url string, html string, shard string").repartition(parts)


def test_round_trip(spark):
    folder = scratch(spark, "warc")
    manifest = warc.write_warc(pages(spark, 4), folder, roll_bytes=3000, shard_bytes=5000).collect()
    rows = warc.read_warc(spark, folder).collect()
    digest = lambda html: hashlib.sha256((html or "").encode()).hexdigest()
    got = sorted((r.page_id or -1, r.payload_bytes, r.payload_digest) for r in rows)
    assert got == sorted((p or -1, len((h or "").encode()), digest(h)) for p, _, h in ROWS)
    groups = {}
    for r in rows:
        groups.setdefault(r.payload_digest, []).append(r)
    for own in groups.values():
        ids = [r.page_id for r in own if r.page_id is not None]
        if own[0].payload_bytes < warc.REVISIT_BYTES:
            assert all(r.record_type == "response" and r.refers_to is None for r in own)
            continue
        responses = [r for r in own if r.record_type == "response"]
        assert len(responses) == 1 and responses[0].page_id == min(ids, default=None)
        assert {r.refers_to for r in own if r.record_type == "revisit"} <= {min(ids, default=None)}
    assert sum(m.records for m in manifest) == len(ROWS) and len(manifest) > 3
    # Files hold as many records as will fit, each a gzip member of its own.
    assert all(m.bytes <= 3000 or m.records == 1 for m in manifest)


def test_same_pages_same_bytes(spark):
    names = []
    for parts in (2, 5):
        made = warc.write_warc(pages(spark, parts), scratch(spark, "warc"), roll_bytes=3000, shard_bytes=5000)
        names.append({(m.file.rsplit("/", 1)[1], m.sha256) for m in made.collect()})
    assert names[0] == names[1]


def test_archives_are_plain_warc(spark):
    folder = scratch(spark, "warc")
    first = warc.write_warc(pages(spark, 2), folder).orderBy("file").first()
    filesystem, path = arrow_fs.FileSystem.from_uri(f"{first.folder}/{first.file}")
    with filesystem.open_input_stream(path, compression=None) as raw:
        data = raw.read()
    assert hashlib.sha256(data).hexdigest() == first.sha256
    records = list(warc._parse(io.BytesIO(gzip.decompress(data))))
    assert records[0][0]["warc-type"] == "warcinfo" and len(records) == first.records + 1
    files = filesystem.get_file_info(arrow_fs.FileSelector(path.rsplit("/", 2)[0], recursive=True))
    assert not [f for f in files if f.path.endswith(".tmp")]


@pytest.mark.parametrize("outlier", [None, 2**60])
def test_ids_far_apart_and_crowded_ids(spark, outlier):
    """One id far from all others puts these into one range, which is split; the many rows of one id as well."""
    rows = [(i, None, "%05d" % i * 20) for i in range(300)] + [(7, None, "%05d" % i * 30) for i in range(300)]
    rows += [(None, None, "%05d" % i * 25) for i in range(200)] + ([(outlier, "far", "x")] if outlier else [])
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    folder = scratch(spark, "warc")
    manifest = warc.write_warc(df, folder, shard_bytes=4_000).collect()
    sizes = {}
    for m in manifest:
        sizes[m.shard] = sizes.get(m.shard, 0) + m.records
    assert max(sizes.values()) < 150 and sum(sizes.values()) == len(rows)
    got = sorted((r.page_id or -1, r.payload_bytes) for r in warc.read_warc(spark, folder).collect())
    assert got == sorted((p or -1, len(h)) for p, _, h in rows)
    again = warc.write_warc(df.repartition(5), scratch(spark, "warc"), shard_bytes=4_000).collect()
    assert {m.sha256 for m in again} == {m.sha256 for m in manifest}


def test_a_repeated_attempt_meets_no_file_of_the_one_before(spark):
    folder = f"{scratch(spark, 'warc')}/data"
    filesystem, path = arrow_fs.FileSystem.from_uri(folder)
    filesystem.create_dir(path, recursive=True)
    done = []
    for attempt in ("attempt-a", "attempt-b"):
        roller = warc._Roller(folder, 3, 1_000, attempt)
        roller.add(warc._member([("WARC-Type", "response"), ("WARC-Record-ID", "<x>")], b"abc"))
        roller.close()
        done.append(roller.done[0])
    assert done[0][0] != done[1][0] and done[0][1:] == done[1][1:]


def test_a_changed_block_is_found():
    member = warc._member([("WARC-Type", "response"), ("WARC-Record-ID", "<x>")], b"abc")
    bad = gzip.decompress(member).replace(b"abc", b"abd")
    with pytest.raises(ValueError):
        list(warc._parse(io.BytesIO(bad)))


def test_no_pages(spark):
    folder = scratch(spark, "warc")
    assert warc.write_warc(pages(spark, 1).limit(0), folder).count() == 0
    assert warc.read_warc(spark, folder).count() == 0
