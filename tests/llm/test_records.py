import random
import struct
import zlib

import numpy as np
import pytest

from hashloom.llm import encode, records
from hashloom.scratch import new_path
from tests.llm.helpers import TEXTS, awkward, empty


def test_frames():
    for payload in (b"", b"x", bytes(range(256)) * 300):
        f = records.frame(payload)
        assert struct.unpack("<Q", f[:8])[0] == len(payload) and records.unframe(b"zz" + f, 2) == (payload, 2 + len(f))
        for k in range(0, len(f), 97):
            bad = bytearray(f)
            bad[k] ^= 4
            with pytest.raises((ValueError, struct.error)):
                records.unframe(bytes(bad), 0)
        with pytest.raises((ValueError, struct.error)):
            records.unframe(f[:-1], 0)


def test_payloads():
    for ids in ([], [1, 65535], [1, 65536, 2**32 - 1]):
        for doc in (None, 0, -5, 2**62):
            got = records.ids_of(records.payload_of(doc, np.array(ids, np.uint32)))
            assert got[0] == doc and got[1].tolist() == ids


@pytest.mark.parametrize("options", [{}, {"file_bytes": 64, "block_bytes": 32, "partitions": 3}, {"block_bytes": 32, "partitions": 1}])
def test_round_trip(spark, options):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(encode.vocabulary_path())
    path = new_path(spark, "records-test")
    records.write(awkward(spark), path, **options)
    got = sorted(records.read(spark, path).collect(), key=lambda r: r.start)
    assert sorted(map(str, (r.doc_id for r in got))) == sorted(map(str, (i for i, _ in TEXTS)))
    keys = [(r.doc_id is not None, r.doc_id or 0) for r in got]
    assert keys == sorted(keys)
    at = 0
    texts = {}
    for i, t in TEXTS:
        texts.setdefault(i, []).append(tokenizer.encode(t or "", add_special_tokens=False).ids + [1])
    for r in got:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert ids in texts[r.doc_id] and r.start == at and r.n_tokens == len(ids) and r.ids_crc32 == zlib.crc32(r.ids)
        at += len(ids)
    index = records.read_index(spark, path)
    assert index.count() == len(TEXTS)
    assert records.read(spark, path, with_ids=False).filter("ids is not null").count() == 0


def test_shuffled_reads(spark):
    path = new_path(spark, "records-test")
    records.write(awkward(spark), path, partitions=1)
    data = bytes(records._files(spark, path, "data").first().content)
    entries = records.read_index(spark, path).collect()
    random.Random(1).shuffle(entries)
    for e in entries:
        doc, ids = records.read_at(data, e.byte_offset)
        assert doc == e.doc_id and len(ids) == e.tokens


def test_folders_do_not_grow_with_the_files(spark, tmp_path):
    """Many small blocks share a file; the n-th files of all ranges share a folder; every offset leads to its record."""
    path = str(tmp_path / "r")
    docs = spark.createDataFrame([(k % 50, f"text {k} " * 20) for k in range(400)], "doc_id long, text string")
    records.write(docs, path, partitions=4, block_bytes=500, file_bytes=8000)
    folders = sorted(x.name for x in (tmp_path / "r" / "kind=data").iterdir() if x.is_dir())
    files = list((tmp_path / "r").glob("kind=data/*/part-*"))
    assert 1 < len(folders) < 12 and len(files) >= 4
    got = [(r.doc_id, r.ids_crc32) for r in records.read(spark, path).orderBy("start").collect()]
    assert [d for d, _ in got] == sorted(k % 50 for k in range(400))
    again = str(tmp_path / "again")
    records.write(docs.repartition(7), again, partitions=4)
    assert [(r.doc_id, r.ids_crc32) for r in records.read(spark, again).orderBy("start").collect()] == got


def test_damage_is_found(spark, tmp_path):
    path = str(tmp_path / "r")
    records.write(awkward(spark), path, partitions=1)
    file = next((tmp_path / "r").glob("kind=data/*/part-*"))
    raw = bytearray(file.read_bytes())
    raw[68] ^= 1
    file.write_bytes(bytes(raw))
    for crc in (tmp_path / "r").glob("kind=data/*/.part-*.crc"):
        crc.unlink()
    with pytest.raises(Exception, match="checksum is wrong"):
        records.read(spark, path).collect()


def test_empty(spark):
    path = new_path(spark, "records-test")
    records.write(empty(spark), path)
    assert records.read(spark, path).count() == 0
