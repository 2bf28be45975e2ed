"""Archives against plain digests, through small chunks and files."""

import base64
import gzip
import hashlib
import os

import pytest

from spotgrid.llm import warc


def plain(rows, min_bytes=0):
    """key, bytes, digest, type, refers_to; of repeated rows of the smallest key one is the response."""
    heads, out = {}, []
    ordered = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    for key, payload in ordered:
        data = (payload or "").encode() if not isinstance(payload, bytes) else payload
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        if len(data) >= min_bytes and data in heads:
            out.append((key, len(data), digest, "revisit", heads[data]))
        else:
            heads.setdefault(data, key)
            out.append((key, len(data), digest, "response", None))
    return sorted(out, key=repr)


def through(spark, pages, path, chunk_bytes, file_chunks, min_bytes=0):
    chunks = warc.stored(warc.chunk_records(pages, "page_id", "html", "url", chunk_bytes), "chunks")
    warc.write_archives(chunks, path, min_bytes, file_chunks)
    read = warc.read_archives(spark, path)
    found = warc.resolve_revisits(warc.payload_digests(read))
    return read, found, sorted(((r["key"], r["total"], r["digest"], r["type"], r["refers_to"]) for r in found.collect()), key=repr)


ROWS = [
    (1, "x" * 1000), (2, ""), (3, None), (4, "a\r\n\r\nWARC/1.1\r\n\r\n" * 9), (5, "x" * 1000), (5, "x" * 1000), (7, "é" * 333), (None, "é" * 333),
    (8, "y"), (0, "y"), (9, "z" * 64), (9, "z" * 64), (11, "\r\n"), (12, "\r\n\r\n"),
]


@pytest.mark.parametrize(("chunk_bytes", "file_chunks"), [(64, 3), (1 << 18, 256), (7, 1)])
def test_round_trip(spark, tmp_path, chunk_bytes, file_chunks):
    pages = spark.createDataFrame([(k, p, f"http://h/{k}", "mine") for k, p in ROWS], "page_id long, html string, url string, digest string").repartition(2)
    read, found, got = through(spark, pages, str(tmp_path / "w"), chunk_bytes, file_chunks)
    assert got == plain(ROWS)
    assert max(len(r["data"]) for r in read.collect()) <= chunk_bytes
    responses = found.where("type = 'response'").collect()
    assert all(r["stated"] == r["digest"] for r in responses)


def test_small_payloads_stay_and_files_are_plain_warc(spark, tmp_path):
    pages = spark.createDataFrame([(k, p, None) for k, p in ROWS], "page_id long, html string, url string").coalesce(1)
    path = str(tmp_path / "w")
    assert through(spark, pages, path, 100, 50, min_bytes=64)[2] == plain(ROWS, 64)
    files = sorted(f for f in os.listdir(path) if f.endswith(".gz"))
    text = b"".join(gzip.decompress(open(os.path.join(path, f), "rb").read()) for f in files)
    assert text.startswith(b"WARC/1.1\r\nWARC-Type: ") and text.endswith(b"\r\n\r\n")
    assert text.count(b"WARC-Type: revisit") == 4


def test_binary_payloads_empty_table_and_lost_chunks(spark, tmp_path):
    blob = bytes(range(256)) * 5
    pages = spark.createDataFrame([(1, bytearray(blob), None), (2, bytearray(blob), None)], "page_id long, html binary, url string")
    assert through(spark, pages, str(tmp_path / "b"), 100, 2)[2] == plain([(1, blob), (2, blob)])
    _, found, got = through(spark, pages.where("false"), str(tmp_path / "e"), 100, 2)
    assert got == []
    short = warc.read_archives(spark, str(tmp_path / "b")).where("not last or type = 'revisit'")
    with pytest.raises(Exception, match="has no last chunk"):
        warc.payload_digests(short).collect()


def test_several_gzip_members():
    one = b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    content = gzip.compress(one) + gzip.compress(one.replace(b"abc", b"xyz"))
    assert [b for _, _, b, _ in warc._pieces(content, step=16)] == [b"abc", b"xyz"]
    assert [(n, b, e) for _, n, b, e in warc._pieces(content, 2, 5)] == [(0, b"ab", False), (1, b"c", True), (0, b"xy", False), (1, b"z", True)]


def test_an_oversized_record_of_another_writer_is_never_held():
    """300 MB of payload in one segment: pieces, the digest, and the memory that a process of its own needs more."""
    import subprocess
    import sys

    code = """
import hashlib, resource, zlib
from spotgrid.llm import warc
size, block = 300 << 20, b"ab" * (1 << 19)
pack = zlib.compressobj(9, zlib.DEFLATED, 31)
head = b"WARC/1.1\\r\\nWARC-Type: response\\r\\nWARC-Record-ID: <r>\\r\\nContent-Length: %d\\r\\n\\r\\n" % (size + 4)
content = pack.compress(head + b"\\r\\n\\r\\n") + b"".join(pack.compress(block) for _ in range(size // len(block))) + pack.compress(b"\\r\\n\\r\\n") + pack.flush()
want = hashlib.sha1()
for _ in range(size // len(block)):
    want.update(block)
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
rows = (warc._read_row(*p) for p in warc._pieces(content))
batches = warc._batches(rows, warc._READ_KINDS, 9)
[(*_, total, digest)] = [tuple(r.values()) for b in warc._sum_runs(True)(batches) for r in b.to_pylist()]
assert total == size and digest == warc.base32_sha1(want.digest())
grown = (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) >> 10
assert grown < 100, grown
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.dirname(__file__))), timeout=300)
