import gzip
import hashlib
import io
import zlib

import pytest

from corvane.llm import store, warc

BODY = "é<p>" + "x" * 200


def archive(*records):
    return b"".join(gzip.compress(r) for r in records)


def read(data, size=7):
    stream = io.BytesIO(data)
    return list(warc.read_records(lambda n: stream.read(min(n, size))))


def make(key, payload, refers=None):
    return warc.make_record(key, "http://a/b", payload, refers, hashlib.sha256(payload).hexdigest())


@pytest.mark.parametrize("size", [1, 7, 65536])
def test_members_are_read_in_any_steps(size):
    payloads = [b"", b"\r\n\r\n", BODY.encode(), b"WARC/1.1\r\n\r\n" * 30]
    got = read(archive(*(make(str(i), p) for i, p in enumerate(payloads)), make("9", BODY.encode(), "2")), size)
    assert [(r["record_id"], r["payload"], r["payload_bytes"], r["problem"]) for r in got[:4]] == [(str(i), p, len(p), None) for i, p in enumerate(payloads)]
    assert (got[4]["record_type"], got[4]["refers_to"], got[4]["payload_bytes"], got[4]["payload"], got[4]["problem"]) == ("revisit", "2", len(BODY.encode()), None, None)


def test_damage_is_told():
    good = make("1", BODY.encode())
    assert read(archive(good.replace(b"xxxx", b"yyyy", 1)))[0]["problem"] == "bad block digest"
    assert read(archive(good[:-4]))[0]["problem"] == "bad length"
    assert read(archive(b"no header\r\n\r\n"))[0]["problem"]
    assert [r["problem"] for r in read(archive(good) + archive(good)[:40])] == [None, "cut short"]
    assert [r["problem"] for r in read(archive(good) + b"junk")] == [None, "not gzip"]
    assert read(b"") == [] and zlib is not None


@pytest.mark.parametrize("few", [200_000, 0])
def test_round_trip(spark, monkeypatch, few):
    monkeypatch.setattr(warc, "BROADCAST_DIGESTS", few)
    rows = [(5, "http://a/5", BODY, 1), (3, "http://a/3", BODY, 1), (9, None, BODY, 1), (9, None, BODY, 1), (None, "u", BODY, 1), (4, "a\r\nb", "short", 1), (6, "c", "short", 1), (7, "d", None, 1), (8, "e", "", 1), (10, "f", "z" * 300_000, 1), (3, "http://a/3", BODY, 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest int").repartition(3)
    folder = store.fresh_path(spark, "warc")
    got = warc.read_archives(warc.write_archives(df, folder), folder).collect()
    assert len(got) == len(rows) and {r.problem for r in got} == {None}
    by = {}
    for r in got:
        by.setdefault(r.record_id, []).append(r)
    for key, url, html, _ in rows:
        r = by[str(key) if key is not None else ""][0]
        data = (html or "").encode()
        assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha256(data).hexdigest())
        assert r.url == (url.replace("\r", "%0D").replace("\n", "%0A") if url else None)
        if r.record_type == "response":
            assert bytes(r.payload) == data
    kinds = {k: [(r.record_type, r.refers_to) for r in v] for k, v in by.items()}
    assert kinds["3"] == [("response", None)] * 2 and kinds["5"] == kinds[""] == [("revisit", "3")] and kinds["9"] == [("revisit", "3")] * 2
    assert {kinds[k][0] for k in ("4", "6", "7", "8", "10")} == {("response", None)}
    empty = warc.write_archives(df.limit(0), folder + "-empty")
    assert warc.read_archives(empty, folder + "-empty").count() == 0


def test_a_folder_without_scheme_is_on_the_default_file_system(spark, tmp_path):
    """Spark and tasks must agree on it."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    default = conf.get("fs.defaultFS")
    assert store.qualified(spark, f"{tmp_path}/ck/") == f"file://{tmp_path}/ck"
    try:
        conf.set("fs.defaultFS", "viewfs://cluster/")
        conf.set("fs.viewfs.mounttable.cluster.link./shared", f"file://{tmp_path}/shared")
        assert store.qualified(spark, "/shared/ck") == "viewfs://cluster/shared/ck"
        assert store.qualified(spark, f"file:{tmp_path}/ck") == f"file://{tmp_path}/ck"
    finally:
        conf.set("fs.defaultFS", default or "file:///")
