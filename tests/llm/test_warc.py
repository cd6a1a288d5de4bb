import gzip
import zlib

import pytest

from goldseam.llm import warc

TRICKY = "x\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, tmp_path, least):
    rows = [(1, "http://a", "same"), (9, "http://b c\né", "same"), (3, None, None), (4, "u", ""), (5, "u", TRICKY), (6, "u", TRICKY), (7, "u", "é" * 70000), (8, "u", "line\n"), (9, "again", "same"), (None, "u", TRICKY)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string")
    warc.write_archives(df, str(tmp_path / "w"), least)
    got = warc.read_archives(spark, str(tmp_path / "w")).collect()
    last = {}
    for i, _, h in rows:
        if len((h or "").encode()) >= least:
            last[h or ""] = max(last.get(h or "", -1), -1 if i is None else i)
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        revisit = last.get(h or "", i) != i
        want.append((i, len(b), warc.digest_of(b), "revisit" if revisit else "response", last[h or ""] if revisit else None, None if revisit else b))
    have = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], r["payload"] and bytes(r["payload"]) if r["payload"] is None else bytes(r["payload"])) for r in got]
    assert sorted(have, key=repr) == sorted(want, key=repr)


def test_archives_are_cut_by_size(spark, tmp_path):
    df = spark.range(60).selectExpr("id as page_id", "'http://a' as url", "repeat(cast(id as string), 400) as html").coalesce(1)
    warc.write_archives(df, str(tmp_path / "w"), file_bytes=5000)
    assert len(list((tmp_path / "w").glob("part-*"))) >= 10
    assert sorted(r["page_id"] for r in warc.read_archives(spark, str(tmp_path / "w")).collect()) == list(range(60))


def test_headers_of_the_profile(spark, tmp_path):
    df = spark.createDataFrame([(1, "http://a/x", "same"), (2, "http://b/y", "same"), (3, None, "same2")], "page_id long, url string, html string").coalesce(1)
    warc.write_archives(df, str(tmp_path / "w"))
    records = [r for f in (tmp_path / "w").glob("part-*") for r in warc.parse(gzip.decompress(f.read_bytes()))]
    assert records[0][0]["WARC-Type"] == "warcinfo"
    (revisit,) = (h for h, _ in records if h["WARC-Type"] == "revisit")
    (original,) = (h for h, _ in records if h.get("WARC-Target-URI") == "http://b/y")
    assert revisit["WARC-Refers-To"] == original["WARC-Record-ID"]
    assert (revisit["WARC-Refers-To-Target-URI"], revisit["WARC-Refers-To-Date"]) == ("http://b/y", original["WARC-Date"])


def test_each_record_is_a_gzip_member(spark, tmp_path):
    df = spark.createDataFrame([(i, "http://a", "é\0" * i) for i in range(5)], "page_id long, url string, html string").coalesce(1)
    warc.write_archives(df, str(tmp_path / "w"))
    (file,) = (tmp_path / "w").glob("part-*")
    data, members = file.read_bytes(), []
    while data:
        one = zlib.decompressobj(31)
        members.append(one.decompress(data))
        assert one.eof
        data = one.unused_data
    kinds = [[h["WARC-Type"] for h, _ in warc.parse(m)] for m in members]
    assert kinds == [["warcinfo"], *[["response"]] * 5, []]


def test_archives_of_other_writers(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\nContent-Length: 5\r\n\r\n"
    other = b"".join(
        f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{kind}>\r\n{more}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
        for kind, more, block in (("request", "", b"GET / HTTP/1.1\r\n\r\n"), ("response", "WARC-Target-URI: http://o/\r\n", http + b"hello"), ("revisit", f"WARC-Payload-Digest: sha1:{warc.digest_of(b'hello')}\r\n", http))
    )
    (tmp_path / "part-0.warc.gz").write_bytes(gzip.compress(other[:100]) + gzip.compress(other[100:]))
    got = sorted(tuple(r)[:7] for r in warc.read_archives(spark, str(tmp_path)).collect())
    digest = warc.digest_of(b"hello")
    assert got == [(None, "<response>", "http://o/", "response", 5, digest, None), (None, "<revisit>", None, "revisit", 5, digest, None)]


def test_empty_table(spark, tmp_path):
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "w"))
    assert warc.read_archives(spark, str(tmp_path / "w")).count() == 0


def test_broken_archives_raise():
    with pytest.raises(ValueError):
        list(warc.parse(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc\r\n\r\n"))


def test_digests_and_headers_of_other_writers(spark, tmp_path):
    """Digests of other kinds and forms, names in any case, no blank after the colon, and lines that go on."""
    import hashlib

    body = b"hello"
    http = b"HTTP/1.1 200 OK\r\ncontent-length:5\r\n\r\n"
    sha1 = hashlib.sha1(body)
    digests = {"a": f"sha256:{hashlib.sha256(body).hexdigest()}", "b": f"MD5:{hashlib.md5(body).hexdigest().upper()}", "c": f"sha1:{sha1.hexdigest()}", "d": f"sha1:{warc.digest_of(body).lower()}", "e": "blake9:xyz"}

    def made(name, kind, digest, block):
        return f"WARC/1.0\r\nwarc-type:{kind}\r\nWARC-RECORD-ID:<{name}>\r\nwarc-target-uri: http://o/\r\n  {name}\r\nWarc-Payload-Digest:{digest}\r\ncontent-length:{len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"

    folder = tmp_path / "others"
    folder.mkdir()
    records = [made(n, "response", d, http + body) for n, d in digests.items()] + [made("r", "revisit", digests["a"], http), made("s", "Revisit", digests["d"], http)]
    (folder / "part-0.gz").write_bytes(gzip.compress(b"".join(records)))
    got = {r["record_id"]: r for r in warc.read_archives(spark, str(folder)).collect()}
    assert {got[f"<{n}>"]["payload_digest"] for n in digests} == {warc.digest_of(body)} and got["<a>"]["url"] == "http://o/ a"
    assert got["<r>"]["payload_digest"] is None and got["<s>"]["payload_digest"] == warc.digest_of(body) and got["<r>"]["payload_bytes"] == 5
    (folder / "part-0.gz").write_bytes(gzip.compress(made("x", "response", f"sha256:{hashlib.sha256(b'other').hexdigest()}", http + body)))
    with pytest.raises(Exception, match="doesn't hold the payload"):
        warc.read_archives(spark, str(folder)).collect()
