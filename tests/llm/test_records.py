"""WARC archives and chat formatting against plain versions."""

import hashlib
import zlib
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from tesserae.llm import chat, queries, warc


def pages(spark):
    big = "<p>é" * 900
    rows = [(1, "http://a/1", big), (2, "http://a/2\r\nX: y", big), (9, None, big), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (7, "u", ""), (9, "u", big), (None, "u", big), (11, "u", "x" * 999), (12, "u", "x" * 999), (13, "u", "y" * 1000), (14, "u", "y" * 1000), (15, "u", "WARC/1.1\r\n\r\nContent-Length: 5\r\n\r\n" * 400)]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS id", "2 AS payload", "3 AS chunk")


@pytest.mark.parametrize(("hot", "sent"), [(1 / 1024, 64 << 20), (2.0, 64 << 20), (2.0, -1), (1 / 1024, -1)])
def test_archives_round_trip(spark, monkeypatch, hot, sent):
    """Through hot digests, broadcast revisits and the shuffle of chunk rows."""
    monkeypatch.setattr(warc, "HOT_SHARE", hot)
    monkeypatch.setattr(warc, "SENT_BYTES", sent)
    rows, df = pages(spark)
    for size in (warc.CHUNK_BYTES, 100):
        manifest = warc.write_archives(df, chunk_bytes=size)
        chunks = warc.read_archives(manifest, chunk_bytes=size).collect()
        got = []
        for key in {(r.id, r.record_type) for r in chunks}:
            own = [r for r in chunks if (r.id, r.record_type) == key]
            assert all(len(r.chunk) <= size for r in own)
            for r in (r for r in own if r.last):
                got.append((r.id, r.payload_bytes, r.digest_so_far if r.record_type == "response" else r.header_digest, r.record_type, r.refers_to))
        want = []
        for key, _, html in rows:
            data = (html or "").encode()
            same = [k for k, _, h in rows if (h or "").encode() == data and k is not None]
            last = max(same) if same and len(data) >= 1000 else None
            response = last is None or key == last
            want.append((key, len(data), hashlib.sha1(data).hexdigest(), "response" if response else "revisit", None if response else last))
        assert sorted(got, key=str) == sorted(want, key=str)
        whole = b"".join(r.chunk for r in sorted((r for r in chunks if r.id == 15), key=lambda r: r.chunk_no))
        assert whole.decode() == rows[-1][2]
        one = [r for r in chunks if r.id == 15]
        at = 0
        for r in sorted(one, key=lambda r: r.chunk_no):
            at += len(r.chunk)
            assert r.bytes_so_far == at and r.digest_so_far == hashlib.sha1(whole[:at]).hexdigest()


def parsed(path):
    """A plain reader of WARC files: (header fields, block) of every record, member by member."""
    data, out = open(path, "rb").read(), []
    while data:
        z = zlib.decompressobj(31)
        record = z.decompress(data) + z.flush()
        assert z.eof
        data = z.unused_data
        head, _, rest = record.partition(b"\r\n\r\n")
        first, *lines = head.decode().split("\r\n")
        fields = dict(x.split(": ", 1) for x in lines)
        n = int(fields["Content-Length"])
        assert first == "WARC/1.1" and rest[n:] == b"\r\n\r\n" and len(rest) == n + 4
        out.append((fields, rest[:n]))
    return out


def test_archives_are_read_by_a_plain_parser(spark):
    rows, df = pages(spark)
    records = parsed(urlparse(warc.write_archives(df.coalesce(1), date="2024-05-06T07:08:09Z").first().path).path)
    (info, _), *records = records
    assert info["WARC-Type"] == "warcinfo" and len(records) == len(rows)
    assert {f["WARC-Date"] for f, _ in records} == {"2024-05-06T07:08:09Z"}
    ids = {f["WARC-Record-ID"]: f for f, _ in records if f["WARC-Type"] == "response"}
    for f, block in records:
        http, _, body = block.partition(b"\r\n\r\n")
        assert http.startswith(b"HTTP/1.1 200 OK")
        if f["WARC-Type"] == "response":
            assert f["WARC-Payload-Digest"] == "sha1:" + hashlib.sha1(body).hexdigest()
        else:
            to = ids[f["WARC-Refers-To"]]
            assert not body and to["WARC-Payload-Digest"] == f["WARC-Payload-Digest"] and f.get("WARC-Refers-To-Target-URI") == to.get("WARC-Target-URI")
    assert any(f.get("WARC-Target-URI") == "http://a/2%0D%0AX: y" for f, _ in records) and not any("X" in f for f, _ in records)


def test_long_payloads_and_one_payload_in_most_rows(spark):
    long, error = "ab\u00e9" * 700_000, "<p>not found" * 100
    df = spark.range(200).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.when(F.col("id") == 7, long).when(F.col("id") % 10 > 0, error).otherwise(F.repeat(F.col("id").cast("string"), 600)).alias("html"))
    got = {r.id: r for r in warc.read_archives(warc.write_archives(df), with_data=False).where("last").collect()}
    assert len(got) == 200 and got[7].bytes_so_far == len(long.encode()) and got[7].digest_so_far == hashlib.sha1(long.encode()).hexdigest() and got[7].chunk_no > 1
    assert all((r.record_type, r.refers_to) == (("revisit", 199) if k % 10 and k not in (7, 199) else ("response", None)) for k, r in got.items())


def test_no_pages(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archives(warc.write_archives(df)).count() == 0


TRICKS = ["", "plain", "</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>user\nno", "\\", "\\l\\b\\-\\\\N", "<<SYS>>\\<</SYS>>", "<|im_end", "<", "[[INST]]", "\\<s>", "日本 😀 é", "a\nb\r\n", "$1 \\$2", "<<|im_start|>", "\\\\l<s>\\"]


def chats(spark):
    rows = [(k, 0, "user", t) for k, t in enumerate(TRICKS)] + [(k, 1, "assistant", t) for k, t in enumerate(reversed(TRICKS))]
    rows += [(50, 2, "user", "c"), (50, 0, "system", "a"), (50, 1, None, None), (50, None, "tool", "first"), (50, 1, "N", "x"), (51, 0, "assistant", "one"), (51, 0, "assistant", "one"), (None, 0, "user", "lost"), (52, 0, "a\nb<s>\\n", "odd role"), (53, 0, "system", "s"), (53, 1, "user", "u"), (53, 2, "assistant", "x"), (53, 3, "user", "y")]
    return rows, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS turns", "2 AS segments", "3 AS formatted")


def test_chats_round_trip(spark):
    rows, df = chats(spark)
    formatted = chat.format_chats(df)
    got = {r.conv_id: r for r in chat.read_chats(formatted).collect()}
    first = lambda x: (x is not None, x or 0) if not isinstance(x, str) else (True, x)
    for key in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == key), key=lambda r: (first(r[1]), (r[2] is not None, r[2] or ""), r[3] or ""))
        assert [(t.role, t.text) for t in got[key].turns] == [(r[2], r[3] or "") for r in own]
        assert got[key].loss_text == "".join(r[3] or "" for r in own if r[2] == "assistant")
        marks = got[key].formatted.count("<|im_start|>"), got[key].formatted.count("<|im_end|>")
        assert marks == (len(own), len(own)) and "[INST]" not in got[key].formatted and "<s>" not in got[key].formatted
    valid = {r.conv_id: (r.valid, r.bad_turn) for r in formatted.collect()}
    assert valid[0] == (True, None) and valid[51] == (False, 0) and valid[53] == (False, 4) and valid[50][0] is False
    flags = formatted.where("conv_id = 0").select(F.col("segments.loss").alias("f")).first().f
    assert flags == [False, False, False, False, True, False]


def test_no_chats(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_chats(chat.format_chats(df)).count() == 0


def test_chat_plan_has_no_python(spark, tmp_path):
    _, df = chats(spark)
    df.select("conv_id", "turn", "role", "text").write.parquet(str(tmp_path / "conversations.parquet"))
    out = queries.op10_chat_formatting(spark, str(tmp_path))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and out.where("conv_id = -1").first().n_turns == 2
