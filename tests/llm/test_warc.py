"""WARC input and HTML reading: linear time, codings, damaged files, a round trip with all record types."""

import gzip
import html
import io
import random
import time
import zlib

import pytest

from linkledger.llm import markup, warc

PIECES = ["<a ", "<!--", "<script>", "<style", "<p a=\"", "<title>", "</", "&#9", "<a href=\"x>y\" ", "<head>", "<template>", "<!", "<a href='", "<textarea>x</textarea", "<p =", "\n ", "<b "]


@pytest.mark.parametrize("piece", PIECES)
def test_hostile_markup_takes_linear_time(piece):
    def seconds(size):
        text, best = piece * (size // len(piece)), 9.0
        for _ in range(3):
            start = time.perf_counter()
            markup.read_page(text)
            best = min(best, time.perf_counter() - start)
        return best

    small, large = seconds(1 << 16), seconds(1 << 20)
    assert large < 4 and large < 64 * small + 0.2


def test_any_order_of_pieces_is_read():
    rng = random.Random(3)
    pieces = [*PIECES, "text", ">", "\"", "'", "-->", "</script>", "</title >", "</head>", "</template>", "&amp;", "<body>", "<br/>", "é"]
    for _ in range(2000):
        page = markup.read_page("".join(rng.choices(pieces, k=rng.randint(0, 30))))
        assert page.text == page.text.strip() or page.text.strip("\n ") == page.text


def test_parts_of_a_page():
    page = markup.read_page('<html><head><TITLE>A &amp; b</TITLE><style>p{}</style></head><body><div title="x>y">hi</div><a class=c HREF="/1?a&amp;b">one</a> <a name=n>none</a>'
                            '<a title=" href=2">none</a><template><a href=3>no</template><noscript><a href=4></noscript><!-- <a href=5> --><svg><title>t</title></svg>a < b &#65; &#0000000066;</body>')
    assert page.title == "A & b" and page.links == ["/1?a&b"]
    assert page.text == "hi\none nonenone a < b A B"
    assert markup.read_page("&#" + "9" * 6000 + ";x").text == "�x" and markup.read_page("&#" + "0" * 6000 + "65;").text == "A"
    assert markup.read_page("<head>lost<p>kept").text == "kept" and markup.read_page("a<!-->b").text == "a b"


def chunks(data, size=7):
    return b"".join(b"%x;n=v\r\n%s\r\n" % (len(data[i:i + size]), data[i:i + size]) for i in range(0, len(data), size)) + b"0\r\n\r\n"


def test_codings_are_undone():
    text = b"<p>" + b"some text \xc3\xa9 " * 300
    raw = zlib.compressobj(wbits=-15)
    for head, body in [("Content-Encoding: gzip", gzip.compress(text)), ("content-encoding: X-GZIP", gzip.compress(text[:9]) + gzip.compress(text[9:])),
                       ("Content-Encoding: deflate", zlib.compress(text)), ("Content-Encoding: deflate", raw.compress(text) + raw.flush()), ("Transfer-Encoding: chunked", chunks(text)),
                       ("Content-Encoding: gzip\r\nTransfer-Encoding: chunked", chunks(gzip.compress(text))), ("Content-Encoding: deflate, gzip", gzip.compress(zlib.compress(text))),
                       ("Content-Encoding: identity", text), ("", text)]:
        assert warc.body_of(body, "HTTP/1.1 200 OK\r\n" + head) == (text, []), head


def test_codings_that_fail_have_a_result():
    text = bytes(random.Random(1).choices(b"abcdefgh ", k=5000))
    packed = gzip.compress(text)

    def of(coding, body, **options):
        return warc.body_of(body, f"HTTP/1.1 200 OK\r\n{coding}", **options)

    assert of("Content-Encoding: gzip", text) == (text, ["not gzip"]) and of("Transfer-Encoding: chunked", text) == (text, ["not chunked"])
    assert of("Content-Encoding: br", text) == (b"", ["unknown coding br"]) and of("Content-Encoding: gzip", b"") == (b"", [])
    part, problems = of("Content-Encoding: gzip", packed[:len(packed) // 2])
    assert problems == ["gzip data without end"] and part and text.startswith(part)
    part, problems = of("Content-Encoding: gzip", packed[:1000] + bytes(200))
    assert problems[0] in ("damaged gzip data", "gzip data without end")
    assert of("Content-Encoding: gzip", packed, limit=4999) == (b"", ["over 4999 bytes decoded"]) and of("", text, limit=4999)[0] == b""
    assert of("Transfer-Encoding: chunked", b"5\r\nhello\r\n9\r\nwor") == (b"hellowor", ["chunk without end"])
    assert of("Transfer-Encoding: chunked", b"5\r\nhello\r\nzz") == (b"hello", ["chunk size missing"])


def record(kind, name, block, digest=None, extra=()):
    fields = [("WARC-Type", kind), ("WARC-Record-ID", name), ("WARC-Target-URI", "http://h/" + name), ("WARC-Date", "2024-05-01T00:00:00Z"), *extra,
              ("WARC-Block-Digest", digest or warc.digest(block)), ("Content-Length", str(len(block)))]
    return warc.warc_header(fields).encode() + block + b"\r\n\r\n"


def test_round_trip_from_response_files(spark, tmp_path):
    http = ("Content-Type", "application/http; msgtype=response")
    packed = gzip.compress("<title>T</title><p>zip\xe9 text".encode())
    records = [
        record("warcinfo", "w", b"software: x\r\n\r\n"), record("request", "q", b"GET / HTTP/1.1\r\n\r\n", extra=[http]),
        record("response", "plain", b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=latin-1\r\n\r\n<p>caf\xe9\r\n\r\nWARC/1.1", extra=[http]),
        record("response", "zip", b"HTTP/1.1 404 No\r\nContent-Encoding: gzip\r\n\r\n" + packed, extra=[http]), record("revisit", "v", b""),
        record("response", "headless", b"HTTP/1.1 204 None", extra=[http]), record("response", "wrong", b"HTTP/1.1 200 OK\r\n\r\nx", digest="sha1:" + "A" * 32, extra=[http]),
        record("response", "dns", b"a", extra=[("Content-Type", "text/dns")]), record("response", "md5", b"HTTP/1.1 200 OK\r\n\r\n<p>unchecked", digest="md5:00", extra=[http]),
        record("metadata", "m", b"fetchTimeMs: 1\r\n"), record("resource", "long", b"HTTP" * 50_000), record("response", "empty", b"", extra=[http])]
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "members.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    (folder / "one.warc.gz").write_bytes(gzip.compress(b"".join(records)))
    (folder / "plain.warc").write_bytes(b"".join(records))
    (folder / "cut.warc").write_bytes(records[2] + records[10][:-40])
    (folder / "noise.warc").write_bytes(records[0] + b"no record here" * 5)
    (folder / "cut.warc.gz").write_bytes(gzip.compress(records[2]) + gzip.compress(records[10])[:-20])
    (folder / "none.warc").write_bytes(b"")
    read = warc.read_warc(spark, str(folder))
    by_file = {}
    for r in read.collect():
        by_file.setdefault(r["path"].rsplit("/", 1)[1], []).append(r)
    for name in ("members.warc.gz", "one.warc.gz", "plain.warc"):
        assert [r["header"].encode() + bytes(r["block"]) + b"\r\n\r\n" for r in by_file[name]] == records
        assert [(r["record_id"], r["state"]) for r in by_file[name] if r["state"] != "match"] == [("wrong", "mismatch"), ("md5", "unchecked")]
    assert [r["state"] for r in by_file["cut.warc"]] == ["match", "truncated"] and [r["state"] for r in by_file["noise.warc"]] == ["match", "damaged"]
    assert [r["state"] for r in by_file["cut.warc.gz"]] == ["match", "damaged"] and "none.warc" not in by_file

    one = read.where("path like '%plain.warc'")
    got = warc.build_derivatives(warc.responses_from_warc(one)).collect()
    texts = {r["refers_to"]: bytes(r["block"]).decode() for r in got if r["record_type"] == "conversion"}
    assert texts == {"plain": "café WARC/1.1", "zip": "zipé text", "headless": "", "md5": "unchecked", "empty": ""}
    about = {r["refers_to"]: bytes(r["block"]).decode() for r in got if r["record_type"] == "metadata"}
    assert "source-http-status: 404\r\n" in about["zip"] and "title: T\r\n" in about["zip"] and warc.digest(packed) in about["zip"]
    assert "source-http-header: Content-Encoding: gzip\r\n" in about["zip"]
    assert warc.responses_from_warc(one, keep=("mismatch",)).count() == 1
    assert warc.responses_from_warc(read.limit(0)).count() == 0


def test_records_are_read_by_any_piece_size():
    rng = random.Random(5)
    records = [record(rng.choice(["response", "metadata"]), str(i), rng.randbytes(rng.choice([0, 1, 9, 5000, 20_000]))) for i in range(60)]


    want = [r[:-4] for r in records]
    for step in (1, 7, 4096):
        reader = warc.RecordReader(io.BytesIO(b"".join(records)))
        reader.HEAD_STEP = step
        assert [h.encode() + b for h, b, state in reader if state == "match"] == want


def test_headers_without_end_are_damaged():
    assert [s for _, _, s in warc.RecordReader(io.BytesIO(b"WARC/1.1\r\n" + b"A: b\r\n" * 1_000_000))] == ["damaged"]
    assert [s for _, _, s in warc.RecordReader(io.BytesIO(b"WARC/1.1\r\nContent-Length: -4\r\n\r\nabcd"))] == ["damaged"]
    assert html.unescape(markup.read_page("&lt;b&gt;").text) == "<b>"
