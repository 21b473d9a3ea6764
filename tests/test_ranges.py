"""Byte ranges: every line once, wherever files are cut; headers cost their own bytes; equal to whole files."""

import io
import pickle

import pytest
from pyspark.sql import functions as F

from linkledger.model import COMPONENTS
from linkledger.sinks.writers import write_files
from linkledger.sources import exports as X
from linkledger.sources import ranges as R


class Counted(io.BytesIO):
    read_bytes = 0

    def read_at(self, n, offset):
        self.seek(offset)
        got = self.read(n)
        self.read_bytes += len(got)
        return got


@pytest.mark.parametrize("content", [b"", b"\n", b"one", b"a\nbb\n\nccc", b"x\r\ny\r\n", b"\n\n\n", b"long" * 50 + b"\nend\n", bytes(range(256)) * 3])
def test_every_line_belongs_to_one_range(content):
    for width in (1, 2, 3, 7, 64, 10_000):
        for step in (1, 5, 1 << 16):
            parts = [R.whole_lines(Counted(content), R.Piece("f", len(content), at, min(len(content), at + width)), step) for at in range(0, len(content), width)]
            assert b"".join(p or b"" for p in parts) == content
            held = [p for p in parts if p]
            assert all(p.endswith(b"\n") for p in held[:-1])


def export(point, rows, breaks="\n"):
    head = ["Export", "", f"Point Index:\t{point}\t[x = 1.5\ty = 2.0\tz = 0.25]", "Frequency\tReal X", "[ Hz ]"]
    return breaks.join([*head, *("\t".join(map(str, r)) for r in rows)]).encode("latin-1")


def test_rows_and_reasons_equal_those_of_whole_files(spark, tmp_path):
    good = [[20.0 + i, *[i / 7 + k for k in range(6)]] for i in range(40)]
    files = {
        "a.txt": export(1, good), "b.txt": export(2, good, "\r\n"), "sub/c.txt": export(3, good) + b"\n\n", "text.txt": export(4, [*good, [1, "x", *"12345"]]),
        "ragged.txt": export(5, [*good, [1, 2]]), "nan.txt": export(6, [*good, [1, "NaN", *"12345"]]), "none.txt": export(7, []), "bare.txt": b"1\t2\t3\t4\t5\t6\t7\n" * 50,
        "empty.txt": b"", "wide.txt": export(8, [[*r, 1.0] for r in good]), "skip.csv": export(9, good),
    }
    folder = str(tmp_path / "in")
    assert write_files(spark.createDataFrame(list(files.items()), "path STRING, content BINARY"), folder) == len(files)
    whole = X.parse_exports(X.read_files(spark, folder, "*.txt"))
    arrays = ["freq", *COMPONENTS]
    expected = whole.where("reason IS NULL").select("path", "point", "x", "y", "z", F.explode(F.arrays_zip(*arrays)).alias("r")).select("path", "point", "x", "y", "z", "r.*")
    name = lambda df: sorted(tuple(str(v) for v in (r["path"].rsplit("/", 1)[-1], *r[1:])) for r in df.collect())
    for size in (37, 500, 1 << 20):
        rows, rejects = R.scan_export_rows(spark, folder, range_bytes=size)
        assert name(rows.select(*expected.columns)) == name(expected)
        # Spark's file source passes empty files by; here they are rejects.
        assert name(rejects.select("path", "reason")) == sorted([*name(X.rejects_with_reason(whole).select("path", "reason")), ("empty.txt", X.NO_HEADER)])
    headers = R.read_headers(spark, folder)
    assert name(headers.where("path NOT LIKE '%empty.txt'")) == name(X.scan_headers(X.read_files(spark, folder, "*.txt")).select(*headers.columns))
    assert headers.count() == 10


def test_headers_read_their_bytes_only(tmp_path):
    (tmp_path / "big.txt").write_bytes(export(1, [[1] * 7] * 200_000))
    reader = R.RangeReader({"path": str(tmp_path), "onlyheads": "true"})
    parts = reader.partitions()
    assert [(p.end - p.start, p.size > 2_000_000) for part in parts for p in part.pieces] == [(X.HEADER_BYTES, True)]
    assert [len(row[3]) for part in parts for row in reader.read(part)] == [X.HEADER_BYTES]
    spread = R.RangeReader({"path": str(tmp_path), "rangebytes": str(1 << 20)}).partitions()
    assert sum(len(p.pieces) for p in spread) >= 2


def test_planner_holds_no_file_names(spark, tmp_path):
    for i in range(3000):
        folder = tmp_path / "in" / f"f{i % 3}" / ("deep" if i % 2 else "")
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{i}.txt").write_bytes(b"x" * (i % 25))
    for name in ("_a.txt", ".b.txt", "c.csv"):
        (tmp_path / "in" / name).write_bytes(b"no")
    root = str(tmp_path / "in")
    whole = R.RangeReader({"path": root, "glob": "*.txt", "rangebytes": "10"})
    expected = sorted((p.path, p.size, p.start, p.end) for part in whole.partitions() for p in part.pieces)
    assert len(expected) == sum(max(1, -(-(i % 25) // 10)) for i in range(3000))
    ranges = R.deal_ranges(R.list_files(spark, root, "*.txt"), 10)
    parts = R.RangeReader({"path": root, "ranges": ranges}).partitions()
    assert len(parts) == -(-len(expected) // R.FILES_PER_TASK) and len(pickle.dumps(parts)) < 500 * len(parts)
    held = [[(p.path, p.size, p.start, p.end) for p in part.pieces] for part in parts]
    assert sorted(p for part in held for p in part) == expected
    assert max(map(len, held)) <= R.FILES_PER_TASK + 8
    rows = R.read_ranges(spark, root, "*.txt", range_bytes=10).select("path", "start").collect()
    assert sorted((r["path"].removeprefix("file:"), r["start"]) for r in rows) == sorted((p, start) for p, _, start, _ in expected if not start)
    (tmp_path / "empty").mkdir()
    assert R.read_headers(spark, str(tmp_path / "empty")).count() == 0
