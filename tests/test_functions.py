"""Scalar functions, parsers and files."""

import struct
import zlib

import pytest
from pyspark.sql import functions as F

from facetspark.functions import jsonx, numbers, text, vectors
from facetspark.operators import rules
from facetspark.providers import sliding_context
from facetspark.sources import files, sinks


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(f(F.col("c")).alias("r")).first().r


def test_globs():
    import re

    ok = lambda g, p: bool(re.match(text.glob_regex(g), p))
    assert ok("**/cheap.*", "/a/b/cheap.jpg") and not ok("**/cheap.*", "cheap.jpg") and ok("/a/*.jpg", "/a/x.jpg") and not ok("/a/*.jpg", "/a/b/x.jpg") and ok("/a/?.p+g", "/a/x.p+g")


@pytest.mark.parametrize("raw, out", [("a%20b+c", "a b+c"), ("%FF", "%FF"), ("%zz", "%zz"), ("", ""), (None, None), ("%E6%97%A7", "旧")])
def test_decode_url(spark, raw, out):
    assert one(spark, raw, text.decode_url) == out


def test_names(spark):
    assert one(spark, ' a<b>:  c. ', text.sanitize_name) == "ab_c"
    assert one(spark, "/x/.hidden", text.extension) == "" and one(spark, "/x/A.JPG", text.extension) == "jpg"
    assert one(spark, "<think>a</think> b <think>c</think>", text.strip_thinking) == "b <think>c</think>"
    assert one(spark, " Jpg, ,PNG", text.parse_list) == ["jpg", "png"]
    assert one(spark, "n" * 36, text.clean_model_name) is None and one(spark, "red barn.jpeg", text.clean_model_name) == "red_barn"
    assert one(spark, "/a b/c", text.file_url) == "file:///a%20b/c"
    assert one(spark, "data:image/png;base64,QUJD", text.split_data_uri).kind == "png" and one(spark, "x", text.split_data_uri) is None
    assert one(spark, "abcdef", lambda c: text.wrap(c, 4)) == ["abcd", "ef"]


def test_numbers(spark):
    assert one(spark, 1.005, numbers.round_half_up, "double") == 1.0 and one(spark, -0.125, numbers.round_half_up, "double") == -0.12
    assert [one(spark, s, numbers.parse_float) for s in ("12abc", " .5e1x", "x", None)] == [12.0, 5.0, None, None]
    assert [one(spark, s, numbers.answer) for s in ("0.5", "unknown", "?", "1.2", "-1")] == [0.5, None, None, None, None]


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 1.0]), ([1.0, 0.0], [-1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), (None, [1.0, 0.0]), ([1.0], [1.0, 0.0])], "a array<float>, b array<float>")
    assert [r[0] for r in df.select(vectors.sim01(F.col("a"), F.col("b"))).collect()] == [1.0, 0.5, 0.0, 0.0, 0.0, 0.0]


def test_size_rules(spark):
    rule = "array<struct<min_width:int,max_width:int,min_height:int,max_height:int,multiplier:double>>"
    table = [(4000, None, None, None, 1.2), (None, 500, None, None, 0.7), (None, None, None, None, 3.0)]
    df = spark.createDataFrame([(table, 4500, 10), (table, 400, 10), (table, 1000, 10), (None, 1, 1), (table, None, 1)], f"r {rule}, w int, h int")
    assert [x[0] for x in df.select(rules.size_multiplier(F.col("r"), F.col("w"), F.col("h"))).collect()] == [1.2, 0.7, 1.0, 1.0, 1.0]
    assert df.select(rules.size_reason(F.col("r")[0], F.col("w"), F.col("h"))).first()[0] == "width >= 4000"


GOOD = '{"min_value": 1, "max_value": 2.5, "rationale": "r", "confidence": "low"}'


@pytest.mark.parametrize(
    "said, error",
    [(GOOD, None), (f"```json\n{GOOD}\n```", None), (f"Sure: {GOOD} done", None), (GOOD.replace("2.5", "0.5"), "max below min"), (GOOD.replace("low", "sure"), "confidence unknown"), ('{"min_value": "a"}', "values missing"), ("none", "no JSON"), (None, "no JSON"), ("", "no JSON"), ("[1]", "values missing")],
)
def test_valuation_json(spark, said, error):
    got = one(spark, said, jsonx.parsed_valuation)
    assert got.error == error and (got.max_value == 2.5) == (error is None)


def test_questions():
    good = '{"questions": [{"question": "Is it red?", "rationale": "r"}]}'
    want = [("Is it red?", "r")]
    assert jsonx.questions_of("x", good) == (want, None) and jsonx.questions_of(good) == (want, None) and jsonx.questions_of(f"```\n{good}\n```") == (want, None)
    assert jsonx.questions_of('broken "question": "Is it red?", "rationale": "r"') == (want, None)
    assert jsonx.questions_of("nothing")[1] and jsonx.questions_of(None)[1] and jsonx.questions_of('{"questions": []}') == ([], "invalid questions")
    assert jsonx.questions_of(good, "{bad")[0] == want


def png(w, h):
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0" * (h * (3 * w + 1)))) + chunk(b"IEND", b"")


def tiff():
    entries = [(0x010F, 2, 6, 100), (0x8825, 4, 1, 120)]
    head = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 2) + b"".join(struct.pack("<HHII", *e) for e in entries) + b"\0" * 4
    body = head.ljust(100, b"\0") + b"Maker\0"
    gps = [(1, 2, 2, struct.unpack("<I", b"S\0\0\0")[0]), (2, 5, 3, 200), (3, 2, 2, struct.unpack("<I", b"E\0\0\0")[0]), (4, 5, 3, 224)]
    body = body.ljust(120, b"\0") + struct.pack("<H", 4) + b"".join(struct.pack("<HHII", *e) for e in gps)
    return body.ljust(200, b"\0") + struct.pack("<6I", 10, 1, 30, 1, 0, 1) + struct.pack("<6I", 20, 1, 0, 1, 0, 1)


def test_image_files(spark, tmp_path):
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x0b\x08" + struct.pack(">HH", 150, 200) + b"\x01\x11\x00\xff\xd9"
    assert files.image_header(png(300, 200)) == ("png", 300, 200) and files.image_header(jpeg) == ("jpeg", 200, 150)
    assert files.image_header(b"garbage") == (None, 0, 0) == files.image_header(None) == files.image_header(b"\xff\xd8\xff")
    got = files.exif(b"\xff\xd8Exif\x00\x00" + tiff())
    assert got["make"] == "Maker" and got["gps"] == {"latitude": -10.5, "longitude": 20.0}
    assert files.exif(b"x") is None and files.exif(None) is None
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.PNG").write_bytes(png(30, 20))
    (tmp_path / "deep/b.jpg").write_bytes(jpeg)
    (tmp_path / "c.txt").write_bytes(b"abc")
    df = files.scan(spark, str(tmp_path), True, ["png", "jpg"]).select("length", files.header_of(F.col("content")).alias("h"), files.exif_of(F.col("content")).alias("e"))
    assert {(r.h.format, r.h.width) for r in df.collect()} == {("png", 30), ("jpeg", 200)}
    assert files.scan(spark, str(tmp_path), True, ["png", "jpg"], depth=0).count() == 1 and files.within_size(files.scan(spark, str(tmp_path)), 10).count() == 1
    assert files.uniform_bottom_rows(bytes([1, 2, 3, 4, 7, 7, 7, 7]), 2, 1) == 2 and files.uniform_bottom_rows(b"", 2, 1) == 0
    (tmp_path / "t.txt").write_text("a=1\nb=2")
    assert [r.line for r in sinks.read_lines(spark, str(tmp_path / "t.txt")).orderBy("n").collect()][:2] == ["a=1", "b=2"]


def test_scan_goes_no_deeper_than_asked(spark, tmp_path):
    for name, data in {"a.png": b"x", "none.png": b"", "b/c.jpg": b"y", "b/d/e.jpg": b"z", "b/d/note.txt": b"t"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    names = lambda *a, **k: sorted(r.path.rsplit("/", 1)[1] for r in files.scan(spark, str(tmp_path), *a, **k).select("path").collect())
    assert names() == ["a.png", "none.png"] and names(depth=1) == ["a.png", "c.jpg", "none.png"]
    assert names(True) == ["a.png", "c.jpg", "e.jpg", "none.png", "note.txt"] and names(True, ["jpg"]) == ["c.jpg", "e.jpg"]
    assert names(True, include=["**/d/*.jp*", "**/a.png"]) == ["a.png", "e.jpg"]
    assert files._walk(spark, str(tmp_path), 0)[0] == [str(tmp_path)]  # what lies below wasn't listed
    with pytest.raises(FileNotFoundError):
        files.scan(spark, str(tmp_path / "gone"))


def test_context_of_several_documents(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "d string, n int, t string")
    assert {(r.d, r.n): r.prompt for r in sliding_context(df, "n", "t", 1, ["d"]).collect()} == {("a", 1): "x=", ("a", 2): "x\ny=", ("b", 1): "z="}


def test_formats(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(numbers.fixed(F.lit(2.5), 0)) == "3" and one(numbers.fixed(F.lit(float("nan")))) is None and one(numbers.fixed(F.lit(1234.5), 2, "¥")) == "¥1234.50"
    assert one(numbers.kilobytes(F.lit(1536))) == "1.5 KB" and one(numbers.grouped(F.lit(1000000))) == "1,000,000"
    assert one(text.sha256_hex(F.lit(""))) == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855" and one(text.sha256_hex(F.lit(None).cast("string"))) is None
    assert one(text.exif_time(F.lit("2024:01:31 08:09:10"))) == "2024-01-31T08:09:10.000Z" and one(text.exif_time(F.lit("soon"))) is None
    at = F.lit("2024-01-31 08:09:10").cast("timestamp")
    assert one(text.stamp(at)) == "20240131080910" and one(text.iso_time(at)) == "2024-01-31T08:09:10.000Z"
    assert [one(text.is_path(F.lit(s))) for s in ("photo", "a/b", "x.md", ".md", "c\\d")] == [False, True, True, False, True]
    assert one(text.from_file_url(F.lit("file:///a%20b"))) == "/a b" and one(text.from_file_url(F.lit("/x"))) == "/x"
    assert tuple(spark.range(1).select(*numbers.clamp_range(F.lit(-2.0), F.lit(-5.0))).first()) == (0.0, 0.0, 0.0)
