"""Scans of folders, queries over records, reports, streams and the console."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterlake import cli
from rasterlake.functions import exprs as X
from rasterlake.operators import encoders as E
from rasterlake.operators import engine
from rasterlake.operators.reader import Cursor, Reader
from rasterlake.plans import reports
from rasterlake.sources.images import binary_files, listing
from rasterlake.streaming import live

RGB = np.random.default_rng(1).integers(0, 256, (6, 7, 3), dtype=np.uint8)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("scan") / "Для проверки"
    (d / "sub").mkdir(parents=True)
    (d / "a b%20.png").write_bytes(E.png(RGB, 2))
    (d / "B.BMP").write_bytes(E.bmp24(RGB, 3780))
    (d / "wrong.png").write_bytes(E.bmp24(RGB))
    (d / "empty.gif").write_bytes(b"")
    (d / "text.tif").write_bytes(b"no picture")
    (d / "notes.txt").write_bytes(b"left out")
    (d / "sub" / "cut.tif").write_bytes(E.tiff(RGB)[:120])
    (d / "sub" / "p;q.jpg").write_bytes(E.jpeg(RGB))
    return str(d)


@pytest.fixture(scope="module")
def records(spark, folder):
    return engine.scan(spark, folder, deep=True).cache()


def test_scan(records):
    rows = {r["name"]: r for r in records.collect()}
    assert {n: r["check"] for n, r in rows.items()} == {"a b%20.png": "OK", "B.BMP": "OK", "wrong.png": "WARNING", "empty.gif": "NOT_IMAGE", "text.tif": "NOT_IMAGE", "cut.tif": "CORRUPTED", "p;q.jpg": "OK"}
    assert rows["B.BMP"]["pixels"]["pixel_count"] == 42 and round(rows["B.BMP"]["dpi_x"], 2) == 96.01
    assert rows["empty.gif"]["bytes_read"] == 0 and rows["wrong.png"]["extension_mismatch"]


def test_flat_scan_and_overlapping_roots(spark, folder):
    assert engine.scan(spark, folder, recursive=False).count() == 5
    assert engine.scan(spark, [folder, folder + "/sub"]).count() == 9
    assert engine.scan(spark, [folder, folder + "/sub"], dedupe=True).count() == 7
    assert engine.scan(spark, folder + "/notes.txt").first()["check"] == "NOT_IMAGE"


def test_missing_root(spark):
    with pytest.raises(FileNotFoundError):
        listing("/no/such/root")


def test_header_scan_reads_less(spark, tmp_path):
    big = np.zeros((400, 400, 3), np.uint8)
    (tmp_path / "x.bmp").write_bytes(E.bmp24(big))
    row = engine.scan(spark, str(tmp_path)).first()
    assert row["bytes_read"] < 100 < row["file_size"]


def test_unreadable_file():
    row = engine.analyse("x.png", None, error="denied")
    assert (row["check"], row["format"], row["bytes_read"]) == ("CORRUPTED", "NOT_IMAGE", 0)


def test_binary_files(spark, folder):
    found = engine.analyse_contents(binary_files(spark, [folder]))
    assert found.count() == 6  # Spark's reader leaves out the empty one


def test_summary_and_search(records):
    s = engine.summarize(records).first()
    assert (s["done"], s["corrupted"], s["warnings"], s["not_image"], s["errors"]) == (7, 1, 1, 2, 3)
    assert engine.search(records, "PORTABLE").count() == 1
    assert engine.search(records, "для").count() == 0 and engine.search(records, "для", unicode=True).count() == 7
    assert engine.search(records, "").count() == 7
    assert engine.record_at(records, 0).first()["name"] == "B.BMP"
    assert engine.errors(records).count() == 3


def test_details_and_views(spark, records):
    engine.register_views(records)
    assert spark.sql("select count(*) from images_problems").first()[0] >= 4
    assert spark.sql("select value from images_details where name = 'state' and path like '%cut.tif'").first()[0] == "CORRUPTED"
    assert spark.sql("select count(*) from images_pixels").first()[0] == 4
    engine.register_functions(spark)
    assert spark.sql("select image_format(X'474946383961')").first()[0] == "GIF"


def test_reports(records, tmp_path):
    text = reports.to_csv(records)
    lines = text.splitlines()
    assert lines[0].split(";")[0] == "Файл" and len(lines) == 8
    assert '"p;q.jpg"' in text and "файл повреждён" in text
    assert {r["line"] for r in reports.csv_lines(records).collect()} == set(lines[1:])
    path = reports.save_report(str(tmp_path / "report"), records)
    with open(path, "rb") as f:
        assert f.read(3) == b"\xef\xbb\xbf"
    reports.write_csv(str(tmp_path / "folder"), records)
    table = reports.to_text_table(records)
    assert "    ! " in table and "7 x 6" in table
    with pytest.raises(ValueError):
        reports.save_report(str(tmp_path / "none"), records.limit(0))
    assert reports.grid(records).columns[0] == "Файл"


def test_stream(spark, folder, tmp_path):
    batches = []
    q = live.deliver(live.stream(spark, [folder]), lambda df, n: batches.append(df.count()), str(tmp_path / "c"))
    q.awaitTermination()
    assert sum(batches) == 7
    q = live.progress(live.stream(spark, [folder]), "live_counts")
    q.processAllAvailable()
    assert spark.table("live_counts").first()["done"] == 7
    q.stop()


def test_console(spark, folder, tmp_path, capsys):
    assert cli.main([folder, "--quiet"]) == 0
    assert "не изображений: 2" in capsys.readouterr().out
    assert cli.main([folder, "--csv", "--strict", "--deep"]) == 2
    assert cli.main([folder, "--quiet", "--save", str(tmp_path / "no" / "x.csv")]) == 1
    assert cli.main(["--no-such-option"]) == 2
    assert cli.main(["--help"]) == 0


def test_numbers(spark):
    rows = spark.sql("select * from values (231.25D), (2.675D), (0.125D), (-0.001D), (1024D), (0.5D), (1.5D) t(v)")
    got = [tuple(r) for r in rows.select(*(X.fixed(F.col("v"), d) for d in (0, 1, 2))).collect()]
    assert got == [tuple("%.*f" % (d, v) for d in (0, 1, 2)) for v in (231.25, 2.675, 0.125, -0.001, 1024, 0.5, 1.5)]


@pytest.mark.parametrize("n,word", [(1, "файл"), (2, "файла"), (5, "файлов"), (11, "файлов"), (21, "файл"), (112, "файлов")])
def test_plural(spark, n, word):
    assert spark.range(1).select(X.plural_files(F.lit(n))).first()[0] == word


def test_detection_twins(spark):
    heads = [E.png(RGB, 2), E.bmp24(RGB), E.gif([RGB[..., 0]], RGB[0]), E.tiff(RGB), E.tiff(RGB, big=True, little=False), E.pcx24(RGB), E.jpeg(RGB), b"", b"B", b"text", b"\x0a\x05\x01\x08"]
    df = spark.createDataFrame([(bytearray(h[:64]),) for h in heads], "h binary")
    assert [r[0] for r in df.select(X.detect_format(F.col("h"))).collect()] == [engine.detect(h) for h in heads]


def test_reader_counts_the_union():
    r = Reader(b"x" * 100)
    assert (r.read(0, 10), len(r.read(5, 10)), r.read(95, 50), r.read(100, 1), r.read(3, 0)) == (b"x" * 10, 10, b"x" * 5, b"", b"")
    assert r.bytes_read == 20 and r.tail(3) == b"xxx"


def test_cursor_fails_softly():
    c = Cursor(b"\x01\x02\x03")
    assert (c.u16(), c.ok, c.u16(), c.ok, c.at) == (0x0201, True, 0, False, 3)
    c.seek(1)
    assert c.ok and c.u8() == 2


def test_interval_union(spark):
    df = spark.createDataFrame([("a", 0, 10), ("a", 5, 8), ("a", 20, 25), ("a", 25, 30), ("b", 1, 1), ("b", 2, 4)], "k string, s int, e int")
    assert {r["k"]: r["covered"] for r in engine.interval_union(df, "s", "e", "k").collect()} == {"a": 20, "b": 2}


def test_interval_union_of_split_keys(spark, monkeypatch):
    """Keys with many ranges are cut into slices; null keys are keys; the sums are those of one sorted pass."""
    rng = np.random.default_rng(5)
    rows = [(k, int(a), int(a + n)) for k, size in (("hot", 900), (None, 300), ("small", 5)) for a, n in zip(rng.integers(-500, 5000, size), rng.integers(0, 60, size), strict=True)]
    rows.append(("hot", -400, 4000))
    want: dict = {}
    for k, a, b in rows:
        want.setdefault(k, set()).update(range(a, b))
    df = spark.createDataFrame(rows, "k string, s long, e long")
    for split in (200_000, 50):
        monkeypatch.setattr(engine, "SPLIT", split)
        assert {r["k"]: r["covered"] for r in engine.interval_union(df, "s", "e", "k").collect()} == {k: len(v) for k, v in want.items()}


def test_a_bad_root_leaves_the_others(spark, folder):
    rows = engine.scan(spark, [folder + "/sub", "/no/such/root", folder]).collect()
    bad = [r for r in rows if r["path"] == "/no/such/root"]
    assert len(bad) == 1 and bad[0]["check"] == "CORRUPTED" and bad[0]["problems"][0]["code"] == "ROOT" and bad[0]["root_ordinal"] == 1
    assert sorted(r["root_ordinal"] for r in rows) == [0] * 2 + [1] + [2] * 7
    ordered = [r["path"] for r in engine.by_root(engine.scan(spark, [folder, folder + "/sub"])).collect()]
    assert ordered == [p for root in (folder, folder + "/sub") for p, _ in listing(root)]


def test_links_are_followed_once(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.bmp").write_bytes(E.bmp24(RGB))
    (tmp_path / "a" / "loop").symlink_to(tmp_path / "a")
    (tmp_path / "b").symlink_to(tmp_path / "a")
    assert engine.scan(spark, str(tmp_path)).count() == 1
    assert engine.scan(spark, str(tmp_path / "b"), follow_links=True).count() == 1


def test_executors_list(spark, folder):
    whole = sorted((r["path"], r["check"]) for r in engine.scan(spark, [folder, "/no/root"]).collect())
    assert sorted((r["path"], r["check"]) for r in engine.scan(spark, [folder, "/no/root"], listing="executors").collect()) == whole


def test_stream_offsets_are_times(spark, tmp_path):
    """Each file comes once, over restarts of the stream too; a new checkpoint starts anew; the offset is one number."""
    import json
    import time

    place, state, got = tmp_path / "in", tmp_path / "state", []
    place.mkdir()

    def run(checkpoint):
        time.sleep(0.2)
        live.deliver(live.stream(spark, [str(place)]), lambda df, n: got.extend(r["name"] for r in df.select("name").collect()), str(checkpoint)).awaitTermination()

    for name in ("a.bmp", "b.bmp"):
        (place / name).write_bytes(E.bmp24(RGB))
    run(state)
    run(state)
    (place / "c.bmp").write_bytes(E.bmp24(RGB))
    run(state)
    assert sorted(got) == ["a.bmp", "b.bmp", "c.bmp"]
    last = sorted((state / "offsets").glob("[0-9]*"), key=lambda p: int(p.name))[-1].read_text().splitlines()[-1]
    assert list(json.loads(last)) == ["until"]
    got.clear()
    run(tmp_path / "other")
    assert sorted(got) == ["a.bmp", "b.bmp", "c.bmp"]


def test_stopped_stream_keeps_what_it_counted(spark, folder):
    q = live.progress(live.stream(spark, [folder]), "stopped_counts")
    q.processAllAvailable()
    q.stop()
    assert not q.isActive and spark.table("stopped_counts").first()["done"] == 7


def test_panel(records):
    from rasterlake.functions import labels as L

    rows = reports.panel(records)
    of = lambda name: [(r["group"], r["name"], r["value"], r["note"]) for r in rows.where(F.col("path").endswith(name)).orderBy("position").collect()]
    bmp = {(g, n): (v, note) for g, n, v, note in of("B.BMP")}
    assert bmp["Размер", "Разрешение"][0] == "96.01 x 96.01" and bmp["Проверка", "Статус"] == ("OK", L.PANEL_NOTES["Проверка", "Статус"]) and bmp["Пиксели", "Прозрачность"][0] == "нет"
    wrong = {(g, n): (v, note) for g, n, v, note in of("wrong.png")}
    assert wrong["Формат", "Расширение"] == ("PNG", L.PANEL_MISMATCH) and wrong["Размер", "Разрешение"] == (L.NOT_SET, L.PANEL_NO_DPI) and ("Проверка", "Замечание") in wrong
    assert ("Размер", "Ширина") not in {(g, n) for g, n, *_ in of("empty.gif")}
    assert {f.name: f.metadata["comment"] for f in reports.grid(records).schema} == L.COLUMN_HELP


def test_named_fields_alone(spark, folder):
    rows = engine.scan(spark, folder, names=["check", "path"])
    assert rows.columns == ["path", "check"] and rows.count() == 7
    with pytest.raises(ValueError):
        engine.scan(spark, folder, names=["no such field"])


def test_sql_functions(spark):
    engine.register_functions(spark)
    png, jpeg = E.png(RGB, 2), E.jpeg(RGB)
    spark.createDataFrame([("a.png", bytearray(png)), ("b.jpg", bytearray(jpeg)), ("c.gif", None)], "path string, content binary").createOrReplaceTempView("contents")
    rows = {r["path"]: r for r in spark.sql("select path, image_format(content) f, image_check(path, content) c, image_parse(path, content) r, image_pixels(content) p from contents").collect()}
    assert (rows["a.png"]["f"], rows["a.png"]["c"], rows["a.png"]["r"]["width"], rows["a.png"]["p"]["pixel_count"]) == ("PNG", "OK", 7, 42)
    assert (rows["c.gif"]["f"], rows["c.gif"]["c"], rows["c.gif"]["p"]) == ("NOT_IMAGE", "NOT_IMAGE", None)
    kinds = [r["kind"] for r in spark.sql("select kind from contents, lateral image_chunks(content) where path = 'a.png' order by position").collect()]
    assert kinds == ["IHDR", "IDAT", "IEND"]
    assert spark.sql("select count(*) from contents, lateral image_chunks(content) where kind = 'DA'").first()[0] == 1


def test_compat(spark):
    import struct

    h, w = RGB.shape[:2]
    flipped = struct.pack("<2sIIIIiiHHIIiiII", b"BM", 54 + 24 * h, 0, 54, 40, w, -h, 1, 24, 0, 24 * h, 0, 0, 0, 0) + bytes(24 * h)
    flat = E.pcx24(np.zeros((64, 64, 3), np.uint8))
    files = [("a.bmp", flipped), ("b.pcx", flat), ("c.gif", E.gif([RGB[..., 0], RGB[..., 0]], RGB[0], [1, 2])), ("d.bmp", E.bmp_rle8(RGB[..., 0], np.zeros((256, 3), np.uint8)))]
    plain = engine.analyse_contents(spark.createDataFrame([(n, bytearray(b)) for n, b in files], "path string, content binary"))
    assert {r["path"]: r["check"] for r in plain.collect()} == {n: "OK" for n, _ in files}
    rows = {r["path"]: r for r in engine.compat(plain).collect()}
    assert {n: rows[n]["check"] for n, _ in files} == {"a.bmp": "CORRUPTED", "b.pcx": "CORRUPTED", "c.gif": "OK", "d.bmp": "OK"}
    assert (rows["a.bmp"]["compression_code"], rows["d.bmp"]["compression_code"], rows["c.gif"]["width"]) == ("BI_RGB", "BI_1", w)


def test_measures():
    assert engine.analyse_bytes("a.png", E.png(RGB, 2))["measures"] == {"idat_chunks": 1, "idat_bytes": len(E.png(RGB, 2)) - 57, "texts": 0}
    record = engine.analyse_bytes("a.gif", E.gif([RGB[..., 0]] * 3, RGB[0], [4, 5, 6]), deep=True)
    assert (record["measures"]["frames"], record["measures"]["delay"], sum(record["red_histogram"])) == (3, 15, 42)
