import json

from pyspark.sql import functions as F

from imaging_engine.plans import pipelines
from imaging_engine.sources import dicom


def write(folder, name, *extra):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(dicom.write([("0008,0018", "UI", "1.2." + str(len(name))), ("0008,0060", "CS", "CT"), ("0010,0010", "PN", "DOE^JANE"), ("0010,0020", "LO", "P77"), ("0020,000E", "UI", "9.9"), *extra, ("7FE0,0010", "OW", b"abcd")]))
    return path


def test_ingest_and_reload(spark, tmp_path):
    write(tmp_path, "a.dcm", ("0020,0011", "IS", "4"))
    write(tmp_path, "sub/b.dcm")
    (tmp_path / "bad.dcm").write_bytes(b"xx")
    (tmp_path / "note.txt").write_bytes(b"DOE^JANE")
    rows, hashes = pipelines.ingest(spark, str(tmp_path))
    got = rows.collect()
    assert len({r.file for r in got}) == 2 and not any(x in (r.value or "") for r in got for x in ("DOE", "JANE", "P77"))
    assert len({r.value for r in got if r.tag == "0010,0010"}) == 1
    by = {r.path.rsplit("/", 1)[1]: r.hash for r in hashes.collect()}
    assert by["a.dcm"] == by["b.dcm"] is not None and by["bad.dcm"] is None
    series = {r.series_uid: r for r in pipelines.reload(spark, str(tmp_path)).collect()}
    assert series["9.9"].file_count == 2 and series["9.9"].series_number == "4" and series["9.9"].modality == "CT"


def test_export_sets(spark, tmp_path):
    write(tmp_path, "one/a.dcm")
    write(tmp_path, "two/deep/b.dcm")
    (tmp_path / "none").mkdir()
    at = lambda: sorted((r.set_path.removeprefix(str(tmp_path)), r.path.rsplit("/", 1)[1]) for r in pipelines.export_sets(spark, str(tmp_path)).collect())
    assert at() == [("/one", "a.dcm"), ("/two", "b.dcm")]
    write(tmp_path, "c.dcm")
    assert at() == [("", "c.dcm")]


def test_split_series(spark):
    rows = [(1, "u", "x"), (2, "u", "y "), (3, "u", "x"), (4, "u", None), (5, "w", "z"), (6, "w", "z")]
    got = {r.n: r.new_uid for r in pipelines.split_series(spark.createDataFrame(rows, "n int, s string, v string"), "s", F.col("v"), "n").collect()}
    assert got[1] == got[3] == "u" and got[5] == got[6] == "w"
    assert len({got[1], got[2], got[4]}) == 3 and all(got[k].startswith("2.25.") and len(got[k]) <= 64 for k in (2, 4))


def test_upload_tries_again_and_fails_as_a_whole(spark, tmp_path):
    mark = str(tmp_path / "tries")

    def send(paths):
        if "p0" in paths:
            with open(mark, "a") as f:
                f.write("x")
            if len(open(mark).read()) < 3:
                raise OSError("again")
        if "p9" in paths:
            raise ConnectionError("gone")
        return {"uploaded": paths, "duplicates": [p for p in paths if p == "p1"]}

    rows = spark.createDataFrame([(1, k // 5, f"p{k}") for k in range(10)], "scan_id long, chunk long, path string")
    got = {r.path: r.status for r in pipelines.upload(rows, send).collect()}
    assert got["p0"] == "uploaded" and got["p1"] == "duplicates" and {got[f"p{k}"] for k in range(5, 10)} == {"failed"}


def test_settings_file(tmp_path):
    p = str(tmp_path / "s.json")
    assert pipelines.merged_settings(p, "a", 1) == {"a": 1} and pipelines.merged_settings(p, "b", "x") == {"a": 1, "b": "x"}
    (tmp_path / "s.json").write_text("{broken")
    assert pipelines.merged_settings(p, "c", None) == {"c": None} == json.loads((tmp_path / "s.json").read_text())


def test_template_files(spark, tmp_path):
    for name, text in {"project/h.yml": "id: head\ntitle: Head\napplicable_codes: [C1]\nmodalities: [CT]\nbody: |\n  x {{v}}\nvars:\n  v: 1\n", "user/b.yml": ": no yaml [", "user/plain.yml": "just text"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    got = [(r.id, r.title, r.codes, r.body, r.vars) for r in pipelines.template_files(spark, str(tmp_path)).orderBy("ord").collect()]
    assert got == [("head", "Head", ["C1"], "x {{v}}\n", {"v": "1"}), ("b", None, [], ": no yaml [", {}), ("plain", None, [], "just text", {})]


def test_snapshot_replaces_the_last(spark, tmp_path):
    for n in (1, 2):
        pipelines.snapshot(spark.range(n), str(tmp_path / "s"), "last_scan")
    assert spark.table("last_scan").count() == 2
