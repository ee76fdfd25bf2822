"""Values worked out by hand."""

import hypothesis.strategies as st
import pandas as pd
import pytest
from hypothesis import given, settings
from pyspark.sql import functions as F

from imaging_engine.functions import deid, text
from imaging_engine.functions.blake3 import blake3, blake3_hex
from imaging_engine.operators import compare, ready_files, templates, volume
from imaging_engine.sources import dicom, files


def one(spark, schema, row, column):
    return spark.createDataFrame([row], schema).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    ("n", "want"),
    [(0, "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"), (1, "2d3adedff11b61f14c886e35afa036736dcd87a74d27b5c1510225d0f592e213"), (1024, "42214739f095a406f3fc83deb889744ac00df831c10daa55189b5d121c855af7"), (1025, "d00278ae47eb27b34faecf67b4fe263f82d5412916c1ffd97c8cb7fb814b8444")],
)
def test_blake3_published_values(n, want):
    assert blake3(bytes(k % 251 for k in range(n))).hex() == want


def test_blake3_column(spark):
    assert one(spark, "v binary", (b"",), blake3_hex(F.col("v"))) == blake3(b"").hex()


def test_truncate(spark):
    assert [one(spark, "v string", (v,), compare.shortened(F.col("v"), 5)) for v in ("Exact!", "Exact", "", "Größen")] == ["Exact...", "Exact", "", "Größe..."]


def test_prefix_and_markup(spark):
    cases = {("abcd", "abxd"): 2, ("a", "b"): 0, ("", "x"): 0, ("same", "same"): 4, ("ab", "abc"): 2}
    assert {k: one(spark, "a string, b string", k, compare.common_prefix(F.col("a"), F.col("b"))) for k in cases} == cases
    assert one(spark, "v string, p string, s string", ("pre-1-post", "pre-", "-post"), compare.marked(F.col("v"), F.col("p"), F.col("s"))) == "pre-[[1]]-post"
    assert one(spark, "v string, p string, s string", ("aa", "aa", "a"), compare.marked(F.col("v"), F.col("p"), F.col("s"))) == "aa"


def test_two_files_and_their_differences(spark):
    rows = [("r", f, k, v) for f, m in (("1", {"PatientName": "John Doe", "PatientID": "123456", "Modality": "CT"}), ("2", {"PatientName": "John Doe", "PatientID": "654321", "Modality": "MRI", "StudyDate": "2026-03-17"})) for k, v in m.items()]
    df = spark.createDataFrame(rows, "run string, file string, key string, value string")
    assert {r.key: r.same for r in compare.sameness(df).collect()} == {"PatientName": True, "PatientID": False, "Modality": False, "StudyDate": False}
    both = {r.key: (r.a, r.b) for r in compare.full_outer(df.where("file = '1'"), df.where("file = '2'")).collect()}
    assert len(both) == 4 and both["StudyDate"] == (None, "2026-03-17")


def test_sizes(spark):
    si = {999: "999 B", 1000: "1.0 KB", 1_250_000: "1.3 MB", 0: "0 B"}
    assert {n: one(spark, "n long", (n,), ready_files.size_si(F.col("n"))) for n in si} == si
    iec = {1023: "1023.0 B", 1536: "1.5 KiB", None: "0 B", 5 * 1024**5: "5.0 PiB"}
    assert {n: one(spark, "n long", (n,), ready_files.size_iec(F.col("n"))) for n in iec} == iec


def test_times_and_dates(spark):
    at = lambda v, m: one(spark, "v string", (v,), deid.rotated_time(F.col("v"), F.lit(m)))
    assert [at("121558", 60), at("2359", 2), at("00:00:30", -1), at("2560", 5), at("x", 5), at(None, 5)] == ["131558", "000100", "235930", "2560", "x", None]
    on = lambda v: one(spark, "v string", (v,), deid.shifted_date(F.col("v"), F.lit(1)))
    assert [on("20240228"), on("20240229extra"), on("20230230"), on("2024"), on(None)] == ["20240229", "20240301", "20230230", "2024", None]
    assert one(spark, "v string", ("20200101080000",), deid.shifted_datetime(F.col("v"), F.lit(1))) == "20200102080000"


def test_scrub(spark):
    v = "Confidential^Alice seen 19900101, call 555-123-4567 or alice@example.com; PAT999 ok (3 mm)"
    got = one(spark, "v string", (v,), deid.scrubbed(F.col("v"), F.lit("confidential^alice"), F.lit("PAT999"), F.lit(1)))
    assert got == "seen 19900102 call or ok (3 mm)"


def test_same_patient_same_result(spark):
    df = spark.createDataFrame([("TWO^TIME",), ("TWO^TIME",), ("OTHER",), (None,)], "n string")
    got = df.select(deid.pseudonym(F.col("n")), deid.day_offset(F.col("n")), deid.minute_offset(F.col("n"))).collect()
    assert got[0] == got[1] != got[2] and all(-3650 <= r[1] <= 3650 and -720 <= r[2] < 720 for r in got)
    assert df.select(deid.pseudonym(F.col("n"), "x")).first() != df.select(deid.pseudonym(F.col("n"), "y")).first()


def test_uid_number(spark):
    for h in ("0" * 32, "f" * 32, "0123456789abcdef0123456789abcdef", "0" * 17 + "f" * 15):
        assert one(spark, "h string", (h,), deid.hex_to_decimal(F.col("h"))) == str(int(h, 16))


def test_anonymised_leaks_nothing(spark):
    e = [("f", t, int(t[:4], 16), int(t[5:], 16), vr, v) for t, vr, v in (
        ("0010,0010", "PN", "Confidential^Alice"), ("0010,0020", "LO", "PAT999"), ("0008,0020", "DA", "19900101"), ("0010,1040", "LO", "1 Street"), ("0008,103E", "LO", "for PAT999 knee"), ("0011,1000", "DA", "20200101"),
        ("6000,3000", "OW", "x"), ("0070,0001", "SQ", "x"), ("0020,000D", "UI", "1.2.3"), ("0008,0030", "TM", "080000"), ("0028,0301", "CS", "NO"),
    )]
    schema = "file string, tag string, grp int, elem int, vr string, value string"
    got = {r.tag: r.value for r in deid.anonymised(spark.createDataFrame(e, schema)).collect()}
    assert set(got) == {"0010,0010", "0010,0020", "0008,0020", "0010,1040", "0008,103E", "0020,000D", "0008,0030", "0028,0301"}
    assert got["0010,1040"] == "" and got["0008,103E"] == "for knee" and got["0020,000D"].startswith("2.25.") and not any(x in v for v in got.values() for x in ("Alice", "PAT999", "19900101"))
    burned = [("f", "0028,0301", 0x28, 0x301, "CS", "yes"), ("g", "0010,0010", 0x10, 0x10, "PN", "A")]
    assert {r.file for r in deid.anonymised(spark.createDataFrame(burned, schema)).collect()} == {"g"}
    linked = [("f", "0031,0011", 0x31, 0x11, "LO", deid.LINKED_CREATOR), ("f", "0031,1120", 0x31, 0x1120, "LO", "G1"), ("f", "0031,1130", 0x31, 0x1130, "LO", "drop"), ("f", "0031,1131", 0x31, 0x1131, "DS", "1")]
    kept = {r.tag: r.value for r in deid.anonymised(spark.createDataFrame(linked, schema), preserve_private=True).collect()}
    assert set(kept) == {"0031,0011", "0031,1120", "0031,1131"} and kept["0031,1120"].startswith("2.25.")


def test_truth(spark):
    cases = {"true": True, "false": False, "0": False, "-3": True, "0.5": False, '""': False, '"x"': True, "null": False, "[1]": False, None: False}
    assert {k: one(spark, "v string", (k,), text.truthy(F.col("v"))) for k in cases} == cases


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet="ab. !\n", max_size=12))
def test_sentences_end_and_begin(t):
    before, after = text.finish_before(t), text.finish_after(t)
    assert before == t or before.rstrip()[-1] in ".!?" and before.endswith(" ")
    assert after == t or after.startswith(" ") and not after[1:2].islower()


def test_message_and_key_values(spark):
    kind, n = text.message(F.col("v"))
    assert [spark.createDataFrame([(v,)], "v string").select(kind, n).first()[:] for v in ("progress:0.4", "SCAN:7", "hello")] == [("PROGRESS", 0.4), ("SCAN", 1.0), ("TEXT", None)]
    assert one(spark, "v string", ("a: 1\nb:2:3\n : x\nno colon\na: 4 ",), text.key_values(F.col("v"))) == {"a": "4", "b": "2:3"}


def test_render(spark):
    t = [("a", 1, "A", "x {{v|none}} {{> b}} {{gone}}!"), ("b", 2, "Bee", "[{{ v }} {{> a }}]"), ("c", 3, None, "{{> BEE}}{{> nobody}}")]
    rows = spark.createDataFrame(t, "id string, ord int, title string, body string")
    values = rows.select("id", F.create_map(F.lit("v"), "id").alias("vars"))
    got = {r.id: r.text for r in templates.rendered(rows, values, depth=1).collect()}
    assert got == {"a": "x a [a ] !", "b": "[b x b  !]", "c": "[c ]"}
    deep = {r.id: r.text for r in templates.rendered(rows, values).collect()}
    assert deep["a"].count("[") == 4


def test_near_words_equal_all_pairs(spark):
    import itertools
    import random

    rng = random.Random(3)
    make = lambda n: sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(1, 13))) for _ in range(n)})
    a, b = make(60), make(60)
    want = set()
    for x, y in itertools.product(a, b):
        d = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            last, d[0] = d[0], i
            for j, e in enumerate(y, 1):
                last, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, last + (c != e))
        if d[-1] <= 4 and abs(len(x) - len(y)) <= 3:
            want.add((x, y, d[-1]))
    frames = [spark.createDataFrame([(w,) for w in ws], "word string") for ws in (a, b)]
    assert {tuple(r) for r in templates.near_words(*frames).collect()} == want


SLICES = "series_uid string, filename string, instance double, w int, h int, channels int, pixels array<double>, spacing array<double>, thickness double, position array<double>, orientation array<double>"
AXIAL = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0]


def slices(orientation=AXIAL, second=(0.0, 0.0, 2.0), channels=1):
    return [
        ("s", "slice-2", 2.0, 3, 2, channels, [float(x) for x in range(7, 13)], [0.5, 1.5], 2.0, list(second), orientation),
        ("s", "slice-1", 1.0, 3, 2, channels, [float(x) for x in range(1, 7)], [0.5, 1.5], 2.0, [0.0, 0.0, 0.0], orientation),
    ]


def pdf(rows):
    return pd.DataFrame(rows, columns=[c.split()[0] for c in SLICES.split(", ")])


def test_volume_of_two_slices(spark):
    v = volume.assemble(pdf(slices()))
    assert v.window == (6.5, 11.0) and v.spacing[2] == 2.0
    df = spark.createDataFrame(slices(), SLICES)
    got = {p: volume.planes(df, p, k).first() for p, k in (("axial", 0), ("coronal", 1), ("sagittal", 2))}
    assert {p: r.pixels for p, r in got.items()} == {"axial": [1, 2, 3, 4, 5, 6], "coronal": [4, 5, 6, 10, 11, 12], "sagittal": [3, 6, 9, 12]}


def test_volume_of_a_coronal_acquisition():
    v = volume.assemble(pdf(slices([1.0, 0.0, 0.0, 0.0, 0.0, 1.0], (0.0, -2.0, 0.0))))
    assert v.plane("axial", 1).shape == (2, 3) and v.plane("axial", 1).ravel().tolist() == [10, 11, 12, 4, 5, 6]
    assert len(v.coordinates(1)) == 2


def test_oblique_volume():
    q = 2**-0.5
    rows = [("s", "2", 2.0, 2, 2, 1, [5.0, 6.0, 7.0, 8.0], [1.0, 1.0], 2.0, [-2 * q, 2 * q, 0.0], [q, q, 0.0, 0.0, 0.0, 1.0]), ("s", "1", 1.0, 2, 2, 1, [1.0, 2.0, 3.0, 4.0], [1.0, 1.0], 2.0, [0.0, 0.0, 0.0], [q, q, 0.0, 0.0, 0.0, 1.0])]
    v = volume.assemble(pdf(rows))
    axial = v.plane("axial", 0)
    assert min(axial.shape) >= 2 and (abs(axial - 1) < 1e-3).any() and axial.max() > 1.5


def test_what_makes_no_volume(spark):
    assert volume.assemble(pdf(slices(channels=3))) == "only grayscale series have a volume"
    assert "at least 2" in volume.assemble(pdf(slices()[:1]))
    bad = slices()
    bad[0] = (*bad[0][:9], None, bad[0][10])
    assert "position" in volume.assemble(pdf(bad))
    assert "orthogonal" in volume.assemble(pdf(slices([1.0, 0.0, 0.0, 0.8, 0.6, 0.0])))
    assert volume.planes(spark.createDataFrame(slices(channels=3), SLICES)).first().status.startswith("only gray")


ELEMENTS = [
    ("0008,0060", "CS", "CT"), ("0010,0010", "PN", "Ä^B"), ("0028,0010", "US", 2), ("0028,0011", "US", 2), ("0028,0100", "US", 16), ("0028,1053", "DS", "2"), ("0028,1052", "DS", "-1"),
    ("0040,A730", "SQ", [[("0040,A123", "PN", "X"), ("0040,A730", "SQ", [[("0040,A124", "UI", "1.2")]])], []]), ("7FE0,0010", "OW", bytes([1, 0, 2, 0, 3, 0, 255, 255])),
]


@pytest.mark.parametrize("implicit", [False, True])
def test_reader(implicit):
    p = dicom.parse(dicom.write(ELEMENTS, implicit))
    assert not p.errors
    got = {e.key: e.text for e in p.elements}
    assert got["0010,0010"] == "Ä^B" if not implicit else "0010,0010" in got
    assert got["0040,A730"] == "<SQ sequence>" or implicit
    if not implicit:
        assert got["0040,A730[0]/0040,A730[0]/0040,A124"] == "1.2" and got["7FE0,0010"] == "<OW binary: 8 bytes [01 00 02 00 03 00 FF FF]>"
        error, a = dicom.pixels(p)
        assert error is None and a.ravel().tolist() == [1, 3, 5, 131069]


@pytest.mark.parametrize("data", [b"", b"text", b"\0" * 4, bytes(128) + b"DICM" + b"\x08\x00\x60\x00CS\xff\xff", bytes(200)])
def test_bad_files_are_rows_with_errors(spark, data):
    rows = dicom.elements(spark.createDataFrame([("f", data)], "path string, content binary")).collect()
    assert any(r.error for r in rows)
    assert dicom.digests(data)["raw"] is None


def test_open_lengths():
    body = b"\x40\x00\x30\xa7SQ\0\0\xff\xff\xff\xff" + b"\xfe\xff\x00\xe0\xff\xff\xff\xff" + b"\x40\x00\x23\xa1PN\x02\x00AB" + b"\xfe\xff\x0d\xe0\0\0\0\0" + b"\xfe\xff\xdd\xe0\0\0\0\0" + b"\xe0\x7f\x10\x00OB\0\0\xff\xff\xff\xff" + b"\xfe\xff\x00\xe0\0\0\0\0" + b"\xfe\xff\x00\xe0\x04\0\0\0abcd" + b"\xfe\xff\xdd\xe0\0\0\0\0"
    p = dicom.parse(bytes(128) + b"DICM" + body)
    assert not p.errors and [(e.key, e.value) for e in p.elements] == [("0040,A730", None), ("0040,A730[0]/0040,A123", b"AB"), ("7FE0,0010", b"abcd")]


def test_discovery(spark, tmp_path):
    good = dicom.write(ELEMENTS)
    for name, data in {"a.dcm": good, "B.DICOM": b"x", "plain": good, "no": b"no", "c.txt": good, "sub/d.DCM": good, "sub/deep/e.dcm": good, "DICOMDIR": b"x"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    at = lambda df: sorted(r.path.removeprefix(f"{tmp_path}/") for r in df.collect())
    root = str(tmp_path)
    assert len(at(files.walk(spark, root))) == 8
    assert at(files.walk(spark, root, 0, "dcm")) == ["a.dcm"] and at(files.walk(spark, root, 1, ".DCM")) == ["a.dcm", "sub/d.DCM"]
    assert at(files.imaging_files(spark, root)) == ["B.DICOM", "a.dcm", "plain", "sub/d.DCM", "sub/deep/e.dcm"]
    assert "c.txt" in at(files.imaging_files(spark, root, openable=True))
    assert at(files.glob(spark, root, "*.dcm")) == ["a.dcm", "sub/deep/e.dcm"] == at(files.glob_or_all(spark, root))
    assert "DICOMDIR" not in at(files.glob_or_all(spark, root, "*.none"))
    chosen = spark.createDataFrame([(f"{root}/a.dcm",)], "path string")
    assert at(files.one_level(spark, root, chosen)) == []
    (tmp_path / "list.txt").write_text(f"{root}/plain\n\n{root}/gone\n")
    assert at(files.listed(spark, f"{root}/list.txt", files.walk(spark, root))) == ["plain"]
    assert len(at(files.manifest_or_scan(spark, f"{root}/no-manifest", root))) == 9
    kept = {r.file.rsplit("/", 1)[1] for r in dicom.read(spark, root).where("key = '0008,0060'").collect()}
    assert kept == {"a.dcm", "plain", "c.txt", "d.DCM", "e.dcm"}


def test_settings():
    assert files.setting({"A": "e"}, {"A": "s"}, "A", "d") == "e" and files.setting({}, {"A": "s"}, "A") == "s" and files.setting({"A": " "}, {}, "A", "d") == "d"
