"""Problems 1, 3 and 4 over a few rows that hold their hard cases, and their operators against brute force."""

import datetime as dt
import random

import pytest

from imaging_engine.operators import compact, skew

FILES = "scan_id long, series_uid string, path string"
SAID = "scan_id long, series_uid string, file_count long, path string"
TAGS = "tag_key string, keyword string, col_type string, tag_value string"
COMPS = "file_path string, tag_key string, tag_value string, loaded_at timestamp"
FRAGS = "frag_id long, frag_path string, frag_size long, body string, path string"


def test_p1(found):
    files = [(1, "a", "/1"), (1, " a ", "/1"), (1, "a", "/2"), (1, None, "/3"), (1, "  ", "/4"), (2, "a", "/1"), (None, "n", "/1"), (1, "a", None)]
    said = [(1, "a", 2, "x"), (1, "NO_SERIES", 1, "x"), (1, "NO_SERIES", 1, "x"), (2, "a", None, "x"), (3, "z", 0, "x"), (3, "y", 4, None), (None, "n", 1, "x")]
    assert found("p1_found", ready_files=(FILES, files), series_info=(SAID, said)) == [(1, "NO_SERIES"), (2, "a"), (3, "y")]


def test_p1_empty(found):
    assert found("p1_found", ready_files=(FILES, []), series_info=(SAID, [(1, "a", 0, None), (1, "b", 1, None)])) == [(1, "b")]
    assert found("p1_found", ready_files=(FILES, []), series_info=(SAID, [])) == []


def test_salted_equals_brute_force(spark):
    rng = random.Random(5)
    rows = [(rng.choice("aaaaaaaab") if rng.random() < 0.9 else None, rng.choice([None, *range(300)])) for _ in range(5_000)]
    want = {}
    for k, v in rows:
        if v is not None:
            want.setdefault(k, set()).add(v)
    df = spark.createDataFrame(rows, "k string, v int")
    got = skew.salted_distinct_count(df, ["k"], "v", "n", heavy_rows=500)
    assert {r.k: r.n for r in got.collect()} == {k: len(v) for k, v in want.items()}
    salts = {r["__k0"]: r.salts for r in skew.heavy_keys(df, ["k"], 500).collect()}
    assert salts["a"] >= 7


def test_p3(found):
    t = [dt.datetime(2025, 1, d) for d in (1, 2)]
    tags = [("0008,0020", "StudyDate", "date", "x"), ("0020,0011", "SeriesNumber", "bigint", "x"), ("0010,1030", "PatientWeight", "double", "x"), ("0008,0060", "Modality", "string", "x"), ("0008,103E", "SeriesDescription", "string", "x")]
    rows = [
        ("bad", "(0008,0020)", "20230230", t[0]), ("bad", "SeriesNumber", "9223372036854775808", t[0]), ("bad", " 0010,1030", "1,5", t[0]), ("bad", "0008,0060", "x", t[0]),
        ("good", "0008,0020", " 2024.02.29 ", t[0]), ("good", "0020,0011", "-7", t[0]), ("good", "0010,1030", "1.5e3", t[0]), ("good", "a/0020,0011", "x", t[0]), ("good", "(0008,103e)", " s ", t[0]),
        ("fixed", "0020,0011", "x", t[0]), ("fixed", "SeriesNumber", "5", t[1]), ("blank", "0020,0011", "x", t[0]), ("blank", "0020,0011", "  ", t[1]), ("nul", "0020,0011", "x", t[0]), ("nul", "0020,0011", None, t[1]),
        ("tie", "0020,0011", "1", t[0]), ("tie", "0020,0011", "2", t[0]), ("tie", "0020,0011", "2", t[0]), ("none", None, "1", t[0]), (None, "0020,0011", "NaN", None),
    ]
    tables = {"tag_dictionary": (TAGS, tags), "comps": (COMPS, rows)}
    assert found("p3_found", **tables) == [("bad", "0008,0020"), ("bad", "0010,1030"), ("bad", "0020,0011"), (None, "0020,0011")]
    wide = {r[0]: r[1:] for r in found("p3_wide", **tables)}
    assert set(wide["good"]) == {None, dt.date(2024, 2, 29), "s", 1500.0, -7}
    assert 2 in wide["tie"] and set(wide["none"]) == {None} and len(wide) == 8


def test_p3_empty(found):
    tags = [("0008,0020", "StudyDate", "date", "x")]
    assert found("p3_found", tag_dictionary=(TAGS, tags), comps=(COMPS, [])) == []
    assert found("p3_wide", tag_dictionary=(TAGS, tags), comps=(COMPS, [("a", "0009,0001", "x", None)])) == [("a", None)]


BODIES = [
    '{"path":"/a","file_size":1}\r\n{"path":"/b","file_size":"2","note":"a, b; {c}"}\n{"path":"/lost","file_si', '﻿[{"path":"/a","file_size":1.0},{"path":"/c","file_size":3e1},{"path":"/lost","file_size":33',
    '{"/d":{"path":"/d","file_size":4},"/e":{"path":"/e","fi', '{"path":"/lost\n{"path":"/f","file_size":6}', "", None, '{"path":"/x","file_size":1.5}{"path":null,"file_size":1}', '{"note":"\\"file_size\\": 0","path":"/g","file_size":7}',
]
WHOLE = [("/a", 1), ("/b", 2), ("/c", 30), ("/d", 4), ("/f", 6), ("/g", 7)]


def test_p4(found):
    rows = [(k, f"/f{k}", None if k == 2 else len(b or ""), b, "x") for k, b in enumerate(BODIES)]
    assert found("p4_found", manifest_fragments=(FRAGS, rows + [(99, "/again", 5, BODIES[0], None)])) == WHOLE
    assert found("p4_found", manifest_fragments=(FRAGS, [])) == []


def test_consolidate_writes_one_file_for_each_group(spark, tmp_path):
    rows = [(k, f"/f{k}", 100, '{"path":"/p%d","file_size":%d}' % (k, k), "x") for k in range(50)]
    df = spark.createDataFrame(rows, FRAGS)
    got = compact.consolidate(spark, df, f"{tmp_path}/out", target_bytes=1000)
    assert sorted(tuple(r) for r in got.collect()) == sorted((f"/p{k}", k) for k in range(50))
    assert len(list((tmp_path / "out").glob("*.parquet"))) == 5


def test_plan_over_many_buckets(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(k, "", rng.randrange(0, 50), k // 7) for k in range(30_000)]
    want, total = {}, 0
    for k, _, n, _ in rows:
        want[k] = total // 1000
        total += n
    got = compact.plan_groups(spark, spark.createDataFrame(rows, "frag_id long, frag_path string, bytes long, bucket long"), 1000)
    assert {r.frag_id: r.grp for r in got.collect()} == want


@pytest.mark.parametrize(("value", "want"), [(1, 1), ("7", 7), (" 8 ", 8), (True, None), ("x", None), (None, None), (2**63, None), ([], None)])
def test_whole(value, want):
    assert compact.whole(value) == want


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
