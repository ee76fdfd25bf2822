"""De-identification as column expressions: pseudonyms, UIDs, shifted dates and times, scrubbed text, rules by tag and type of value.

The hash is sha2 of 256 bits, so that all of it stays in generated code. Offsets and pseudonyms hang on a seed and the patient's name, UIDs on
the UID alone. Each date, time and UID is changed once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from imaging_engine.operators.pivot import typed
from imaging_engine.shared import strip, table

SEED = "seed"
#: White space as Unicode has it.
SPACE = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
#: Tags whose value is cleared (or removed, where it is a sequence), by group.
CLEARED = (
    "0008,0080", "0008,0081", "0010,1040", "0010,4000", "0008,0092", "0008,0090", "0008,1050", "0008,1070", "0008,0050", "0020,0010", "0018,1000", "0010,1000", "0010,1002", "0008,0094",
    "0008,1010", "0008,1040", "0008,1048", "0008,1060", "0008,1080", "0008,2111", "0010,1001", "0010,0040", "0010,1010", "0010,1020", "0010,1030", "0010,1090", "0010,2160", "0010,2180",
    "0010,21B0", "0020,4000", "0040,0275", "0040,A730",
)
#: Types whose text is blanked, descriptive tags whose text is scrubbed instead, types that a private element may have.
TEXT_VRS = ("UT", "LT", "SH", "LO", "PN")
SCRUBBED = ("0008,1030", "0008,103E", "0008,1090", "0018,1030")
SAFE_PRIVATE_VRS = ("US", "SS", "UL", "SL", "FL", "FD", "IS", "DS", "CS", "DA", "DT", "TM")
LINKED_CREATOR = "MITRA LINKED ATTRIBUTES 1.0"


def seeded(name: Column, seed: str = SEED) -> Column:
    return F.concat(F.lit(seed + ":"), name) if seed else name


def pseudonym(name: Column, seed: str = SEED) -> Column:
    """ANON- and twelve hexadecimal digits; a missing name is ANON."""
    return F.concat(F.lit("ANON-"), F.substring(F.sha2(F.concat(F.lit(seed + ":"), F.coalesce(name, F.lit("ANON"))), 256), 1, 12))


def pseudonym_id(name: Column, seed: str = SEED) -> Column:
    return F.concat(F.lit("ID-"), F.substring(F.sha2(F.concat(F.lit(seed + ":"), F.coalesce(name, F.lit("ANON")), F.lit(":id")), 256), 1, 12))


def _hash60(name: Column, seed: str) -> Column:
    return F.conv(F.substring(F.sha2(seeded(F.coalesce(name, F.lit("ANON")), seed), 256), 1, 15), 16, 10).cast("bigint")


def day_offset(name: Column, seed: str = SEED) -> Column:
    """Between ten years back and ten years on."""
    return (_hash60(name, seed) % 7301 - 3650).cast("int")


def minute_offset(name: Column, seed: str = SEED) -> Column:
    return (_hash60(name, seed) % 1440 - 720).cast("int")


def hex_to_decimal(h: Column) -> Column:
    """32 hexadecimal digits as decimal text, in decimals of 38 digits: the high 60 bits times 2**68, in two parts."""
    d = lambda x: F.conv(x, 16, 10).cast("decimal(19,0)")
    hi = d(F.substring(h, 1, 15))
    lo = d(F.substring(h, 16, 1)).cast("decimal(38,0)") * F.lit(str(2**64)).cast("decimal(20,0)") + F.conv(F.substring(h, 17, 16), 16, 10).cast("decimal(20,0)")
    t = (hi * F.lit("5147905179352825856").cast("decimal(19,0)") + lo).cast("decimal(38,0)")
    ten = F.lit(str(10**19)).cast("decimal(20,0)")
    # the quotient of so long decimals is rounded: the remainder is taken from whole numbers only
    b = t % ten
    a = (hi * F.lit(29).cast("decimal(2,0)") + ((t - b) / ten).cast("decimal(20,0)")).cast("decimal(38,0)")
    return F.when(a == 0, b.cast("string")).otherwise(F.concat(a.cast("decimal(38,0)").cast("string"), F.lpad(b.cast("decimal(20,0)").cast("string"), 19, "0")))


def hashed_uid(uid: Column) -> Column:
    """2.25. and the first sixteen bytes of the hash as a number."""
    return F.concat(F.lit("2.25."), hex_to_decimal(F.substring(F.sha2(uid, 256), 1, 32)))


def derived_uid(uid: Column, value: Column) -> Column:
    """The UID of the part of a series that has this value; 64 signs at most, as UIDs must."""
    return hashed_uid(F.concat(uid, F.lit(":split:"), value))


def shifted_date(text: Column, days: Column) -> Column:
    """yyyyMMdd at the start, moved; what is no date stays."""
    day = typed(F.substring(text, 1, 8), "date")
    return F.when(text.rlike("^[0-9]{8}") & day.isNotNull(), F.date_format(F.date_add(day, days), "yyyyMMdd")).otherwise(text)


def shifted_datetime(text: Column, days: Column) -> Column:
    """As a date, with what follows kept."""
    day = typed(F.substring(text, 1, 8), "date")
    return F.when(text.rlike("^[0-9]{8}") & day.isNotNull(), F.concat(F.date_format(F.date_add(day, days), "yyyyMMdd"), F.substring(text, 9, 1000))).otherwise(text)


def rotated_time(text: Column, minutes: Column) -> Column:
    """HHMMSS, HHMM or HH:MM:SS, moved around the clock and written as HHMMSS; what is no time stays."""
    bare = F.regexp_replace(text, ":", "")
    full = F.rpad(bare, 6, "0")
    good = text.rlike(r"^([01][0-9]|2[0-3])([0-5][0-9])([0-5][0-9])?$|^([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]$")
    part = lambda at: F.substring(full, at, 2).try_cast("int")
    s = F.pmod(part(1) * 3600 + part(3) * 60 + part(5) + minutes * 60, F.lit(86400))
    return F.when(good, F.format_string("%02d%02d%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)).otherwise(text)


def kept_tokens(text: Column, name: Column, pid: Column, days: Column) -> Column:
    """The tokens of a text that stay: without the name, the id, e-mail addresses and long numbers; whole dates are moved."""
    has = lambda t, x: F.coalesce((x != "") & F.contains(F.lower(t), F.lower(x)), F.lit(False))

    def keep(token: Column) -> Column:
        t = F.regexp_replace(token, r"^[^\p{L}\p{N}@.\-]+|[^\p{L}\p{N}@.\-]+$", "")
        date = typed(t, "date")
        gone = (t == "") | has(t, name) | has(t, pid) | (F.contains(t, F.lit("@")) & F.contains(t, F.lit(".")))
        return (
            F.when(gone, F.lit(None)).when(t.rlike("^[0-9]{8}$"), F.date_format(F.date_add(date, days), "yyyyMMdd"))
            .when(F.length(F.regexp_replace(t, "[^0-9]", "")) >= 6, F.lit(None)).otherwise(token)
        )

    return F.array_compact(F.transform(F.split(text, SPACE), keep))


def scrubbed(text: Column, name: Column, pid: Column, days: Column) -> Column:
    return F.array_join(kept_tokens(text, name, pid, days), " ")


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, tag, grp, elem, vr, value): the top-level elements of comps, by their latest value; elements the dictionary doesn't know are UN."""
    d = table(spark, sf_dir, "tag_dictionary").select("tag_key", "keyword", "vr")
    rows = table(spark, sf_dir, "comps").select(F.col("file_path").alias("file"), strip(F.col("tag_key")).alias("key"), strip(F.col("tag_value")).alias("value"), "loaded_at")
    bare = F.upper(strip(F.regexp_replace("key", r"^\(|\)$", "")))
    rows = rows.join(d.select(F.col("tag_key").alias("of_keyword"), "keyword"), F.col("key") == F.col("keyword"), "left")
    rows = rows.withColumn("tag", F.coalesce("of_keyword", F.when(bare.rlike("^[0-9A-F]{4},[0-9A-F]{4}$"), bare))).where("tag IS NOT NULL")
    last = rows.groupBy("file", "tag").agg(F.max(F.struct("loaded_at", "value")).alias("l"))
    part = lambda at: F.conv(F.substring("tag", at, 4), 16, 10).cast("int")
    out = last.join(d.select(F.upper("tag_key").alias("tag"), "vr"), "tag", "left")
    return out.select("file", "tag", part(1).alias("grp"), part(6).alias("elem"), F.coalesce("vr", F.lit("UN")).alias("vr"), F.coalesce("l.value", F.lit("")).alias("value"))


def is_private(grp: Column) -> Column:
    return grp.bitwiseAND(1) == 1


def is_overlay(grp: Column) -> Column:
    return grp.between(0x6000, 0x60FF) | (grp == 0x0070)


def with_patient(rows: DataFrame) -> DataFrame:
    """Each element with its file's patient name and id."""
    of = lambda tag: F.max(F.when(F.col("tag") == tag, F.col("value")))
    return rows.join(rows.groupBy("file").agg(of("0010,0010").alias("name"), of("0010,0020").alias("pid")), "file")


def anonymised(rows: DataFrame, seed: str = SEED, preserve_private: bool = False, permit_burned_in: bool = False) -> DataFrame:
    """The elements without what identifies: one rule decides for each element. Files with burned-in annotations are left out unless permitted."""
    if not permit_burned_in:
        burned = rows.where((F.col("tag") == "0028,0301") & (F.upper("value") == "YES")).select("file").distinct()
        rows = rows.join(burned, "file", "left_anti")
    creators = rows.where("grp = 49 AND elem BETWEEN 16 AND 255").select(F.col("file").alias("of"), F.col("elem").alias("block"), F.col("value").alias("creator"))
    rows = with_patient(rows).join(creators, (F.col("file") == F.col("of")) & (F.col("grp") == 0x31) & (F.shiftright("elem", 8) == F.col("block")), "left")
    tag, vr, value, name = (F.col(c) for c in ("tag", "vr", "value", "name"))
    private = is_private(F.col("grp"))
    safe = F.col("elem").between(0x10, 0xFF) | vr.isin(*SAFE_PRIVATE_VRS)
    linked = private & (F.col("creator") == LINKED_CREATOR) & (F.col("elem").bitwiseAND(0xFF) == 0x20)
    days, minutes = day_offset(name, seed), minute_offset(name, seed)
    new = (
        F.when(tag == "0010,0010", pseudonym(name, seed)).when(tag == "0010,0020", pseudonym_id(name, seed)).when(linked, hashed_uid(value))
        .when(tag.isin(*CLEARED), F.lit("")).when(tag.isin(*SCRUBBED), scrubbed(value, name, F.col("pid"), days)).when(vr == "UI", hashed_uid(value))
        .when(vr == "DA", shifted_date(value, days)).when(vr == "DT", shifted_datetime(value, days)).when(vr == "TM", rotated_time(value, minutes))
        .when(~private & vr.isin(*TEXT_VRS), F.lit("")).otherwise(value)
    )
    kept = ~is_overlay(F.col("grp")) & ~((vr == "SQ") & tag.isin(*CLEARED))
    kept = kept & (~private | (safe | F.coalesce(linked, F.lit(False))) if preserve_private else ~private)
    return rows.where(kept).select("file", "tag", vr, value.alias("original"), new.alias("value"))


def snk01_anonymised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anonymised(elements(spark, sf_dir)).select("file", "tag", "value")


def snk02_audit_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each name and id was replaced by."""
    rows = anonymised(elements(spark, sf_dir)).where("tag IN ('0010,0010', '0010,0020') AND original <> ''")
    return rows.select("file", F.when(F.col("tag") == "0010,0010", "PatientName").otherwise("PatientID").alias("kind"), "original", F.col("value").alias("replacement"))


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "series_info")


def str01_pseudonym(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("patient_name")
    return _series(spark, sf_dir).select("row_id", pseudonym(n).alias("name"), pseudonym_id(n).alias("id"))


def str02_scrub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The examination without the patient's name, id, addresses and long numbers, its dates moved."""
    text = F.concat_ws(" ", "examination", "series_description", "patient_name", "patient_id", "study_date")
    return _series(spark, sf_dir).select("row_id", scrubbed(text, F.col("patient_name"), F.col("patient_id"), day_offset(F.col("patient_name"))).alias("text"))


def str03_uid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _series(spark, sf_dir).select("row_id", hashed_uid(F.col("series_uid")).alias("uid"))


def str04_derived_uid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _series(spark, sf_dir).where("series_description IS NOT NULL").select("row_id", derived_uid(F.col("series_uid"), F.col("series_description")).alias("uid"))


def str16_tag_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tag's two numbers, and the tag made of them again."""
    rows = elements(spark, sf_dir).select("tag", "grp", "elem").distinct()
    return rows.select("tag", "grp", "elem", F.format_string("(%04X,%04X)", "grp", "elem").alias("formatted"))


def str21_blank_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = F.col("tag").isin("0010,0010", "0010,0020", *SCRUBBED)
    return elements(spark, sf_dir).select("file", "tag", F.when(F.col("vr").isin(*TEXT_VRS) & ~keep, "").otherwise(F.col("value")).alias("value"))


def str22_cleared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elements(spark, sf_dir).where(F.col("tag").isin(*CLEARED)).select("file", "tag", F.lit("").alias("value"))


def dt01_day_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _series(spark, sf_dir).select("row_id", day_offset(F.col("patient_name")).alias("days"))


def dt02_minute_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _series(spark, sf_dir).select("row_id", minute_offset(F.col("patient_name")).alias("minutes"))


def dt03_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _series(spark, sf_dir).select("row_id", shifted_date(F.col("study_date"), day_offset(F.col("patient_name"))).alias("study_date"))


def dt04_datetime(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.date_format("snapshot_at", "yyyyMMddHHmmss")
    return _series(spark, sf_dir).select("row_id", shifted_datetime(text, day_offset(F.col("patient_name"))).alias("at"))


def dt05_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    form = lambda f: F.date_format("snapshot_at", f)
    text = F.when(F.col("row_id") % 4 == 0, form("HHmmss")).when(F.col("row_id") % 4 == 1, form("HHmm")).when(F.col("row_id") % 4 == 2, form("HH:mm:ss")).otherwise("no time")
    return _series(spark, sf_dir).select("row_id", rotated_time(text, minute_offset(F.col("patient_name"))).alias("at"))


def flt12_burned_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files to reject, told apart instead of failing the job."""
    return elements(spark, sf_dir).where((F.col("tag") == "0028,0301") & (F.upper("value") == "YES")).select("file")


def flt13_private(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elements(spark, sf_dir).where(is_private(F.col("grp"))).select("file", "tag")


def flt14_safe_private(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = elements(spark, sf_dir).where(is_private(F.col("grp")))
    return rows.where(F.col("elem").between(0x10, 0xFF) | F.col("vr").isin(*SAFE_PRIVATE_VRS)).select("file", "tag")


def flt15_no_overlays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elements(spark, sf_dir).where(~is_overlay(F.col("grp"))).groupBy("file").agg(F.count(F.lit(1)).alias("n"))


def flt16_has_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with and without a slice location."""
    with_ = F.max(F.when((F.col("tag") == "0020,1041") & (F.col("value") != ""), 1).otherwise(0)).alias("there")
    return elements(spark, sf_dir).groupBy("file").agg(with_).agg(F.count_if(F.col("there") == 1).alias("kept"), F.count_if(F.col("there") == 0).alias("skipped"))


def flt17_dropped_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many tokens of each report the scrub leaves."""
    n = F.size(kept_tokens(F.col("report"), F.lit(""), F.lit(""), F.lit(0)))
    return table(spark, sf_dir, "report_buffers").where("report IS NOT NULL").select("report_id", n.cast("bigint").alias("kept"))


def joi10_creators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Private elements with the creator of their block, which stands in the same file and group."""
    rows = elements(spark, sf_dir).where(is_private(F.col("grp")))
    a = rows.where("elem > 255").select("file", "grp", "tag", F.shiftright("elem", 8).alias("block"))
    b = rows.where("elem BETWEEN 16 AND 255").select("file", "grp", F.col("elem").alias("block"), F.col("value").alias("creator"))
    return a.join(b, ["file", "grp", "block"], "left").select("file", "tag", "creator")


_E = """el AS (SELECT file, tag, CAST(('0x' || substr(tag, 1, 4)) AS INTEGER) AS grp, CAST(('0x' || substr(tag, 6, 4)) AS INTEGER) AS elem, coalesce(vr, 'UN') AS vr, coalesce(value, '') AS value FROM (
  SELECT file_path AS file, coalesce(k.tag_key, CASE WHEN regexp_full_match(upper(trim(regexp_replace(trim(c.tag_key), '^\\(|\\)$', '', 'g'))), '[0-9A-F]{4},[0-9A-F]{4}') THEN upper(trim(regexp_replace(trim(c.tag_key), '^\\(|\\)$', '', 'g'))) END) AS tag,
  trim(tag_value) AS value, loaded_at FROM comps c LEFT JOIN tag_dictionary k ON trim(c.tag_key) = k.keyword) e LEFT JOIN (SELECT upper(tag_key) AS t, vr FROM tag_dictionary) d ON e.tag = d.t
  WHERE tag IS NOT NULL QUALIFY row_number() OVER (PARTITION BY file, tag ORDER BY loaded_at DESC NULLS LAST, value DESC NULLS LAST) = 1)"""
_NAME = "coalesce(patient_name, 'ANON')"
_H60 = "CAST('0x' || substr(sha256('seed:' || {0}), 1, 15) AS BIGINT)"
_DAYS, _MINUTES = (f"CAST({_H60} % {a} - {b} AS INTEGER)" for a, b in ((7301, 3650), (1440, 720)))
_UID = "'2.25.' || CAST(CAST('0x' || substr(sha256({0}), 1, 32) AS UHUGEINT) AS VARCHAR)"
_ISDATE = "regexp_full_match({0}, '[0-9]{{8}}') AND try_cast(substr({0}, 1, 4) || '-' || substr({0}, 5, 2) || '-' || substr({0}, 7, 2) AS DATE) IS NOT NULL"
_MOVED = "strftime(CAST(substr({0}, 1, 4) || '-' || substr({0}, 5, 2) || '-' || substr({0}, 7, 2) AS DATE) + {1}, '%Y%m%d')"
_KEEP = """list_filter(list_transform(string_split_regex({text}, '{space}'), lambda w: CASE
  WHEN regexp_replace(w, '^[^\\p{{L}}\\p{{N}}@.\\-]+|[^\\p{{L}}\\p{{N}}@.\\-]+$', '', 'g') = '' THEN NULL
  WHEN {name} <> '' AND contains(lower(w), lower({name})) THEN NULL WHEN {pid} <> '' AND contains(lower(w), lower({pid})) THEN NULL
  WHEN contains(regexp_replace(w, '^[^\\p{{L}}\\p{{N}}@.\\-]+|[^\\p{{L}}\\p{{N}}@.\\-]+$', '', 'g'), '@') AND contains(regexp_replace(w, '^[^\\p{{L}}\\p{{N}}@.\\-]+|[^\\p{{L}}\\p{{N}}@.\\-]+$', '', 'g'), '.') THEN NULL
  WHEN regexp_full_match(regexp_replace(w, '^[^\\p{{L}}\\p{{N}}@.\\-]+|[^\\p{{L}}\\p{{N}}@.\\-]+$', '', 'g'), '[0-9]{{8}}') THEN strftime(try_strptime(regexp_replace(w, '[^0-9]', '', 'g'), '%Y%m%d') + to_days({days}), '%Y%m%d')
  WHEN length(regexp_replace(w, '[^0-9]', '', 'g')) >= 6 THEN NULL ELSE w END), lambda x: x IS NOT NULL)"""
_IN = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"
_DATE_ROW = f"CASE WHEN {_ISDATE.format('substr(study_date, 1, 8)')} THEN {_MOVED.format('study_date', _DAYS.format(_NAME))} ELSE study_date END"

SQL = {
    "str01_pseudonym": f"SELECT row_id, 'ANON-' || substr(sha256('seed:' || {_NAME}), 1, 12) AS name, 'ID-' || substr(sha256('seed:' || {_NAME} || ':id'), 1, 12) AS id FROM series_info",
    "str02_scrub": "WITH s AS (SELECT row_id, concat_ws(' ', examination, series_description, patient_name, patient_id, study_date) AS text, coalesce(patient_name, '') AS pn, coalesce(patient_id, '') AS pi, "
    + _DAYS.format(_NAME) + " AS days FROM series_info) SELECT row_id, array_to_string(" + _KEEP.format(text="text", space=SPACE, name="pn", pid="pi", days="days") + ", ' ') AS text FROM s",
    "str03_uid": f"SELECT row_id, {_UID.format('series_uid')} AS uid FROM series_info",
    "str04_derived_uid": f"SELECT row_id, {_UID.format("series_uid || ':split:' || series_description")} AS uid FROM series_info WHERE series_description IS NOT NULL",
    "str16_tag_numbers": f"WITH {_E} SELECT DISTINCT tag, grp, elem, '(' || tag || ')' AS formatted FROM el",
    "str21_blank_text": f"WITH {_E} SELECT file, tag, CASE WHEN vr IN {_IN(TEXT_VRS)} AND tag NOT IN {_IN(('0010,0010', '0010,0020', *SCRUBBED))} THEN '' ELSE value END AS value FROM el",
    "str22_cleared": f"WITH {_E} SELECT file, tag, '' AS value FROM el WHERE tag IN {_IN(CLEARED)}",
    "dt01_day_offset": f"SELECT row_id, {_DAYS.format(_NAME)} AS days FROM series_info",
    "dt02_minute_offset": f"SELECT row_id, {_MINUTES.format(_NAME)} AS minutes FROM series_info",
    "dt03_date": f"SELECT row_id, {_DATE_ROW} AS study_date FROM series_info",
    "dt04_datetime": f"SELECT row_id, strftime(CAST(snapshot_at AS DATE) + {_DAYS.format(_NAME)}, '%Y%m%d') || strftime(snapshot_at, '%H%M%S') AS at FROM series_info",
    "dt05_time": f"SELECT row_id, CASE row_id % 4 WHEN 3 THEN 'no time' WHEN 1 THEN strftime(date_trunc('minute', snapshot_at) + to_minutes({_MINUTES.format(_NAME)}), '%H%M%S') ELSE strftime(snapshot_at + to_minutes({_MINUTES.format(_NAME)}), '%H%M%S') END AS at FROM series_info",
    "flt12_burned_in": f"WITH {_E} SELECT file FROM el WHERE tag = '0028,0301' AND upper(value) = 'YES'",
    "flt13_private": f"WITH {_E} SELECT file, tag FROM el WHERE grp % 2 = 1",
    "flt14_safe_private": f"WITH {_E} SELECT file, tag FROM el WHERE grp % 2 = 1 AND (elem BETWEEN 16 AND 255 OR vr IN {_IN(SAFE_PRIVATE_VRS)})",
    "flt15_no_overlays": f"WITH {_E} SELECT file, count(*) AS n FROM el WHERE NOT (grp BETWEEN 24576 AND 24831 OR grp = 112) GROUP BY 1",
    "flt16_has_location": f"WITH {_E}, f AS (SELECT file, bool_or(tag = '0020,1041' AND value <> '') AS there FROM el GROUP BY 1) SELECT count(*) FILTER (WHERE there) AS kept, count(*) FILTER (WHERE NOT there) AS skipped FROM f",
    "flt17_dropped_tokens": "SELECT report_id, CAST(len(" + _KEEP.format(text="report", space=SPACE, name="''", pid="''", days="0") + ") AS BIGINT) AS kept FROM report_buffers WHERE report IS NOT NULL",
    "joi10_creators": f"WITH {_E}, p AS (SELECT * FROM el WHERE grp % 2 = 1) SELECT a.file, a.tag, b.value AS creator FROM p a LEFT JOIN p b ON a.file = b.file AND a.grp = b.grp AND a.elem >> 8 = b.elem AND b.elem BETWEEN 16 AND 255 WHERE a.elem > 255",
    "snk02_audit_map": f"""WITH {_E}, n AS (SELECT file, max(value) FILTER (WHERE tag = '0010,0010') AS name FROM el GROUP BY 1), b AS (SELECT file FROM el WHERE tag = '0028,0301' AND upper(value) = 'YES')
SELECT el.file, CASE tag WHEN '0010,0010' THEN 'PatientName' ELSE 'PatientID' END AS kind, value AS original,
  CASE tag WHEN '0010,0010' THEN 'ANON-' || substr(sha256('seed:' || coalesce(name, 'ANON')), 1, 12) ELSE 'ID-' || substr(sha256('seed:' || coalesce(name, 'ANON') || ':id'), 1, 12) END AS replacement
FROM el JOIN n ON el.file = n.file WHERE tag IN ('0010,0010', '0010,0020') AND value <> '' AND el.file NOT IN (SELECT file FROM b)""",
}
QUERIES = {name: globals()[name] for name in SQL} | {"snk01_anonymised": snk01_anonymised}
