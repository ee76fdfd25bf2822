"""Text and JSON: white space, words, titles, key-value lines, messages, truth, command and response parsing, sentence finishing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from imaging_engine.functions.deid import SPACE
from imaging_engine.shared import table


def normalized(text: Column) -> Column:
    """Without white space around, one blank between."""
    return F.regexp_replace(F.regexp_replace(text, SPACE, " "), "^ | $", "")


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"([A-Za-z']{2,})"), F.lit(1))


def key_values(text: Column) -> Column:
    """The map of `key: value` lines: parted at the first colon, blank keys dropped, the last of a key wins."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.contains(":"))
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("k"), F.trim(F.substring(x, F.position(F.lit(":"), x) + 1, F.length(x))).alias("v")))
    pairs = F.filter(pairs, lambda p: p["k"] != "")
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last)


def truthy(json: Column) -> Column:
    """A bool itself, a whole number unless 0, a text unless empty; null, fractions, arrays and objects are false. json: the value as JSON text."""
    t = F.trim(json)
    return F.coalesce(F.when(t == "true", True).when(t.rlike("^-?[0-9]+$"), ~t.rlike("^-?0+$")).when(t.startswith('"'), F.length(t) > 2).otherwise(False), F.lit(False))


def message(text: Column) -> tuple[Column, Column]:
    """The kind and the number (between 0 and 1) of a `KIND:payload` message."""
    n = F.regexp_extract(text, "^[A-Za-z_]+:(.*)$", 1).try_cast("double")
    return F.when(text.rlike("^[A-Za-z_]+:"), F.upper(F.substring_index(text, ":", 1))).otherwise("TEXT"), F.when(n.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), n)))


def finish_before(text: str) -> str:
    """What stands before an inserted sentence: ended by a full stop and a blank; white space at the end is dropped."""
    bare = text.rstrip()
    return text if not bare else bare + ("" if bare[-1] in ".!?" else ".") + " "


def finish_after(text: str) -> str:
    """What stands after an inserted sentence: a blank, then a capital (ASCII) letter."""
    bare = text.lstrip()
    if not text:
        return text
    return " " + (bare[:1].upper() if bare[:1].isascii() else bare[:1]) + bare[1:]


def finished_before(text: Column) -> Column:
    bare = F.regexp_replace(text, SPACE + "$", "")
    return F.when(bare == "", text).otherwise(F.concat(bare, F.when(bare.rlike(r"[.!?]$"), " ").otherwise(". ")))


def finished_after(text: Column) -> Column:
    bare = F.regexp_replace(text, "^" + SPACE, "")
    first = F.substring(bare, 1, 1)
    return F.when(text == "", text).otherwise(F.concat(F.lit(" "), F.when(first.rlike("[a-z]"), F.upper(first)).otherwise(first), F.substring(bare, F.lit(2), F.length(bare))))


def block_wrapped(before: Column, block: Column, after: Column) -> Column:
    """The block on lines of its own."""
    lead = F.when((before == "") | before.endswith("\n"), "").otherwise("\n")
    tail = F.when((after == "") | after.startswith("\n"), "").otherwise("\n")
    return F.concat(before, lead, block, tail, after)


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(report_id, report, before, after): the report cut at its caret, which lies within the text or at its end."""
    caret = F.least(F.greatest(F.coalesce("caret_start", F.lit(0)), F.lit(0)), F.length("report")).cast("int")
    r = table(spark, sf_dir, "report_buffers").where("report IS NOT NULL")
    return r.select("report_id", "report", F.substring("report", F.lit(1), caret).alias("before"), F.substring("report", caret + 1, F.length("report")).alias("after"))


def str06_levenshtein(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.levenshtein("p_name", "p_type").alias("distance"))


def str07_whitespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", normalized(F.col("text")).alias("text"))


def str08_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.size(words(F.col("text"))).cast("bigint").alias("n"), F.array_join(F.slice(words(F.col("text")), 1, 3), " ").alias("first"))


def str11_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text put in at the caret as a sentence."""
    return _reports(spark, sf_dir).select("report_id", F.concat(finished_before(F.col("before")), F.lit("Inserted."), finished_after(F.col("after"))).alias("text"))


def str12_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reports(spark, sf_dir).select("report_id", block_wrapped(F.col("before"), F.lit("BLOCK"), F.col("after")).alias("text"))


def str13_key_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = key_values(F.col("report"))
    return _reports(spark, sf_dir).select("report_id", F.explode(m).alias("key", "value"))


def str15_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title, else id, else the first line."""
    r = table(spark, sf_dir, "report_buffers")
    title = F.when(F.col("report_id") % 3 == 0, F.col("series_uid"))
    return r.select("report_id", F.coalesce(title, "template_id", F.substring_index("report", "\n", 1), F.lit("(template)")).alias("title"))


def str18_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, n = message(F.concat(F.regexp_replace("event_type", "[^a-z]", "_"), F.lit(":"), F.round("value", 2).cast("string")))
    return table(spark, sf_dir, "events").select("event_id", kind.alias("kind"), F.round(n, 2).alias("n"))


def str19_base64(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot row's JSON as base64, and read back."""
    j = F.to_json(F.struct("series_uid", "modality"), {"ignoreNullFields": "false"})
    coded = F.regexp_replace(F.base64(F.encode(j, "UTF-8")), r"\s", "")  # in one line
    return table(spark, sf_dir, "series_info").select("row_id", F.length(coded).alias("n"), F.get_json_object(F.decode(F.unbase64(coded), "UTF-8"), "$.series_uid").alias("series_uid"))


def str20_same_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of documents told apart in any letter case."""
    return table(spark, sf_dir, "documents").groupBy(F.lower("lang").alias("lang")).agg(F.count(F.lit(1)).alias("n"))


def jsn01_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth of a number, a text, a fraction and nothing, made from the events' properties."""
    k = F.get_json_object("props", "$.k")
    return table(spark, sf_dir, "events").select("event_id", truthy(k).alias("number"), truthy(F.concat(F.lit('"'), F.when(F.col("event_id") % 2 == 0, "x").otherwise(""), F.lit('"'))).alias("text"), truthy(F.lit("0.5")).alias("fraction"), truthy(F.get_json_object("props", "$.none")).alias("nothing"))


LOOKUP = "map<string,struct<id:string,url:string>>"


def lookup_hits(response: Column, base: str) -> Column:
    """(hash, url) of a lookup response whose id is true."""
    from imaging_engine.operators.ready_files import absolute_url

    entries = F.filter(F.map_entries(F.from_json(response, LOOKUP)), lambda e: F.coalesce(e["value"]["id"] != "", F.lit(False)) & ~F.coalesce(e["value"]["id"], F.lit("0")).isin("0", "false"))
    return F.transform(entries, lambda e: F.struct(e["key"].alias("hash"), absolute_url(e["value"]["url"], base).alias("url")))


def jsn02_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "ready_files").where("hash <> ''").withColumn("clean", F.lower(F.trim(F.regexp_replace("hash", "[^0-9A-Fa-f]", ""))))
    response = F.concat(F.lit('{"'), F.col("clean"), F.lit('": {"id": '), (F.col("file_id") % 3).cast("string"), F.lit(', "url": "/series/'), F.col("file_id").cast("string"), F.lit('"}}'))
    return r.select("file_id", F.explode(lookup_hits(response, "https://pacs.example")).alias("h")).select("file_id", "h.hash", "h.url")


UPLOAD = "uploaded array<array<string>>, duplicates array<array<string>>, failed array<array<string>>"


def jsn03_upload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lists of an upload response as rows; entries of fewer than two parts are no entries."""
    name = F.concat(F.lit('["'), F.regexp_extract("path", r"([^/\\]*)$", 1), F.lit('", "h'), F.col("file_id").cast("string"), F.lit('"]'))
    part = lambda k: F.when(F.col("file_id") % 3 == k, name).otherwise(F.lit('["lonely"]'))
    response = F.concat(F.lit('{"uploaded": ['), part(0), F.lit('], "duplicates": ['), part(1), F.lit('], "failed": ['), part(2), F.lit("]}"))
    p = F.from_json(response, UPLOAD)
    told = lambda k: F.transform(p[k], lambda e: F.struct(F.lit(k).alias("status"), e.alias("e")))
    rows = F.concat(*map(told, ("uploaded", "duplicates", "failed")))
    out = table(spark, sf_dir, "ready_files").select("file_id", F.explode(rows).alias("r")).where("size(r.e) >= 2")
    return out.select("file_id", "r.status", F.col("r.e")[0].alias("name"), F.col("r.e")[1].alias("hash"))


def jsn04_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the documents that are commands; lines that only begin like one are plain text."""
    lines = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", r"\r?\n")).alias("n", "line"))
    j = F.trim("line")
    return lines.where(j.startswith("{")).select("doc_id", F.col("n").cast("bigint").alias("n"), F.coalesce(F.get_json_object(j, "$.cmd"), F.lit("text")).alias("cmd"))


def map01_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row's values over defaults: what is missing is put in, what is there stays."""
    own = F.map_filter(F.create_map(F.lit("modality"), F.col("modality"), F.lit("exam"), F.col("examination")), lambda k, v: v.isNotNull())
    defaults = F.create_map(*[F.lit(x) for x in ("modality", "OT", "exam", "none", "site", "main")])
    merged = F.map_concat(F.map_filter(defaults, lambda k, v: ~F.map_contains_key(own, k)), own)
    return table(spark, sf_dir, "series_info").select("row_id", *[F.element_at(merged, k).alias(k) for k in ("modality", "exam", "site")])


_SP = SPACE
_R = "r AS (SELECT report_id, report, CAST(least(greatest(coalesce(caret_start, 0), 0), length(report)) AS INTEGER) AS c FROM report_buffers WHERE report IS NOT NULL), b AS (SELECT report_id, report, substr(report, 1, c) AS bf, substr(report, c + 1) AS af FROM r)"
_BARE = f"regexp_replace(bf, '{_SP}$', '')"
_BAREA = f"regexp_replace(af, '^{_SP}', '')"
_CLEAN = "lower(regexp_replace(hash, '[^0-9A-Fa-f]', '', 'g'))"

SQL = {
    "str06_levenshtein": "SELECT p_partkey, CAST(levenshtein(p_name, p_type) AS INTEGER) AS distance FROM part",
    "str07_whitespace": f"SELECT doc_id, regexp_replace(regexp_replace(text, '{_SP}', ' ', 'g'), '^ | $', '', 'g') AS text FROM documents WHERE text IS NOT NULL",
    "str08_words": "SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z'']{2,}')) AS n, array_to_string(regexp_extract_all(text, '[A-Za-z'']{2,}')[1:3], ' ') AS first FROM documents WHERE text IS NOT NULL",
    "str11_sentences": f"WITH {_R} SELECT report_id, CASE WHEN {_BARE} = '' THEN bf WHEN regexp_matches({_BARE}, '[.!?]$') THEN {_BARE} || ' ' ELSE {_BARE} || '. ' END || 'Inserted.' || CASE WHEN af = '' THEN '' ELSE ' ' || CASE WHEN regexp_matches({_BAREA}, '^[a-z]') THEN upper(substr({_BAREA}, 1, 1)) ELSE substr({_BAREA}, 1, 1) END || substr({_BAREA}, 2) END AS text FROM b",
    "str12_block": f"WITH {_R} SELECT report_id, bf || CASE WHEN bf = '' OR ends_with(bf, chr(10)) THEN '' ELSE chr(10) END || 'BLOCK' || CASE WHEN af = '' OR starts_with(af, chr(10)) THEN '' ELSE chr(10) END || af AS text FROM b",
    "str13_key_values": f"WITH {_R}, l AS (SELECT report_id, unnest(string_split(report, chr(10))) AS line, unnest(range(1, len(string_split(report, chr(10))) + 1)) AS n FROM b), k AS (SELECT report_id, n, trim(split_part(line, ':', 1)) AS key, trim(substr(line, strpos(line, ':') + 1)) AS value FROM l WHERE contains(line, ':')) SELECT report_id, key, value FROM k WHERE key <> '' QUALIFY row_number() OVER (PARTITION BY report_id, key ORDER BY n DESC) = 1",
    "str15_title": "SELECT report_id, coalesce(CASE WHEN report_id % 3 = 0 THEN series_uid END, template_id, split_part(report, chr(10), 1), '(template)') AS title FROM report_buffers",
    "str18_messages": "SELECT event_id, upper(regexp_replace(event_type, '[^a-z]', '_', 'g')) AS kind, round(least(1.0, greatest(0.0, round(value, 2))), 2) AS n FROM events",
    "str19_base64": "SELECT row_id, CAST(length(base64(encode('{\"series_uid\":' || to_json(series_uid)::VARCHAR || ',\"modality\":' || coalesce(to_json(modality)::VARCHAR, 'null') || '}'))) AS INTEGER) AS n, series_uid FROM series_info",
    "str20_same_letters": "SELECT lower(lang) AS lang, count(*) AS n FROM documents GROUP BY 1",
    "jsn01_truth": "SELECT event_id, coalesce(CAST(json_extract(props, '$.k') AS BIGINT) <> 0, false) AS number, event_id % 2 = 0 AS text, false AS fraction, false AS nothing FROM events",
    "jsn02_lookup": f"SELECT file_id, {_CLEAN} AS hash, 'https://pacs.example/series/' || file_id AS url FROM ready_files WHERE hash <> '' AND file_id % 3 <> 0",
    "jsn03_upload": "SELECT file_id, CASE file_id % 3 WHEN 0 THEN 'uploaded' WHEN 1 THEN 'duplicates' ELSE 'failed' END AS status, regexp_extract(path, '([^/\\\\]*)$', 1) AS name, 'h' || file_id AS hash FROM ready_files WHERE path IS NOT NULL",
    "jsn04_commands": "WITH l AS (SELECT doc_id, unnest(string_split_regex(text, '\\r?\\n')) AS line, unnest(range(0, len(string_split_regex(text, '\\r?\\n')))) AS n FROM documents WHERE text IS NOT NULL) SELECT doc_id, n, coalesce(CASE WHEN json_valid(trim(line)) THEN json_extract_string(trim(line), '$.cmd') END, 'text') AS cmd FROM l WHERE starts_with(trim(line), '{')",
    "map01_merge": "SELECT row_id, coalesce(modality, 'OT') AS modality, coalesce(examination, 'none') AS exam, 'main' AS site FROM series_info",
}
QUERIES = {name: globals()[name] for name in SQL}
