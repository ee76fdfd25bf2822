"""Any number of files compared key by key.

The comparison stays long, (key, file, value): a key is one group, whatever the number of files, and no file becomes a column unless the
caller names it. Of a file's repeated key the value loaded last counts (of one moment the greater). A missing value differs from any value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from imaging_engine.shared import strip, table

#: A key or an alias that holds one of these is likely to identify a person.
IDENTIFYING = (
    "patient", "person", "name", "birth", "address", "institution", "physician", "operator", "performing", "referring", "requesting", "telephone", "phone", "email",
    "mail", "accession", "medicalrecord", "medical record", "studyid", "admission", "insurance", "occupation", "religion", "ethnic", "uid", "identifier", "id",
)


def values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, file, value) of comps: blanks around keys and values don't count."""
    rows = table(spark, sf_dir, "comps").select(strip(F.col("tag_key")).alias("key"), F.col("file_path").alias("file"), strip(F.col("tag_value")).alias("value"), "loaded_at")
    rows = rows.where("key <> '' AND file IS NOT NULL")
    return rows.groupBy("key", "file").agg(F.max(F.struct("loaded_at", "value")).alias("l")).select("key", "file", F.col("l.value").alias("value"))


def study(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files that are compared with one another: those of a directory (run), so that each has few files but there are many sets."""
    return values(spark, sf_dir).withColumn("run", F.regexp_extract("file", r"^(.*)[/\\][^/\\]*$", 1))


_W = """w AS (SELECT key, file, run, value FROM (SELECT trim(tag_key) AS key, file_path AS file, trim(tag_value) AS value, loaded_at, regexp_extract(file_path, '^(.*)[/\\\\][^/\\\\]*$', 1) AS run FROM comps)
  WHERE key <> '' AND file IS NOT NULL QUALIFY row_number() OVER (PARTITION BY key, file ORDER BY loaded_at DESC NULLS LAST, value DESC NULLS LAST) = 1)"""


def joi07_key_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys of all files of a set, with how many files have each: the full outer join of any number of files, kept long."""
    return study(spark, sf_dir).groupBy("run", "key").agg(F.count(F.lit(1)).alias("n_files"))


def full_outer(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two files side by side."""
    return left.select("key", F.col("value").alias("a")).join(right.select("key", F.col("value").alias("b")), "key", "full_outer")


def joi07_two_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first and the last file of the metadata, key by key."""
    df = values(spark, sf_dir)
    ends = df.agg(F.min("file").alias("lo"), F.max("file").alias("hi")).select(F.posexplode(F.array("lo", "hi")).alias("side", "file"))
    both = df.join(ends, "file")
    return full_outer(both.where("side = 0"), both.where("side = 1"))


def joi08_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the tag form of a value leaves empty and the keyword form of the same attribute does not."""
    d = table(spark, sf_dir, "tag_dictionary").select("tag_key", "keyword")
    v = values(spark, sf_dir).select("key", "file", F.coalesce("value", F.lit("")).alias("value"))
    a = v.join(d, F.col("key") == F.col("tag_key")).where("value = ''").select("file", "keyword")
    b = v.join(d, F.col("key") == F.col("keyword")).where("value <> ''").select("file", "keyword", "value")
    return a.join(b, ["file", "keyword"])


def segments(key: Column) -> Column:
    """The parts of a nested key."""
    return F.split(key, "/")


def with_alias(df: DataFrame, dictionary: DataFrame) -> DataFrame:
    """The alias of a key's last part (without an index), or the part itself. No join hints at a broadcast: dictionaries are small enough for the optimizer to see."""
    leaf = F.regexp_replace(F.element_at(segments(F.col("key")), -1), r"\[[0-9]+\]$", "")
    d = dictionary.select(F.upper("tag_key").alias("__t"), "alias", "keyword", "tag_key")
    return df.withColumn("__leaf", leaf).join(d, F.upper("__leaf") == F.col("__t"), "left").withColumn("alias", F.coalesce("alias", "__leaf")).drop("__t", "__leaf")


def prj07_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_alias(values(spark, sf_dir).select("key").distinct(), table(spark, sf_dir, "tag_dictionary")).select("key", "alias")


def prj08_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth, last part and the full label of a key."""
    s = segments(F.col("key"))
    return values(spark, sf_dir).select("key").distinct().select("key", (F.size(s) - 1).cast("bigint").alias("depth"), F.element_at(s, -1).alias("leaf"), F.array_join(s, " / ").alias("label"))


def joi09_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each key with its tag: given in hexadecimal or as keyword; unknown ones say so."""
    keys = values(spark, sf_dir).select("key").distinct()
    d = table(spark, sf_dir, "tag_dictionary").select("tag_key", "keyword")
    hexa = F.when(F.upper("key").rlike("^[0-9A-F]{4},[0-9A-F]{4}$"), F.upper("key"))
    return keys.join(d, F.col("key") == F.col("keyword"), "left").select("key", F.coalesce(hexa, "tag_key", F.lit("unknown")).alias("tag"))


def names_person(text: Column) -> Column:
    return text.rlike("(?i)" + "|".join(IDENTIFYING))


def looks_personal(value: Column) -> Column:
    """An @, or eight digits anywhere."""
    return F.coalesce(value.contains("@") | (F.length(F.regexp_replace(value, "[^0-9]", "")) >= 8), F.lit(False))


def flt01_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that hold the text themselves or in a value, in any letter case."""
    t = "patient"
    return values(spark, sf_dir).where(F.lower("key").contains(t) | F.lower("value").contains(t)).select("key").distinct()


def flt02_identifiable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that name a person themselves or by the alias of any of their parts, or that have a value which looks personal."""
    rows = values(spark, sf_dir)
    keys = rows.groupBy("key").agg(F.bool_or(looks_personal(F.col("value"))).alias("personal"))
    parts = with_alias(keys.select(F.col("key").alias("of"), "personal", F.explode(segments(F.col("key"))).alias("key")), table(spark, sf_dir, "tag_dictionary"))
    return parts.groupBy(F.col("of").alias("key")).agg(F.bool_or(F.col("personal") | names_person(F.col("of")) | names_person(F.col("alias"))).alias("yes")).where("yes").select("key")


def sameness(rows: DataFrame) -> DataFrame:
    """(run, key, same): whether all files of the run have the key with one value. Counts of distinct values by minimum and maximum, so no group is collected."""
    total = rows.groupBy("run").agg(F.count_distinct("file").alias("files"))
    text = F.coalesce("value", F.lit(""))
    keys = rows.groupBy("run", "key").agg(F.count(F.lit(1)).alias("n"), F.min(text).alias("lo"), F.max(text).alias("hi"))
    return keys.join(total, "run").select("run", "key", ((F.col("n") == F.col("files")) & (F.col("lo") == F.col("hi"))).alias("same"))


def agg10_all_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sameness(study(spark, sf_dir))


def flt03_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sameness(study(spark, sf_dir)).where("NOT same").select("run", "key")


def common_prefix(a: Column, b: Column) -> Column:
    """Characters that two texts begin with in common. Of many texts, those of the least and the greatest: all others lie between them."""
    n = F.least(F.length(a), F.length(b))
    differ = F.filter(F.sequence(F.lit(1), n), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)))
    return F.when(n == 0, 0).otherwise(F.coalesce(F.try_element_at(differ, F.lit(1)) - 1, n))


def agg17_common_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The common beginning and end of the values of a key."""
    rows = study(spark, sf_dir).where("value <> ''")
    g = rows.groupBy("run", "key").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.min(F.reverse("value")).alias("rlo"), F.max(F.reverse("value")).alias("rhi"))
    pre = F.substring("lo", F.lit(1), common_prefix(F.col("lo"), F.col("hi")))
    suf = F.reverse(F.substring("rlo", F.lit(1), common_prefix(F.col("rlo"), F.col("rhi"))))
    return g.select("run", "key", pre.alias("prefix"), suf.alias("suffix"))


def marked(value: Column, prefix: Column, suffix: Column) -> Column:
    """The value with the part that differs in brackets; all of it where beginning and end leave none."""
    p, s, n = F.length(prefix), F.length(suffix), F.length(value)
    return F.when(p + s >= n, value).otherwise(F.concat(prefix, F.lit("[["), F.substring(value, p + 1, n - p - s), F.lit("]]"), suffix))


def str14_difference_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = study(spark, sf_dir).where("value <> ''")
    return rows.join(agg17_common_ends(spark, sf_dir), ["run", "key"]).select("key", "file", marked(F.col("value"), F.col("prefix"), F.col("suffix")).alias("marked"))


def shortened(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def str05_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "comps").where("tag_value IS NOT NULL").select("file_path", shortened(F.col("tag_value"), 5).alias("short"))


def prefixes(key: Column) -> Column:
    """All ancestors of a nested key, the longest last, itself not among them."""
    s = segments(key)
    return F.when(F.size(s) > 1, F.transform(F.sequence(F.lit(1), F.size(s) - 1), lambda i: F.array_join(F.slice(s, 1, i), "/"))).otherwise(F.array().cast("array<string>"))


def str17_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return values(spark, sf_dir).select("key").distinct().select("key", F.explode(prefixes(F.col("key"))).alias("ancestor"))


def joi15_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the tree: keys and the parents that their paths imply; has_value tells which exist themselves."""
    keys = values(spark, sf_dir).select("key").distinct()
    nodes = keys.union(keys.select(F.explode(prefixes(F.col("key"))))).distinct().withColumnRenamed("key", "node")
    return nodes.join(keys, F.col("node") == F.col("key"), "left").select("node", F.col("key").isNotNull().alias("has_value"), (F.size(segments(F.col("node"))) - 1).cast("bigint").alias("depth"))


def flt18_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose ancestors are all expanded; here those of the even items are."""
    keys = values(spark, sf_dir).select("key").distinct()
    return keys.where(F.forall(prefixes(F.col("key")), lambda a: a.rlike(r"\[[0-9]*[02468]\]$")))


def set01_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return values(spark, sf_dir).select("key").union(table(spark, sf_dir, "tag_dictionary").select("tag_key")).distinct()


def map02_key_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of a file's metadata map; a file's own keys bound the map."""
    maps = values(spark, sf_dir).groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("key", F.coalesce("value", F.lit(""))))).alias("m"))
    return maps.select("file", F.size(F.map_keys("m")).cast("bigint").alias("n"), F.try_element_at("m", F.lit("0008,0060")).alias("modality"))


def srt06_sorted_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return values(spark, sf_dir).select("key").distinct().orderBy("key")


_CPL = "coalesce(list_min(list_filter(range(1, least(length({0}), length({1})) + 1), lambda i: substr({0}, i, 1) <> substr({1}, i, 1))) - 1, least(length({0}), length({1})))"
_ENDS = f"""{_W}, g AS (SELECT run, key, min(value) AS lo, max(value) AS hi, min(reverse(value)) AS rlo, max(reverse(value)) AS rhi FROM w WHERE value <> '' GROUP BY 1, 2),
e AS (SELECT run, key, substr(lo, 1, {_CPL.format('lo', 'hi')}) AS prefix, reverse(substr(rlo, 1, {_CPL.format('rlo', 'rhi')})) AS suffix FROM g)"""
_SAME = f"{_W}, t AS (SELECT run, count(DISTINCT file) AS files FROM w GROUP BY 1), s AS (SELECT w.run, key, count(*) = any_value(files) AND count(DISTINCT coalesce(value, '')) = 1 AS same FROM w JOIN t USING (run) GROUP BY 1, 2)"
_WORDS = "|".join(IDENTIFYING)
_LEAF = "regexp_replace(split_part(key, '/', -1), '\\[[0-9]+\\]$', '')"
_PRE = "list_transform(range(1, len(string_split(key, '/'))), lambda i: array_to_string(string_split(key, '/')[1:i], '/'))"

SQL = {
    "joi07_key_union": f"WITH {_W} SELECT run, key, count(*) AS n_files FROM w GROUP BY 1, 2",
    "joi07_two_files": f"WITH {_W}, a AS (SELECT key, value FROM w WHERE file = (SELECT min(file) FROM w)), b AS (SELECT key, value FROM w WHERE file = (SELECT max(file) FROM w)) SELECT coalesce(a.key, b.key) AS key, a.value AS a, b.value AS b FROM a FULL JOIN b ON a.key = b.key",
    "joi08_leaks": f"WITH {_W}, a AS (SELECT file, keyword FROM w JOIN tag_dictionary d ON key = d.tag_key WHERE coalesce(value, '') = ''), b AS (SELECT file, keyword, value FROM w JOIN tag_dictionary d ON key = keyword WHERE value <> '') SELECT file, keyword, value FROM a JOIN b USING (file, keyword)",
    "prj07_alias": f"WITH {_W}, k AS (SELECT DISTINCT key, {_LEAF} AS leaf FROM w) SELECT key, coalesce(alias, leaf) AS alias FROM k LEFT JOIN tag_dictionary d ON upper(leaf) = upper(d.tag_key)",
    "prj08_display": f"WITH {_W} SELECT DISTINCT key, CAST(len(string_split(key, '/')) - 1 AS BIGINT) AS depth, split_part(key, '/', -1) AS leaf, replace(key, '/', ' / ') AS label FROM w",
    "joi09_keywords": f"WITH {_W}, k AS (SELECT DISTINCT key FROM w) SELECT key, coalesce(CASE WHEN regexp_full_match(upper(key), '[0-9A-F]{{4}},[0-9A-F]{{4}}') THEN upper(key) END, d.tag_key, 'unknown') AS tag FROM k LEFT JOIN tag_dictionary d ON key = keyword",
    "flt01_contains": f"WITH {_W} SELECT DISTINCT key FROM w WHERE contains(lower(key), 'patient') OR contains(lower(value), 'patient')",
    "flt02_identifiable": f"""WITH {_W}, p AS (SELECT DISTINCT key, regexp_replace(unnest(string_split(key, '/')), '\\[[0-9]+\\]$', '') AS leaf FROM w)
SELECT key FROM w WHERE contains(coalesce(value, ''), '@') OR length(regexp_replace(coalesce(value, ''), '[^0-9]', '', 'g')) >= 8
UNION SELECT key FROM p LEFT JOIN tag_dictionary d ON upper(leaf) = upper(d.tag_key) WHERE regexp_matches(key, '(?i){_WORDS}') OR regexp_matches(coalesce(alias, leaf), '(?i){_WORDS}')""",
    "agg10_all_equal": f"WITH {_SAME} SELECT run, key, same FROM s",
    "flt03_differences": f"WITH {_SAME} SELECT run, key FROM s WHERE NOT same",
    "agg17_common_ends": f"WITH {_ENDS} SELECT run, key, prefix, suffix FROM e",
    "str14_difference_markup": f"WITH {_ENDS} SELECT w.key, file, CASE WHEN length(prefix) + length(suffix) >= length(value) THEN value ELSE prefix || '[[' || substr(value, length(prefix) + 1, length(value) - length(prefix) - length(suffix)) || ']]' || suffix END AS marked FROM w JOIN e ON w.run = e.run AND w.key = e.key WHERE value <> ''",
    "str05_truncate": "SELECT file_path, CASE WHEN length(tag_value) > 5 THEN substr(tag_value, 1, 5) || '...' ELSE tag_value END AS short FROM comps WHERE tag_value IS NOT NULL",
    "str17_prefixes": f"WITH {_W}, k AS (SELECT DISTINCT key FROM w) SELECT key, unnest({_PRE}) AS ancestor FROM k",
    "joi15_tree": f"WITH {_W}, k AS (SELECT DISTINCT key FROM w), n AS (SELECT key AS node FROM k UNION SELECT unnest({_PRE}) FROM k) SELECT node, node IN (SELECT key FROM k) AS has_value, CAST(len(string_split(node, '/')) - 1 AS BIGINT) AS depth FROM n",
    "flt18_visible": f"WITH {_W}, k AS (SELECT DISTINCT key FROM w) SELECT key FROM k WHERE len(list_filter({_PRE}, lambda a: NOT regexp_matches(a, '\\[[0-9]*[02468]\\]$'))) = 0",
    "set01_keys": f"WITH {_W} SELECT key FROM w UNION SELECT tag_key FROM tag_dictionary",
    "map02_key_union": f"WITH {_W} SELECT file, count(*) AS n, max(CASE WHEN key = '0008,0060' THEN coalesce(value, '') END) AS modality FROM w GROUP BY 1",
    "srt06_sorted_keys": f"WITH {_W} SELECT DISTINCT key FROM w ORDER BY 1",
}
QUERIES = {name: globals()[name] for name in SQL}
