"""Problem 3: entity, attribute, value rows as one typed row per entity.

The attributes are discovered first, then one conditional aggregation per attribute takes the latest value, in one shuffle.
Defined cases: the row with the latest time decides, a null time is the earliest, of one moment the greater text; a null or blank
text is an absent value; an attribute that does not occur is a null column of its type; an entity whose attributes are all unknown has a
row of nulls; a null entity is an entity; an empty table gives no rows; columns that are not named are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from imaging_engine.shared import strip, table

#: More attributes than this are not a table any more: the caller must choose.
MOST_ATTRIBUTES = 2_000


@dataclass(frozen=True)
class Attribute:
    key: str
    name: str
    col_type: str
    occurs: bool


def typed(text: Column, col_type: str) -> Column:
    """The stripped text as a value of the type; null if it is not of the type."""
    if col_type == "bigint":
        return F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("bigint"))
    if col_type == "double":
        return F.when(text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), text.try_cast("double"))
    if col_type == "date":
        parts = r"^([0-9]{4})(-?)([0-9]{2})\2([0-9]{2})$|^([0-9]{4})\.([0-9]{2})\.([0-9]{2})$"
        iso = F.regexp_replace(text, parts, "$1$5-$3$6-$4$7")
        return F.when(text.rlike(parts) & ~text.startswith("0000"), iso.try_cast("date"))
    return text


def discover(keys: DataFrame, dictionary: DataFrame) -> list[Attribute]:
    """The dictionary's attributes in the order of their keys, with whether they occur among the (distinct) keys. Bounded by MOST_ATTRIBUTES."""
    there = keys.select("tag_key").distinct().withColumn("occurs", F.lit(True))
    rows = dictionary.join(there, "tag_key", "left").select("tag_key", "keyword", "col_type", F.coalesce("occurs", F.lit(False))).orderBy("tag_key").limit(MOST_ATTRIBUTES + 1).collect()
    if len(rows) > MOST_ATTRIBUTES:
        raise ValueError(f"more than {MOST_ATTRIBUTES} attributes")
    return [Attribute(*r) for r in rows]


def resolved(rows: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Rows with tag_key as the dictionary writes it, null for nested, private and unknown keys. A tag counts in any letter case, with
    or without parentheses and blanks around it; a keyword as written, with blanks around it."""
    names = dictionary.select(F.upper("tag_key").alias("__name"), F.col("tag_key").alias("__tag")).union(dictionary.select("keyword", "tag_key"))
    key = strip(F.col("tag_key"))
    bare = F.upper(strip(F.regexp_replace(key, r"^\(|\)$", "")))
    given = F.when(bare.rlike("^[0-9A-F]{4},[0-9A-F]{4}$"), bare).otherwise(key)
    return rows.withColumn("__given", given).join(names.dropDuplicates(["__name"]), F.col("__given") == F.col("__name"), "left").select("file_path", F.col("__tag").alias("tag_key"), "tag_value", "loaded_at")


def pivot_latest(rows: DataFrame, attributes: list[Attribute]) -> DataFrame:
    """(file_path, then for each attribute a column of its name: struct of text and value). One exchange, by file_path."""
    last = {a.name: F.max(F.when(F.col("tag_key") == a.key, F.struct("loaded_at", strip(F.col("tag_value")).alias("text")))).alias(a.name) for a in attributes if a.occurs}
    wide = rows.groupBy("file_path").agg(*last.values()) if last else rows.select("file_path").distinct()

    def cell(a: Attribute) -> Column:
        text = F.col(a.name)["text"] if a.occurs else F.lit(None).cast("string")
        text = F.when(text != "", text)
        return F.struct(text.alias("text"), typed(text, a.col_type).alias("value")).alias(a.name)

    return wide.select("file_path", *map(cell, attributes))


def cells(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[Attribute]]:
    dictionary = table(spark, sf_dir, "tag_dictionary").select("tag_key", "keyword", "col_type").where("tag_key IS NOT NULL")
    rows = resolved(table(spark, sf_dir, "comps").select("file_path", "tag_key", "tag_value", "loaded_at"), dictionary)
    attributes = discover(rows, dictionary)
    return pivot_latest(rows, attributes), attributes


def wide_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per file_path of comps, a typed column named by its keyword for each tag of the dictionary."""
    wide, attributes = cells(spark, sf_dir)
    return wide.select("file_path", *[F.col(a.name)["value"].alias(a.name) for a in attributes])


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of the wide table that are null though there is a text."""
    wide, attributes = cells(spark, sf_dir)
    bad = [F.when(F.col(a.name)["text"].isNotNull() & F.col(a.name)["value"].isNull(), F.lit(a.key)) for a in attributes if a.occurs and a.col_type != "string"]
    if not bad:
        return wide.select("file_path", F.lit("").alias("tag_key")).limit(0)
    return wide.select("file_path", F.explode(F.array_compact(F.array(*bad))).alias("tag_key"))


_LATEST = r"""
k AS (SELECT file_path, trim(tag_key) AS key, tag_value, loaded_at FROM comps),
n AS (SELECT file_path, tag_value, loaded_at, key, upper(trim(regexp_replace(key, '^\(|\)$', '', 'g'))) AS bare FROM k),
r AS (SELECT n.file_path, d.tag_key, d.col_type, d.keyword, trim(n.tag_value) AS text, loaded_at
      FROM n JOIN tag_dictionary d ON CASE WHEN regexp_full_match(bare, '[0-9A-F]{4},[0-9A-F]{4}') THEN bare = upper(d.tag_key) ELSE n.key = d.keyword END),
l AS (SELECT file_path, tag_key, col_type, keyword, text FROM r
      QUALIFY row_number() OVER (PARTITION BY file_path, tag_key ORDER BY loaded_at DESC NULLS LAST, text DESC NULLS LAST) = 1),
c AS (SELECT file_path, tag_key, col_type, keyword, text,
        CASE col_type WHEN 'bigint' THEN regexp_full_match(text, '[+-]?[0-9]+') AND try_cast(text AS BIGINT) IS NOT NULL
          WHEN 'double' THEN regexp_full_match(text, '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?')
          WHEN 'date' THEN (regexp_full_match(text, '[0-9]{8}') OR regexp_full_match(text, '[0-9]{4}-[0-9]{2}-[0-9]{2}') OR regexp_full_match(text, '[0-9]{4}\.[0-9]{2}\.[0-9]{2}'))
            AND try_cast(regexp_replace(replace(replace(text, '-', ''), '.', ''), '^(....)(..)(..)$', '\1-\2-\3') AS DATE) IS NOT NULL
          ELSE true END AS good
      FROM l WHERE text <> '')"""

SQL = {"p3_found": f"WITH {_LATEST} SELECT file_path, tag_key FROM c WHERE NOT good"}
QUERIES = {"p3_found": p3_found, "p3_wide": wide_tags}
