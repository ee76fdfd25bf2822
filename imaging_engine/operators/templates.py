"""Report templates: matching, filters, includes, rendering, suggestions, study lists.

The templates of the queries are made of the parts (title, codes, modalities and a body with variables and includes), the studies of the
examinations. Studies that are active at once are a short list that the caller gives, so they are literals and need no join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from imaging_engine.functions.text import normalized, words
from imaging_engine.shared import table

#: Includes are followed so many levels deep; what lies deeper is empty.
DEPTH = 8
SUGGESTIONS, FARTHEST, LENGTHS = 8, 4, 3
ACTIVE = ("SMALL", "Brand#2", "steel", "T17", "PROMO")


def templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, title, codes, modalities, body, brand): each third one includes its successor, by id or by title."""
    k = F.col("p_partkey")
    body = F.concat(
        F.lit("Part {{name}} by {{ brand | none }}"), F.when(k % 2 == 0, F.lit(", {{size|n/a}}{{unknown}}")).otherwise(F.lit("")),
        F.when(k % 3 == 0, F.concat(F.lit(". {{> T"), (k + 1).cast("string"), F.lit(" }}"))).otherwise(F.lit(".")),
    )
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("T"), k.cast("string")).alias("id"), k.alias("ord"), F.when(k % 5 != 0, F.col("p_name")).alias("title"), F.when(k % 4 == 0, F.array().cast("array<string>")).otherwise(F.array("p_brand")).alias("codes"),
        F.split("p_type", " ").alias("modalities"), body.alias("body"), F.when(k % 7 != 0, F.col("p_brand")).alias("brand"),
    )


def lowered(a: Column) -> Column:
    return F.transform(a, lambda x: F.lower(x))


def display_title(title: Column, id_: Column, body: Column) -> Column:
    return F.coalesce(title, id_, F.substring_index(body, "\n", 1), F.lit("(template)"))


def matches(codes: Column, modalities: Column, study_codes: list[str], modality: str | None) -> Column:
    """The modality, where both sides have one; then no codes at all, or one in common."""
    ok = F.lit(True)
    if modality is not None:
        ok = (F.size(modalities) == 0) | F.array_contains(lowered(modalities), modality.lower())
    return ok & ((F.size(codes) == 0) | F.arrays_overlap(lowered(codes), F.array(*[F.lit(c.lower()) for c in study_codes])))


def in_context(title: Column, id_: Column, codes: Column, modalities: Column, studies: tuple[str, ...]) -> Column:
    """One of the studies is part of title or id, or it and a code or modality are part of one another; no studies: all match."""
    if not studies:
        return F.lit(True)
    q = F.array(*[F.lit(s.lower()) for s in studies if s])
    near = lambda a: F.exists(q, lambda s: F.exists(lowered(a), lambda c: F.contains(c, s) | F.contains(s, c)))
    return F.exists(q, lambda s: F.contains(F.lower(title), s) | F.contains(F.lower(id_), s)) | near(codes) | near(modalities)


def flt08_template_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates(spark, sf_dir).where(matches(F.col("codes"), F.col("modalities"), ["brand#11", "BRAND#23"], "steel")).select("id")


def visible(rows: DataFrame, codes: str, search: str, studies: tuple[str, ...], strict: bool = False) -> DataFrame:
    """Templates by a comma list of codes, a text in title or body, and the studies. strict: those without codes don't match a list (as an editor has it)."""
    wanted = [c.strip().lower() for c in codes.split(",") if c.strip()]
    title = display_title(F.col("title"), F.col("id"), F.col("body"))
    if wanted:
        common = F.arrays_overlap(lowered(F.col("codes")), F.array(*map(F.lit, wanted)))
        rows = rows.where(common if strict else common | (F.size("codes") == 0))
    if search:
        found = F.lower(title).contains(search.lower()) | F.lower("body").contains(search.lower())
        rows = rows.where(found | F.lower("id").contains(search.lower()) if strict else found)
    return rows.where(in_context(title, F.col("id"), F.col("codes"), F.col("modalities"), studies))


def flt09_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visible(templates(spark, sf_dir), "Brand#11, brand#32,,", "a", ACTIVE).select("id")


def flt10_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visible(templates(spark, sf_dir), "", "", ACTIVE).select("id")


def flt11_editor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visible(templates(spark, sf_dir), "Brand#11, brand#32", "t1", (), strict=True).select("id")


def joi11_template_studies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which active study matches which template: the studies are exploded from the literal list, and each row keeps those that match."""
    t = templates(spark, sf_dir).withColumn("shown", display_title(F.col("title"), F.col("id"), F.col("body")))
    s = F.lower("study")
    near = lambda a: F.exists(lowered(F.col(a)), lambda c: F.contains(c, s) | F.contains(s, c))
    rows = t.withColumn("study", F.explode(F.array(*map(F.lit, ACTIVE))))
    return rows.where(F.lower("shown").contains(s) | F.lower("id").contains(s) | near("codes") | near("modalities")).select("id", "study")


def joi12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templates and suppliers' codes in common, in any letter case."""
    a = templates(spark, sf_dir).select("id", F.explode(lowered(F.col("codes"))).alias("code"))
    b = table(spark, sf_dir, "supplier").select(F.concat(F.lit("BRAND#"), (F.col("s_suppkey") % 60).cast("string")).alias("c")).select(F.lower("c").alias("code")).distinct()
    return a.join(b, "code").select("id", "code").distinct()


_PIECE = r"\{\{\s*([^}]*)\}?\}?"


def pieces(body: Column) -> Column:
    """A body as (literal, expression) pairs in order: the literal text before each {{ }}, the last with a null expression."""
    found = F.regexp_extract_all(body, F.lit(_PIECE), F.lit(1))
    texts = F.split(body, _PIECE)
    return F.transform(texts, lambda t, i: F.struct(t.alias("literal"), F.trim(F.try_element_at(found, i + 1)).alias("expr")))


def include_names(rows: DataFrame) -> DataFrame:
    """(name, id): a template's names in lower case; of several with one name the first in order counts."""
    n = rows.select("id", "ord", F.explode(F.array_compact(F.array(F.lower("id"), F.lower("title")))).alias("name"))
    return n.groupBy("name").agg(F.min_by("id", "ord").alias("id"))


def expanded(rows: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(root, place, literal, expr) of each template with its includes in place, level by level: a fixed number of joins, no recursion."""
    own = rows.select("id", F.posexplode(pieces(F.col("body"))).alias("n", "p")).select("id", "n", "p.literal", "p.expr")
    names = include_names(rows)
    level = own.select(F.col("id").alias("root"), F.array("n").alias("place"), "literal", "expr")
    done = None
    for _ in range(depth + 1):
        is_include = F.coalesce(F.col("expr").startswith(">"), F.lit(False))
        plain = level.where(~is_include)
        inc = level.where(is_include)
        here = plain.unionByName(inc.withColumn("expr", F.lit(None).cast("string")))  # the literal before an include stays
        done = here if done is None else done.unionByName(here)
        named = inc.select("root", "place", F.lower(F.trim(F.regexp_replace("expr", "^>", ""))).alias("name")).join(names, "name").select("root", "place", "id")
        level = named.join(own, "id").select("root", F.concat("place", F.array("n")).alias("place"), "literal", "expr")
    return done


def rendered(rows: DataFrame, values: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(id, text): variables of (id, vars) put in, else their defaults, else nothing."""
    e = expanded(rows, depth).join(values.select(F.col("id").alias("root"), "vars"), "root")
    name, default = F.trim(F.substring_index("expr", "|", 1)), F.trim(F.when(F.col("expr").contains("|"), F.substring(F.col("expr"), F.position(F.lit("|"), F.col("expr")) + 1, F.length("expr"))))
    text = F.concat("literal", F.coalesce(F.try_element_at("vars", name), default, F.lit("")))
    parts = F.array_sort(F.collect_list(F.struct("place", text.alias("text"))))
    return e.groupBy(F.col("root").alias("id")).agg(F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text"))


def _vars() -> Column:
    """A template's variables: globals only where missing, the user's over the template's defaults."""
    user = F.map_filter(F.create_map(F.lit("brand"), F.col("brand")), lambda k, v: v.isNotNull())
    return precedence(F.create_map(F.lit("name"), F.lit("global"), F.lit("size"), F.lit("large")), F.create_map(F.lit("name"), F.coalesce("title", F.lit("untitled"))), user)


def precedence(globals_: Column, defaults: Column, user: Column) -> Column:
    """One map: the user's values, else the template's, else the globals."""
    under = lambda low, high: F.map_concat(F.map_filter(low, lambda k, v: ~F.map_contains_key(high, k)), high)
    return under(globals_, under(defaults, user))


def str09_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = templates(spark, sf_dir)
    return rendered(t, t.select("id", _vars().alias("vars")), depth=1)


def str10_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vars()
    return templates(spark, sf_dir).select("id", *[F.try_element_at(v, F.lit(k)).alias(k) for k in ("name", "brand", "size")])


def joi13_includes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(root, id, depth): what each template includes, directly or not; here orders include their successor within ten."""
    t = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("root"), F.when(F.col("p_partkey") % 10 != 9, F.col("p_partkey") + 1).alias("next"))
    step, out = t.where("next IS NOT NULL").select("root", F.col("next").alias("id"), F.lit(1).alias("depth")), None
    for k in range(1, DEPTH + 1):
        out = step if out is None else out.unionByName(step)
        if k < DEPTH:
            nxt = t.where("next IS NOT NULL").select(F.col("root").alias("r"), F.col("next").alias("n"))
            step = step.join(nxt, F.col("id") == F.col("r")).select("root", F.col("n").alias("id"), F.lit(k + 1).alias("depth"))
    there = t.select(F.col("root").alias("id"))
    return out.join(there, "id", "left_semi").select("root", "id", "depth")


def agg19_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All variables that the templates' bodies name, includes left out."""
    found = F.explode(F.regexp_extract_all("body", F.lit(r"\{\{([^}]*)\}\}"), F.lit(1))).alias("e")
    name = F.regexp_replace(F.trim(F.substring_index("e", "|", 1)), r"[^A-Za-z0-9_\-]", "")
    rows = templates(spark, sf_dir).select(found).where(~F.ltrim("e").startswith(">")).select(name.alias("name")).where("name <> ''")
    return rows.distinct()


def dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The known words: those of the held-out items, in lower case."""
    return table(spark, sf_dir, "eval_items").select(F.explode(words(F.lower("text"))).alias("word")).distinct()


def misspelt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(word, n): words of the reports that the dictionary doesn't have, in lower case."""
    w = table(spark, sf_dir, "report_buffers").select(F.explode(words(F.lower("report"))).alias("word"))
    return w.groupBy("word").agg(F.count(F.lit(1)).alias("n")).join(dictionary(spark, sf_dir), "word", "left_anti")


def agg20_misspelt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return misspelt(spark, sf_dir)


def snk09_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dictionary with the misspelt words added, in order."""
    return dictionary(spark, sf_dir).union(misspelt(spark, sf_dir).select("word")).distinct().orderBy("word")


def src17_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary(spark, sf_dir)


def near_words(wrong: DataFrame, known: DataFrame, farthest: int = FARTHEST, lengths: int = LENGTHS) -> DataFrame:
    """(word, known, distance) of all pairs within the distance, without a cross join.

    A known word is cut into farthest + 1 parts; within the distance one part stands in the other word unchanged, moved by no more than the
    distance. So parts and the other word's pieces of their lengths and places are joined. A known word shorter than its parts is posted by length.
    """
    parts = farthest + 1
    n = F.length("known")
    cut = lambda i: F.floor(n * i / parts).cast("int")
    keys = F.array(*[F.struct(n.alias("n"), F.lit(i).alias("i"), F.when(n < parts, F.lit("")).otherwise(F.substring(F.col("known"), cut(i) + 1, cut(i + 1) - cut(i))).alias("part")) for i in range(parts)])
    posted = known.select(F.col("word").alias("known")).select("known", F.explode(keys).alias("k")).where((F.col("k.part") != "") | (F.col("k.i") == 0))
    m = F.length("word")
    probes = wrong.select("word", F.explode(F.sequence(F.greatest(m - lengths, F.lit(1)), m + lengths)).alias("n")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(farthest))))
    start, end = F.floor(F.col("n") * F.col("i") / parts).cast("int"), F.floor(F.col("n") * (F.col("i") + 1) / parts).cast("int")
    probes = probes.withColumn("s", F.explode(F.when(F.col("n") < parts, F.array(F.lit(0))).otherwise(F.sequence(F.greatest(start - farthest, F.lit(0)), F.greatest(start + farthest, F.lit(0))))))
    piece = F.when(F.col("n") < parts, F.lit("")).otherwise(F.substring(F.col("word"), F.col("s") + 1, end - start))
    probes = probes.select("word", F.struct("n", "i", piece.alias("part")).alias("k")).where((F.col("k.part") != "") | (F.col("k.n") < parts)).distinct()
    pairs = probes.join(posted, "k").select("word", "known").distinct()
    return pairs.withColumn("distance", F.levenshtein("word", "known")).where(F.col("distance") <= farthest)


def top01_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight nearest known words of each misspelt one, at most four steps away and at most three letters longer or shorter."""
    near = near_words(misspelt(spark, sf_dir).select("word"), dictionary(spark, sf_dir))
    w = Window.partitionBy("word").orderBy("distance", "known")
    return near.withColumn("n", F.row_number().over(w).cast("bigint")).where(F.col("n") <= SUGGESTIONS).select("word", "known", "distance", "n")


def top02_quick_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten visible templates have a key; the tenth has 0 (the ten keys are the feature)."""
    rows = visible(templates(spark, sf_dir), "", "", ACTIVE).orderBy("ord").limit(10)
    return rows.withColumn("n", F.row_number().over(Window.orderBy("ord"))).select("id", (F.col("n") % 10).cast("bigint").alias("key"))


def top03_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 300 elements of each file's metadata list (a list's length is the feature)."""
    from imaging_engine.functions.deid import elements

    w = Window.partitionBy("file").orderBy("grp", "elem")
    rows = elements(spark, sf_dir).where("grp IN (8, 16, 32, 40)").withColumn("n", F.row_number().over(w)).where("n <= 300")
    return rows.select("file", "n", F.concat("tag", F.lit(": "), "value").alias("line"))


def _studies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "series_info").where("examination IS NOT NULL").select("row_id", "scan_id", normalized(F.col("examination")).alias("study")).where("study <> ''")


def set02_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manual studies of each scan (with repeats), then the others not among them in any letter case, each once."""
    s = _studies(spark, sf_dir)
    manual, other = s.where("row_id % 5 = 0"), s.where("row_id % 5 <> 0")
    firsts = other.groupBy("scan_id", F.lower("study").alias("l")).agg(F.min("row_id").alias("row_id"))
    unseen = firsts.join(manual.select("scan_id", F.lower("study").alias("l")), ["scan_id", "l"], "left_anti")
    return manual.select("scan_id", "row_id", "study").unionByName(other.join(unseen.select("row_id"), "row_id", "left_semi").select("scan_id", "row_id", "study"))


def set03_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _studies(spark, sf_dir)
    return s.groupBy("scan_id", F.lower("study").alias("l")).agg(F.min_by("study", "row_id").alias("study")).select("scan_id", "study")


def set04_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _studies(spark, sf_dir)
    return s.where("scan_id = 1").select("study").subtract(s.where("scan_id = 2").select("study"))


def set05_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _studies(spark, sf_dir)
    return s.where("scan_id = 1").select("study").intersect(s.where("scan_id = 2").select("study"))


_T = """t AS (SELECT 'T' || p_partkey AS id, p_partkey AS ord, CASE WHEN p_partkey % 5 <> 0 THEN p_name END AS title, CASE WHEN p_partkey % 4 = 0 THEN []::VARCHAR[] ELSE [p_brand] END AS codes, string_split(p_type, ' ') AS modalities,
 'Part {{name}} by {{ brand | none }}' || CASE WHEN p_partkey % 2 = 0 THEN ', {{size|n/a}}{{unknown}}' ELSE '' END || CASE WHEN p_partkey % 3 = 0 THEN '. {{> T' || (p_partkey + 1) || ' }}' ELSE '.' END AS body,
 CASE WHEN p_partkey % 7 <> 0 THEN p_brand END AS brand FROM part)"""
_LOW = "list_transform({0}, lambda x: lower(x))"
_ACT = "[" + ", ".join(f"'{a.lower()}'" for a in ACTIVE) + "]"
_SHOWN = "lower(coalesce(title, id))"
_CTX = f"len(list_filter({_ACT}, lambda s: contains({_SHOWN}, s) OR contains(lower(id), s) OR len(list_filter(list_concat({_LOW.format('codes')}, {_LOW.format('modalities')}), lambda c: contains(c, s) OR contains(s, c))) > 0)) > 0"
_ST = f"s AS (SELECT * FROM (SELECT row_id, scan_id, regexp_replace(regexp_replace(examination, '{r'[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+'}', ' ', 'g'), '^ | $', '', 'g') AS study FROM series_info WHERE examination IS NOT NULL) WHERE study <> '')"
_DIC = "d AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[A-Za-z'']{2,}')) AS word FROM eval_items), m AS (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(report), '[A-Za-z'']{2,}')) AS word FROM report_buffers) WHERE word NOT IN (SELECT word FROM d) GROUP BY 1)"

SQL = {
    "flt08_template_match": f"WITH {_T} SELECT id FROM t WHERE list_contains({_LOW.format('modalities')}, 'steel') AND (len(codes) = 0 OR list_has_any({_LOW.format('codes')}, ['brand#11', 'brand#23']))",
    "flt09_visible": f"WITH {_T} SELECT id FROM t WHERE (len(codes) = 0 OR list_has_any({_LOW.format('codes')}, ['brand#11', 'brand#32'])) AND (contains({_SHOWN}, 'a') OR contains(lower(body), 'a')) AND {_CTX}",
    "flt10_context": f"WITH {_T} SELECT id FROM t WHERE {_CTX}",
    "flt11_editor": f"WITH {_T} SELECT id FROM t WHERE list_has_any({_LOW.format('codes')}, ['brand#11', 'brand#32']) AND (contains({_SHOWN}, 't1') OR contains(lower(body), 't1') OR contains(lower(id), 't1'))",
    "joi11_template_studies": f"WITH {_T}, a AS (SELECT unnest({list(ACTIVE)}) AS study) SELECT id, study FROM t, a WHERE contains({_SHOWN}, lower(study)) OR contains(lower(id), lower(study)) OR len(list_filter(list_concat({_LOW.format('codes')}, {_LOW.format('modalities')}), lambda c: contains(c, lower(study)) OR contains(lower(study), c))) > 0",
    "joi12_codes": f"WITH {_T}, a AS (SELECT id, lower(unnest(codes)) AS code FROM t), b AS (SELECT DISTINCT 'brand#' || (s_suppkey % 60) AS code FROM supplier) SELECT DISTINCT id, code FROM a JOIN b USING (code)",
    "str09_render": f"""WITH {_T}, p AS (SELECT ord, 'Part ' || coalesce(title, 'untitled') || ' by ' || coalesce(brand, 'none') || CASE WHEN ord % 2 = 0 THEN ', large' ELSE '' END AS x,
  id FROM t) SELECT a.id, CASE WHEN a.ord % 3 <> 0 THEN a.x || '.' ELSE a.x || '. ' || CASE WHEN b.ord IS NULL THEN '' ELSE replace(replace('Part ' || chr(1) || ' by ' || chr(2), chr(1), coalesce(t.title, 'untitled')), chr(2), coalesce(t.brand, 'none')) || CASE WHEN b.ord % 2 = 0 THEN ', large' ELSE '' END || '.' END END AS text
FROM p a LEFT JOIN p b ON b.ord = a.ord + 1 JOIN t ON t.ord = a.ord""",
    "str10_precedence": f"WITH {_T} SELECT id, coalesce(title, 'untitled') AS name, brand, 'large' AS size FROM t",
    "joi13_includes": f"WITH RECURSIVE i AS (SELECT p_partkey AS root, p_partkey + 1 AS id, 1 AS depth FROM part WHERE p_partkey % 10 <> 9 UNION ALL SELECT root, id + 1, depth + 1 FROM i WHERE id % 10 <> 9 AND depth < {DEPTH} AND id IN (SELECT p_partkey FROM part)) SELECT root, id, depth FROM i WHERE id IN (SELECT p_partkey FROM part)",
    "agg19_variables": f"WITH {_T}, e AS (SELECT unnest(regexp_extract_all(body, '\\{{\\{{([^}}]*)\\}}\\}}', 1)) AS e FROM t) SELECT DISTINCT regexp_replace(trim(split_part(e, '|', 1)), '[^A-Za-z0-9_\\-]', '', 'g') AS name FROM e WHERE NOT starts_with(ltrim(e), '>')",
    "agg20_misspelt": f"WITH {_DIC} SELECT word, n FROM m",
    "snk09_dictionary": f"WITH {_DIC} SELECT word FROM d UNION SELECT word FROM m ORDER BY 1",
    "src17_words": f"WITH {_DIC} SELECT word FROM d",
    "top01_suggestions": f"WITH {_DIC}, p AS (SELECT m.word, d.word AS known, levenshtein(m.word, d.word) AS distance FROM m JOIN d ON abs(length(m.word) - length(d.word)) <= {LENGTHS}) SELECT word, known, CAST(distance AS INTEGER) AS distance, row_number() OVER (PARTITION BY word ORDER BY distance, known) AS n FROM p WHERE distance <= {FARTHEST} QUALIFY n <= {SUGGESTIONS}",
    "top02_quick_insert": f"WITH {_T} SELECT id, row_number() OVER (ORDER BY ord) % 10 AS key FROM t WHERE {_CTX} ORDER BY ord LIMIT 10",
    "set02_merged": f"WITH {_ST}, o AS (SELECT * FROM s WHERE row_id % 5 <> 0 QUALIFY row_number() OVER (PARTITION BY scan_id, lower(study) ORDER BY row_id) = 1) SELECT scan_id, row_id, study FROM s WHERE row_id % 5 = 0 UNION ALL SELECT scan_id, row_id, study FROM o WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.row_id % 5 = 0 AND s.scan_id = o.scan_id AND lower(s.study) = lower(o.study))",
    "set03_distinct": f"WITH {_ST} SELECT scan_id, study FROM s QUALIFY row_number() OVER (PARTITION BY scan_id, lower(study) ORDER BY row_id) = 1",
    "set04_except": f"WITH {_ST} SELECT study FROM s WHERE scan_id = 1 EXCEPT SELECT study FROM s WHERE scan_id = 2",
    "set05_intersect": f"WITH {_ST} SELECT study FROM s WHERE scan_id = 1 INTERSECT SELECT study FROM s WHERE scan_id = 2",
}
QUERIES = {name: globals()[name] for name in SQL} | {"top03_lines": top03_lines}
