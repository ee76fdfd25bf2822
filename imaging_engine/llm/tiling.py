"""Problem 7: held-out items in corpus documents, by greedy string tiling.

Documents and items become words; seeds are the Karp-Rabin hashes of their windows of min_match words, and a pair that shares a seed is a
candidate. For each candidate the longest unmarked common run is marked again and again until none of min_match words is left; the marked
runs (tiles) don't overlap in either text, so reordered passages add up to a coverage of the item.

Defined cases: words are runs of letters and digits without letter case, accents and markup tags; a null or empty text has none; a text
with fewer words than min_match matches nothing; repeated rows give one row; null ids are ids; texts are read to their ends.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from imaging_engine.shared import own_folder, table

MIN_MATCH = 12
#: Up to so many seeds (8 bytes each) of the items go to all workers as a filter; beyond, the seeds of all documents are shuffled and joined.
FILTER_SEEDS = 2_000_000
SALTS = 16
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INLINE = re.compile(r"</?(?:a|abbr|b|big|code|del|em|font|i|ins|mark|q|s|small|span|strong|sub|sup|tt|u)(?:\s[^<>]*)?/?>", re.I)
_TAG = re.compile(r"<!--.*?-->|</?[a-z!][^<>]*>", re.I | re.S)
_WORD = re.compile(r"[^\W_]+")
_HIDDEN = re.compile("[­​-‍⁠﻿]")


def words(text: str | None) -> list[str]:
    """Runs of letters and digits, without letter case, accents and markup tags; marks that show nothing don't part a word."""
    if not text:
        return []
    if "<" in text:
        text = _TAG.sub(" ", _INLINE.sub("", text))
    text = text.casefold()
    if not text.isascii():
        text = _HIDDEN.sub("", unicodedata.normalize("NFKD", text))
        text = "".join(c for c in text if not unicodedata.combining(c))
    return _WORD.findall(text)


def seeds(tokens: list[str], size: int, known: dict[str, int] | None = None) -> np.ndarray:
    """Karp-Rabin hashes modulo 2**64 of all windows of so many words."""
    n = len(tokens) - size + 1
    if n <= 0:
        return np.empty(0, np.int64)
    known = {} if known is None else known
    for t in tokens:
        if t not in known:
            known[t] = xxhash.xxh64_intdigest(t)
    h = np.fromiter((known[t] for t in tokens), np.uint64, len(tokens))
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out = out * _BASE + h[k : k + n]
    return out.view(np.int64)


def tiles(doc: list[str], item: list[str], min_match: int) -> list[tuple[int, int, int]]:
    """(start in doc, start in item, words) of the tiles: the longest common run of unmarked words first, the first of equals, none under min_match."""
    free_doc, free_item = np.ones(len(doc), bool), np.ones(len(item), bool)
    at: dict[int, list[int]] = {}
    for j, h in enumerate(seeds(item, min_match).tolist()):
        at.setdefault(h, []).append(j)
    hits = [(i, j) for i, h in enumerate(seeds(doc, min_match).tolist()) for j in at.get(h, ())]
    found = []
    while hits:
        runs: list[tuple[int, int, int]] = []
        covered: dict[int, int] = {}  # by diagonal: up to where the document has been extended
        still = []
        for i, j in hits:
            if not (free_doc[i : i + min_match].all() and free_item[j : j + min_match].all()):
                continue
            still.append((i, j))
            if covered.get(i - j, -1) >= i + min_match:
                continue
            n = 0
            while i + n < len(doc) and j + n < len(item) and free_doc[i + n] and free_item[j + n] and doc[i + n] == item[j + n]:
                n += 1
            covered[i - j] = i + n
            if n >= min_match:
                runs.append((-n, i, j))
        if not runs:
            break
        for n, i, j in sorted(runs):
            # a run that an earlier one of this round has cut is looked at again in the next
            if free_doc[i : i - n].all() and free_item[j : j - n].all():
                free_doc[i : i - n] = free_item[j : j - n] = False
                found.append((i, j, -n))
            else:
                break
        hits = still
    return sorted(found)


def _seeded(size: int, wanted: np.ndarray | None):
    """Maps (id, text) to (id, text, seeds); with wanted (sorted), only its seeds, and only texts that have any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            if len(known) > 1_000_000:
                known.clear()
            rows = []
            for key, text in zip(*(c.to_pylist() for c in batch.columns)):
                own = np.unique(seeds(words(text), size, known))
                if wanted is not None and len(own):
                    own = own[wanted[np.minimum(np.searchsorted(wanted, own), len(wanted) - 1)] == own] if len(wanted) else own[:0]
                if len(own):
                    rows.append((key, text, own))
            ends = np.cumsum([0, *(len(r[2]) for r in rows)]).astype(np.int32)
            flat = np.concatenate([r[2] for r in rows]) if rows else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["id", "text", "seeds"])

    return run


def _placed(size: int):
    """Maps (id, text) of items to (seed, item_id, pos, item_words), a row for each window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for key, text in zip(*(c.to_pylist() for c in batch.columns)):
                w = words(text)
                own = seeds(w, size).tolist()
                for c, v in zip(out, (own, [key] * len(own), range(len(own)), [len(w)] * len(own))):
                    c += v
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], ["seed", "item_id", "pos", "item_words"])

    return run


def _tiled(min_match: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: dict[str, list[str]] = {}
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for doc_id, doc, item_id, item in zip(*(c.to_pylist() for c in batch.columns)):
                if item not in items:
                    if len(items) > 10_000:
                        items.clear()
                    items[item] = words(item)
                found = tiles(words(doc), items[item], min_match)
                if found:
                    for c, v in zip(out, (doc_id, item_id, len(found), max(n for *_, n in found), sum(n for *_, n in found), len(items[item]))):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["doc_id", "item_id", "tiles", "longest", "covered", "item_words"])

    return run


def tile_pairs(spark: SparkSession, documents: DataFrame, items: DataFrame, min_match: int = MIN_MATCH, least: float = 0) -> DataFrame:
    """(doc_id, item_id, tiles, longest, covered, item_words) of each document (doc_id, text) and item (item_id, text) that have a tile; with least,
    of those whose tiles cover so much of the item. No tile reaches beyond the item's windows that the document has: pairs in which those
    cover too little are left out before they are tiled."""
    schema = "id bigint, text string, seeds array<bigint>"
    items = items.select(F.col("item_id").cast("bigint").alias("id"), "text").distinct()
    item_seeds = items.mapInArrow(_placed(min_match), "seed bigint, item_id bigint, pos int, item_words int")
    few = item_seeds.limit(FILTER_SEEDS + 1).count() <= FILTER_SEEDS
    wanted = np.sort(np.array([r.seed for r in item_seeds.select("seed").distinct().collect()], np.int64)) if few else None
    # texts without a seed of the items end here, so that what is written is the candidates alone
    noted = own_folder(spark, "seeded")
    documents.select(F.col("doc_id").cast("bigint").alias("id"), "text").mapInArrow(_seeded(min_match, wanted), schema).write.parquet(noted)
    docs = spark.read.schema(schema).parquet(noted)
    doc_seeds = docs.select("id", F.explode("seeds").alias("seed"))
    if few:
        pairs = doc_seeds.join(F.broadcast(item_seeds), "seed")
    else:
        # a seed of boilerplate may be in a third of the documents: it is spread over SALTS tasks
        salted = item_seeds.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        pairs = doc_seeds.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(salted, ["seed", "salt"])
    if least:
        at = F.array_sort(F.collect_set("pos")).alias("at")  # at most the item's windows
        pairs = pairs.groupBy("id", "item_id").agg(at, F.max("item_words").alias("item_words"))
        steps = F.transform("at", lambda p, k: F.least(F.lit(min_match), F.coalesce(F.try_element_at("at", k + 2) - p, F.lit(min_match))))
        pairs = pairs.where(F.aggregate(steps, F.lit(0), lambda s, x: s + x) >= least * F.col("item_words"))
    pairs = pairs.select("id", "item_id").distinct()
    with_docs = pairs.alias("p").join(docs.select("id", "text").distinct().alias("d"), F.expr("p.id <=> d.id"))
    both = with_docs.join(items.alias("i"), F.expr("p.item_id <=> i.id")).select(F.col("p.id"), F.col("d.text"), "p.item_id", F.col("i.text").alias("item"))
    found = both.mapInArrow(_tiled(min_match), "doc_id bigint, item_id bigint, tiles bigint, longest bigint, covered bigint, item_words bigint")
    if least:
        found = found.where(F.col("covered") >= least * F.col("item_words"))
    best = F.max(F.struct("covered", "longest", "tiles", "item_words")).alias("b")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.tiles", "b.longest", "b.covered", "b.item_words")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold at least 12 consecutive words of an item, with the item."""
    return tile_pairs(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def p7_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold at least 0.8 of an item in tiles of five words or more, in any order."""
    return tile_pairs(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), min_match=5, least=0.8)


_SQL_WORDS = r"""regexp_extract_all(strip_accents(lower(regexp_replace(regexp_replace(regexp_replace(text, '</?(a|abbr|b|big|code|del|em|font|i|ins|mark|q|s|small|span|strong|sub|sup|tt|u)(\s[^<>]*)?/?>', '', 'gi'),
  '<!--.*?-->|</?[a-z!][^<>]*>', ' ', 'gis'), '[\x{AD}\x{200B}-\x{200D}\x{2060}\x{FEFF}]', '', 'g'))), '[\p{L}\p{N}]+')"""
P7_SQL = f"""
WITH d AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents), i AS (SELECT item_id, {_SQL_WORDS} AS w FROM eval_items),
dr AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - {MIN_MATCH} + 2), lambda k: array_to_string(w[k:k + {MIN_MATCH} - 1], ' '))) AS run FROM d WHERE len(w) >= {MIN_MATCH}),
ir AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - {MIN_MATCH} + 2), lambda k: array_to_string(w[k:k + {MIN_MATCH} - 1], ' '))) AS run FROM i WHERE len(w) >= {MIN_MATCH})
SELECT DISTINCT doc_id, item_id FROM dr JOIN ir USING (run)"""
