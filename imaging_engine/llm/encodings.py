"""Problem 8: texts that hold a passage decoded with a wrong encoding, by a table of garbled forms.

Every distinct word of the corpus that has a letter or sign beyond ASCII is put through all chains of wrong decoding; the table of its forms
is joined by hash with the distinct words of the documents. A word that is a form of another is garbled if it looks less like a word than
that one does (`oddness`), or is as plain but far rarer; short plain ones need company in their document. The originals are put in
place where one is the only likely one. Loss counts too: chains that leave replacement signs give forms, of which several originals may be likely.

Defined cases: null, empty and ASCII texts are no case; a repeated row gives one row for its doc_id; words are runs of letters and of all
signs beyond ASCII, so NBSP and control signs inside a garbled letter don't part it; East Asian runs are also cut at their
punctuation, clean and garbled; texts are read to their ends.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from imaging_engine.shared import own_folder, table

#: What texts are written in, and what they are taken for.
WRITTEN = ("utf-8", "cp1252", "cp1250", "iso8859-2", "cp1251", "koi8-r", "iso8859-5", "cp866", "mac-roman", "mac-cyrillic", "cp437", "cp850", "cp852", "cp932", "euc-jp")
READ = ("cp1252", "latin-1", "cp1250", "iso8859-2", "iso8859-15", "cp1254", "cp1251", "koi8-r", "iso8859-5", "cp866", "mac-roman", "mac-cyrillic", "cp437", "cp850", "cp852", "cp932", "euc-jp", "gbk", "utf-8", "ascii")
#: UTF-8 misread twice or three times, as it happens where a text passes through several programs.
AGAIN = ("cp1252", "latin-1", "cp1250", "cp1251", "mac-roman", "cp437", "cp850", "koi8-r", "cp866")
MULTIBYTE = ("cp932", "euc-jp", "gbk", "utf-8", "ascii")
_WORDS = r"[A-Za-z\x{80}-\x{10FFFF}]+"
#: A word of ASCII letters and up to four other signs after a space: the context of signs that are words of their own.
_SIGNS = r"(?<![A-Za-z\x{80}-\x{10FFFF}])([A-Za-z]{1,40} [\x{80}-\x{10FFFF}]{1,4})(?=\s)"
_WORD = re.compile("[A-Za-z\x80-\U0010ffff]+")
_EAST = "。、・：；（）「」『』！？〜"
_EAST_CUT = re.compile(f"[{_EAST}]+")
SALTS = 8
#: A plain form is garbled if its original occurs in so many times as many documents.
RARER = 5


@cache
def _byte_table(codec: str, undefined: str) -> str:
    """The 256 signs of a codec; undefined bytes as control signs (c1), as the replacement sign, or marked to be dropped."""
    out = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(codec))
        except UnicodeDecodeError:
            out.append({"c1": chr(b), "replace": "�", "ignore": "￿"}[undefined])
    return "".join(out)


def misread(data: bytes, codec: str) -> set[str]:
    """What a reader makes of the bytes, in each way of dealing with bytes that the codec doesn't have."""
    if codec in MULTIBYTE:
        return {data.decode(codec, "replace")}
    first = data.decode("latin-1").translate(_byte_table(codec, "c1"))
    ways = {first}
    for undefined in ("replace", "ignore"):
        t = data.decode("latin-1").translate(_byte_table(codec, undefined)).replace("￿", "")
        ways.add(t)
    return ways


def forms(word: str) -> set[str]:
    """All garbled forms of a word."""
    found: set[str] = set()
    once: set[str] = set()
    for written in WRITTEN:
        try:
            data = word.encode(written)
        except UnicodeEncodeError:
            continue
        for read in READ:
            if read == written or (read == "ascii" and written != "utf-8"):
                continue
            ways = misread(data, read)
            found |= ways
            if written == "utf-8" and read in AGAIN:
                once |= {w for w in ways if "�" not in w}
    twice: set[str] = set()
    for w in once:
        data = w.encode()
        for read in AGAIN:
            twice |= misread(data, read)
        if "cp1252" in AGAIN:
            twice |= {x for t in misread(data, "cp1252") for x in misread(t.encode(), "cp1252")}
    found |= twice
    found.discard(word)
    return {f for f in found if f and not f.isascii()}


def _script(c: str) -> str:
    o = ord(c)
    if o < 0x250:
        return "latin"
    if 0x370 <= o < 0x400:
        return "greek"
    if 0x400 <= o < 0x530:
        return "cyrillic"
    if 0x3040 <= o < 0x30FF or 0x4E00 <= o < 0xA000 or o == 0x30FC:
        return "east"
    return "other"


def oddness(word: str) -> int:
    """How little a run looks like a word: control and replacement signs, signs against letters, mixed scripts, turned letter case, accents in a row."""
    odd, scripts, accents = 0, set(), 0
    kinds = [unicodedata.category(c) for c in word]
    for k, (c, kind) in enumerate(zip(word, kinds)):
        o = ord(c)
        letter = kind[0] == "L" and c not in "ªº"
        if o < 0x80:
            accents = 0
            if c != " " and " " not in word:
                scripts.add("latin")
            continue
        if 0x80 <= o < 0xA0 or c == "�" or kind in ("Co", "Cn"):
            odd += 3
        elif letter:
            script = "latin" if c == "µ" else _script(c)
            scripts.add(script)
            accents = accents + 1 if script == "latin" and c != "µ" else 0
            odd += accents > 2
            odd += script == "other"
            before = word[k - 1] if k else ""
            odd += before != "" and before.islower() and c.isupper() and before != "µ"
            after = word[k + 1] if k + 1 < len(word) else ""
            odd += o > 0x7F and c.isupper() and before.islower() and after.islower()
        else:
            accents = 0
            near = [word[j] for j in (k - 1, k + 1) if 0 <= j < len(word)]
            quote = kind in ("Pi", "Pf") or c in "’‘“”„«»…"
            beside = [x for x in near if ord(x) > 0x7F and unicodedata.category(x)[0] in "LSPN"]
            if quote:
                odd += any(unicodedata.category(x)[0] in "SN" or x in "âÂÃÐÑГВвРСт" for x in beside)
            else:
                odd += bool(beside) or (k + 1 < len(word) and word[k + 1].isalpha() and c not in "°")
    return odd + 2 * (len(scripts - {"latin"}) > 0 and len(scripts) > 1)


@cache
def _garbled_cut() -> re.Pattern:
    """The garbled forms of East Asian punctuation, as places to cut a garbled run."""
    marks = {f for c in _EAST for read in ("cp1252", "latin-1", "cp1251", "koi8-r", "mac-roman", "cp437", "cp850", "cp1250", "cp866", "iso8859-15") for f in misread(c.encode(), read)}
    marks |= {f for c in _EAST for written in ("euc-jp",) for read in ("cp1252", "latin-1") for f in misread(c.encode(written), read)}
    return re.compile("|".join(map(re.escape, sorted((m for m in marks if len(m) > 1), key=len, reverse=True))))


def _size(rows: list[tuple[str, str]]) -> int:
    return sum(len(a) + len(b) for a, b in rows)


def _table_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) to (form, original, n) for the words that can be clean."""
    rows: list[tuple[str, str, int]] = []
    size = 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], ["form", "original", "n"])

    for b in batches:
        for word, n in zip(*(c.to_pylist() for c in b.columns)):
            cut = [p for p in _EAST_CUT.split(word) if p] if _EAST_CUT.search(word) else []
            for w in {word, *cut}:
                if w.isascii() or "�" in w or any(0x80 <= ord(c) < 0xA0 for c in w):
                    continue
                for f in forms(w):
                    for piece in {f} if " " in w or _WORD.fullmatch(f) else {p for p in _WORD.findall(f) if len(p) > 3 and sum(ord(c) > 0x7F for c in p) > 1}:
                        rows.append((piece, w, n))
                        size += len(piece) + len(w)
            if size > 4_000_000:
                yield batch()
                rows, size = [], 0
    yield batch()


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) to (piece, word, n): the word itself, and what lies between garbled East Asian punctuation."""
    for b in batches:
        rows = []
        for word, n in zip(*(c.to_pylist() for c in b.columns)):
            pieces = {word}
            if len(word) > 6:
                pieces |= {p for p in _garbled_cut().split(word) if len(p) > 3 and not p.isascii()}
            rows += [(p, word, n) for p in pieces]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], ["piece", "word", "n"])


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(piece, word, n, original, times) to (word, piece, original, times, odd, strong) of the pairs in which the piece is the garbled one."""
    known: dict[str, int] = {}

    def odd(w: str) -> int:
        if w not in known:
            if len(known) > 200_000:
                known.clear()
            known[w] = oddness(w)
        return known[w]

    for b in batches:
        out = []
        for piece, word, n, original, times in zip(*(c.to_pylist() for c in b.columns)):
            a, o = odd(piece), odd(original)
            letters = sum(c.isalpha() for c in piece)
            if n > times + 2:
                continue  # wrong decoding is the exception: a garbled form is not what most documents have
            if piece == "�" or (a > o and len(piece) > 1 and " " not in piece):
                out.append((word, piece, original, times, o, True))
            elif a >= o and times >= RARER * n and letters > 1:
                out.append((word, piece, original, times, o, " " in piece or letters > 3))
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.bool_()))], ["word", "piece", "original", "times", "odd", "strong"]
        )


def document_words(documents: DataFrame) -> DataFrame:
    """(doc_id, word): the distinct words beyond ASCII of each document; signs that stand alone also with the word before them."""
    words = F.regexp_extract_all("text", F.lit(_WORDS), F.lit(0))
    beyond = F.filter(words, lambda w: F.octet_length(w) > F.char_length(w))
    signs = F.regexp_extract_all("text", F.lit(_SIGNS), F.lit(1))
    return documents.where("octet_length(text) > char_length(text)").select("doc_id", F.explode(F.array_distinct(F.concat(beyond, signs))).alias("word"))


def garbled_words(spark: SparkSession, words: DataFrame) -> DataFrame:
    """(word, piece, original, times, odd, strong) of the distinct words (word, n) that are garbled."""
    # the words are few bytes but each makes hundreds of forms: by size alone they would be one task
    tasks = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    words = words.repartition(tasks)
    table_ = words.mapInArrow(_table_rows, "form string, original string, n bigint").groupBy("form", "original").agg(F.max("n").alias("times"))
    pieces = words.mapInArrow(_cut, "piece string, word string, n bigint")
    pairs = pieces.hint("shuffle_hash").join(table_, F.col("piece") == F.col("form")).select("piece", "word", "n", "original", "times")
    return pairs.mapInArrow(_judge, "word string, piece string, original string, times bigint, odd int, strong boolean")


def evidence(spark: SparkSession, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, word, strong) for the garbled words of the documents that are cases, and the garbled words with their originals. Both are written tables."""
    doc_folder, bad_folder = own_folder(spark, "words"), own_folder(spark, "garbled")
    document_words(documents).write.option("compression", "zstd").parquet(doc_folder)
    doc_words = spark.read.parquet(doc_folder)
    garbled_words(spark, doc_words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))).write.parquet(bad_folder)
    pairs = spark.read.parquet(bad_folder)
    bad = pairs.groupBy("word").agg(F.max("strong").alias("strong"))
    # a word may be in a third of all documents: it is spread over SALTS tasks
    salted = bad.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    hits = doc_words.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted, ["word", "salt"]).select("doc_id", "word", "strong")
    return hits, pairs


def _cases(hits: DataFrame) -> DataFrame:
    return hits.groupBy("doc_id").agg(F.max("strong").alias("strong"), F.count_distinct("word").alias("n")).where("strong OR n > 1").select("doc_id")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold a garbled word for sure, or several that are likely."""
    return _cases(evidence(spark, table(spark, sf_dir, "documents").select("doc_id", "text"))[0])


def _restored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, [[word, piece, original]...]) to (doc_id, text, restored, complete)."""
    for b in batches:
        rows = []
        for doc_id, text, known in zip(*(c.to_pylist() for c in b.columns)):
            whole = {k["word"]: k["original"] for k in known if k["original"] is not None and k["word"] == k["piece"]}
            parts: dict[str, list[tuple[str, str]]] = {}
            for k in known:
                if k["original"] is not None and k["word"] != k["piece"]:
                    parts.setdefault(k["word"], []).append((k["piece"], k["original"]))

            def put(m: re.Match, whole=whole, parts=parts) -> str:
                word = m[0]
                if word in whole:
                    return whole[word]
                for piece, original in sorted(parts.get(word, ()), key=lambda x: -len(x[0])):
                    word = word.replace(piece, original)
                return _garbled_cut().sub(_mark, word) if word != m[0] else word

            out = text
            for phrase in (w for w in whole if " " in w):
                out = re.sub(rf"(?<![A-Za-z]){re.escape(phrase)}(?=\s)", lambda m: whole[m[0]], out)
            out = _WORD.sub(put, out)
            rows.append((doc_id, text, out, all(k["original"] is not None for k in known)))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string(), pa.bool_()))], ["doc_id", "text", "restored", "complete"])


@cache
def _marks() -> dict[str, str]:
    return {f: c for c in _EAST for read in READ if read not in MULTIBYTE for f in misread(c.encode(), read)}


def _mark(m: re.Match) -> str:
    return _marks().get(m[0], m[0])


def p8_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, restored, complete) of each case: the text with the originals in place. A garbled word stays where no original looks more
    like a word or is RARER times as frequent than the next one that it may stand for; complete tells that none stayed."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    hits, pairs = evidence(spark, documents)
    likely = F.array_sort(F.collect_set(F.struct("odd", (-F.col("times")).alias("less"), "original")))
    first, second = F.col("likely")[0], F.try_element_at("likely", F.lit(2))
    sure = second.isNull() | (first["odd"] < second["odd"]) | (first["less"] <= RARER * second["less"])
    best = pairs.groupBy("word", "piece").agg(likely.alias("likely")).select("word", "piece", F.when(sure, first["original"]).alias("original"))
    cases = _cases(hits)
    known = hits.join(cases, "doc_id").select("doc_id", "word").join(best, "word").groupBy("doc_id").agg(F.collect_list(F.struct("word", "piece", "original")).alias("known"))
    return documents.join(known, "doc_id").select("doc_id", "text", "known").mapInArrow(_restored, "doc_id bigint, text string, restored string, complete boolean").select("doc_id", "restored", "complete")
