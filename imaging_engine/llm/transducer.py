"""Problem 6: a whole corpus as token ids, by a minimal acyclic transducer of its frequent words.

The frequent pre-tokens of the corpus are counted over all documents; the LEXICON_WORDS most frequent are compiled into a minimal acyclic
automaton in which equal suffixes are one path. Each edge has an additive output (the number of words that sort before it), so that a
word's outputs add up to its ordinal, and the ordinal leads to its ids. The arrays are one file that workers map into memory; a batch's
distinct words walk through it together, a byte at a time. Words that are not in it are merged by rank, exactly: the bound costs time, never ids.

Defined cases: a null and an empty text give an empty list; a blank text is encoded like any other; the strings of special tokens are
ordinary text; a null doc_id is kept; repeated rows are kept; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import heapq
import os
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from imaging_engine.shared import shared_folder, table

#: The public vocabulary (token bytes in base64 and rank, by line) and its published rule of splitting.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Most words in the lexicon, and the longest (in bytes): together they bound what the driver collects.
LEXICON_WORDS = 50_000
LEXICON_BYTES = 48
_SPLIT = regex.compile(PATTERN)
_ARRAYS = (("edge_keys", np.int64), ("targets", np.int32), ("skips", np.int32), ("final", np.uint8), ("id_starts", np.int32), ("ids", np.int32))


def split(text: str) -> list[str]:
    return _SPLIT.findall(text)


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a word by merging the pair of lowest rank, the first one among equals, until none is left. O(n log n) in the word's bytes."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    end = list(range(1, n + 1))  # end of the part that starts here
    before, alive = list(range(-1, n - 1)), [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i] if alive[i] else n
        if j >= n or end[j] != stop:
            continue  # one of the two parts has changed since
        end[i], alive[j] = stop, False
        if stop < n:
            before[stop] = i
            if (r := ranks.get(word[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (k := before[i]) >= 0 and (r := ranks.get(word[k:stop])) is not None:
            heapq.heappush(heap, (r, k, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


class Lexicon:
    """The automaton's arrays. State 0 is the start; an edge's key is state * 256 + byte, and the keys are sorted."""

    def __init__(self, edge_keys, targets, skips, final, id_starts, ids):
        self.edge_keys, self.targets, self.skips, self.final, self.id_starts, self.ids = edge_keys, targets, skips, final, id_starts, ids

    @classmethod
    def compile(cls, words: Iterable[tuple[bytes, list[int]]]) -> Lexicon:
        """Words in ascending order, each once, with their ids. Suffixes are shared as soon as no later word can change them."""
        edges: list[dict[int, int]] = [{}]
        final = [False]
        known: dict[tuple, int] = {}
        path, last, id_starts, ids = [0], b"", [0], []

        def settle(upto: int) -> None:
            for depth in range(len(last), upto, -1):
                state = path.pop()
                same = known.setdefault((final[state], tuple(edges[state].items())), state)
                if same != state:
                    edges[path[-1]][last[depth - 1]] = same

        for word, own in words:
            if word <= last and id_starts[-1]:
                raise ValueError("words must ascend")
            common = len(os.path.commonprefix([word, last]))
            settle(common)
            for byte in word[common:]:
                edges.append({})
                final.append(False)
                edges[path[-1]][byte] = len(edges) - 1
                path.append(len(edges) - 1)
            final[path[-1]] = True
            last = word
            ids += own
            id_starts.append(len(ids))
        settle(0)
        order, number = [0], {0: 0}
        for state in order:
            for to in edges[state].values():
                if to not in number:
                    number[to] = len(order)
                    order.append(to)
        below: dict[int, int] = {}

        def words_below(state: int) -> int:
            stack = [state]
            while stack:
                s = stack[-1]
                open_ = [t for t in edges[s].values() if t not in below]
                if open_:
                    stack += open_
                else:
                    below[s] = final[s] + sum(below[t] for t in edges[s].values())
                    stack.pop()
            return below[state]

        words_below(0)
        keys, targets, skips = [], [], []
        for state in order:
            skip = int(final[state])
            for byte, to in sorted(edges[state].items()):
                keys.append(number[state] * 256 + byte)
                targets.append(number[to])
                skips.append(skip)
                skip += below[to]
        as_ = lambda x, t: np.array(x, t)
        return cls(as_(keys, np.int64), as_(targets, np.int32), as_(skips, np.int32), as_([final[s] for s in order], np.uint8), as_(id_starts, np.int32), as_(ids, np.int32))

    def to_bytes(self) -> bytes:
        parts = [np.ascontiguousarray(getattr(self, name), kind) for name, kind in _ARRAYS]
        return np.array([len(p) for p in parts], np.int64).tobytes() + b"".join(p.tobytes() + bytes(-p.nbytes % 8) for p in parts)

    @classmethod
    def mapped(cls, path: str) -> Lexicon:
        """The arrays as they lie in the file; pages are read when they are touched and shared by all workers of a machine."""
        whole = np.memmap(path, np.uint8, "r")
        at, arrays = 8 * len(_ARRAYS), []
        for (_, kind), n in zip(_ARRAYS, whole[:at].view(np.int64).tolist()):
            size = n * np.dtype(kind).itemsize
            arrays.append(whole[at : at + size].view(kind))
            at += size + -size % 8
        return cls(*arrays)

    def find(self, words: list[bytes]) -> np.ndarray:
        """The ordinal of each word, -1 for those that are not there."""
        found = np.full(len(words), -1, np.int64)
        if not len(self.edge_keys) or not words:
            return found
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer(b"".join(words), np.uint8)
        starts = np.cumsum(lengths) - lengths
        live = np.arange(len(words))
        state, out, depth = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), 0
        while len(live):
            over = lengths[live] == depth
            done = live[over]
            found[done] = np.where(self.final[state[done]] == 1, out[done], -1)
            live = live[~over]
            if not len(live):
                break
            key = state[live] * 256 + flat[starts[live] + depth]
            edge = np.minimum(np.searchsorted(self.edge_keys, key), len(self.edge_keys) - 1)
            there = self.edge_keys[edge] == key
            live, edge = live[there], edge[there]
            state[live] = self.targets[edge]
            out[live] += self.skips[edge]
            depth += 1
        return found


def _ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@cache
def _ranks(path: str) -> dict[bytes, int]:
    return _ranks_of(path)


@cache
def _mapped(path: str) -> Lexicon:
    return Lexicon.mapped(path)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: Counter[str] = Counter()
        for text in batch.column(0).to_pylist():
            counts.update(split(text))
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) over all texts of the one column."""
    return texts.mapInArrow(_count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def encoder(lexicon_file: str, vocabulary_file: str):
    """Encodes Arrow batches of (doc_id, text); the files are those that SparkFiles has by these names."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, ranks = _mapped(SparkFiles.get(lexicon_file)), _ranks(SparkFiles.get(vocabulary_file))
        for batch in batches:
            number: dict[str, int] = {}
            at: list[int] = []
            per_text = []
            for text in batch.column(1).to_pylist():
                words = split(text) if text else []
                at += [number.setdefault(w, len(number)) for w in words]
                per_text.append(len(words))
            distinct = [w.encode() for w in number]
            ordinal = lexicon.find(distinct)
            known = ordinal >= 0
            starts = np.where(known, lexicon.id_starts[ordinal], 0).astype(np.int64)
            lengths = np.where(known, lexicon.id_starts[np.minimum(ordinal + 1, len(lexicon.id_starts) - 1)] - starts, 0).astype(np.int64)
            more, end = [], len(lexicon.ids)
            for i in np.flatnonzero(~known).tolist():
                own = merge(distinct[i], ranks)
                starts[i], lengths[i] = end + len(more), len(own)
                more += own
            pool = np.concatenate([lexicon.ids, np.array(more, np.int32)]) if more else lexicon.ids
            words = np.array(at, np.int64)
            size = lengths[words]
            ends = np.cumsum(size)
            flat = pool[np.repeat(starts[words] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
            word_ends = np.cumsum(np.array(per_text, np.int64))
            offsets = np.concatenate([[0], np.concatenate([[0], ends])[word_ends]]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))], ["doc_id", "ids"])

    return encode


def _ship(spark: SparkSession, data: bytes) -> str:
    """Writes the file to the shared folder, from where each executor fetches it once; gives its name."""
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    path = f"{shared_folder(spark)}/{name}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, False)
    try:
        out.write(data)
    finally:
        out.close()
    spark.sparkContext.addFile(path)
    return name


def token_ids(spark: SparkSession, documents: DataFrame, vocabulary: str = VOCABULARY, lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """(doc_id, ids) of documents (doc_id, text)."""
    ranks = _ranks_of(vocabulary)
    counts = word_counts(documents.select("text").where("text <> ''")).where(F.octet_length("word") <= LEXICON_BYTES)
    # limited by size: what is left out is merged by rank instead
    frequent = counts.orderBy(F.desc("n"), "word").limit(lexicon_words).select("word").collect()
    words = sorted(r.word.encode() for r in frequent)
    lexicon = _ship(spark, Lexicon.compile((w, merge(w, ranks)) for w in words).to_bytes())
    spark.sparkContext.addFile(vocabulary)
    return documents.select("doc_id", "text").mapInArrow(encoder(lexicon, os.path.basename(vocabulary)), "doc_id bigint, ids array<int>")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids(spark, table(spark, sf_dir, "documents"))
