import random

import pytest
import tiktoken

from imaging_engine.llm import transducer as T

DOCS = "doc_id long, text string, ids string"


@pytest.fixture(scope="module")
def ranks():
    return T._ranks_of(T.VOCABULARY)


@pytest.fixture(scope="module")
def public(ranks):
    import public_tokenizers

    return tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_p6(found, public):
    texts = [None, "", " ", "a <|endoftext|> é", "\x1c\x1f \x85   x y  z\n\n", "don't I'LL we're 12 345 ½ ² ٣ 漢字かな 😀👍🏽", "a" * 3000, "Größe " * 5_000, "  \t\n ", "ᚠᛇ ﬁ Ⅷ ௧ é"]
    got = found("p6_ids", documents=(DOCS, [*enumerate((t, None) for t in texts)] and [(k, t, "x") for k, t in enumerate(texts)] + [(3, texts[3], None), (None, "b", None)]))
    want = [(k, public.encode_ordinary(t) if t else []) for k, t in enumerate(texts)] + [(3, public.encode_ordinary(texts[3])), (None, public.encode_ordinary("b"))]
    assert got == sorted(want, key=repr)
    assert found("p6_ids", documents=(DOCS, [])) == []


def test_bound_of_the_lexicon_changes_no_id(spark, public):
    texts = ["the queue drained 12 folders", "the the zyxomma", "Ünïcödé the"]
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    for words in (1, 3, 1000):
        assert {r.doc_id: r.ids for r in T.token_ids(spark, df, lexicon_words=words).collect()} == {k: public.encode_ordinary(t) for k, t in enumerate(texts)}


def test_merge_equals_the_public_library(ranks, public):
    rng = random.Random(4)
    for _ in range(300):
        word = "".join(rng.choice("aeinorst lTX'éü漢0") for _ in range(rng.randrange(1, 40)))
        assert T.merge(word.encode(), ranks) == public._encode_single_piece(word)


def test_lexicon_finds_its_words_and_no_others(tmp_path):
    rng = random.Random(2)
    words = sorted({bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 8))) for _ in range(500)})
    built = T.Lexicon.compile((w, [k, k + 1]) for k, w in enumerate(words))
    (tmp_path / "l").write_bytes(built.to_bytes())
    lexicon = T.Lexicon.mapped(str(tmp_path / "l"))
    assert lexicon.find(words).tolist() == [*range(len(words))]
    others = [w + b"d" for w in words] + [b"", b"zz", b"abcabcabca"]
    assert set(lexicon.find(others).tolist()) == {-1}
    at = int(lexicon.id_starts[7])
    assert lexicon.ids[at : at + 2].tolist() == [7, 8]


def test_lexicon_shares_suffixes():
    heads = [bytes([a, b]) for a in b"abcdefgh" for b in b"abcdefgh"]
    built = T.Lexicon.compile((w, [0]) for w in sorted(h + b"isation" for h in heads))
    assert len(built.final) == 1 + 1 + 8 and len(built.edge_keys) == 8 + 8 + 7
    assert T.Lexicon.compile([]).find([b"a"]).tolist() == [-1]
