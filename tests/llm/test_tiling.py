import random

from imaging_engine.llm import tiling

DOCS = "doc_id long, text string, item_id long"
ITEMS = "item_id long, text string, doc_id long"
ITEM = "Eins zwei drei vier fünf sechs sieben acht neun zehn elf zwölf dreizehn vierzehn"


def test_p7(found):
    w = ITEM.split()
    docs = [
        (1, "x " + ", ".join(w[1:13]).upper(), 9), (2, " ".join(w[:11]), 9), (3, "<p>" + " <b>".join(w[:6]) + "</b><br/>" + "\n".join(w[6:12]).replace("ü", "u"), 9), (4, None, 9), (5, "", 9),
        (6, "fill " * 50_000 + ITEM + " fill" * 50_000, 9), (1, ITEM, None), (None, ITEM, 1),
    ]
    items = [(7, ITEM, 1), (7, ITEM, 2), (8, "too short", 1), (9, None, 1), (10, "", None)]
    assert found("p7_found", documents=(DOCS, docs), eval_items=(ITEMS, items)) == sorted([(1, 7), (3, 7), (6, 7), (None, 7)], key=repr)


def test_empty(found):
    assert found("p7_found", documents=(DOCS, []), eval_items=(ITEMS, [(1, ITEM, 1)])) == []
    assert found("p7_found", documents=(DOCS, [(1, ITEM, 1)]), eval_items=(ITEMS, [])) == []


def test_coverage_counts_reordered_passages(found):
    w = ITEM.split()
    docs = [(1, " ".join([*w[7:], "und", *w[:7]]), 0), (2, " ".join(w[:6]), 0)]
    assert found("p7_coverage", documents=(DOCS, docs), eval_items=(ITEMS, [(7, ITEM, 0)])) == [(1, 7, 2, 7, 14, 14)]


def test_shuffled_seeds_give_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([(k, ITEM if k % 3 == 0 else f"{k} " + " ".join(ITEM.split()[:9])) for k in range(60)], "doc_id long, text string")
    items = spark.createDataFrame([(7, ITEM)], "item_id long, text string")
    few = sorted(map(tuple, tiling.tile_pairs(spark, docs, items).collect()))
    monkeypatch.setattr(tiling, "FILTER_SEEDS", 0)
    assert sorted(map(tuple, tiling.tile_pairs(spark, docs, items).collect())) == few and len(few) == 20


def test_tiles_against_a_plain_version():
    def plain(doc, item, least):
        free_d, free_i, found = [True] * len(doc), [True] * len(item), []
        while True:
            best = (0, 0, 0)
            for i in range(len(doc)):
                for j in range(len(item)):
                    n = 0
                    while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n] and free_d[i + n] and free_i[j + n]:
                        n += 1
                    if n > best[0]:
                        best = (n, i, j)
            n, i, j = best
            if n < least:
                return sorted(found)
            free_d[i : i + n] = free_i[j : j + n] = [False] * n
            found.append((i, j, n))

    rng = random.Random(8)
    for _ in range(150):
        doc, item = ([rng.choice("ab cd e".split()) for _ in range(rng.randrange(0, 30))] for _ in range(2))
        got, want = tiling.tiles(doc, item, 3), plain(doc, item, 3)
        assert sorted(n for *_, n in got) == sorted(n for *_, n in want)
        assert all(doc[i : i + n] == item[j : j + n] for i, j, n in got)


def test_seeds_are_equal_for_equal_windows():
    w = [str(k % 5) for k in range(40)]
    s = tiling.seeds(w, 12).tolist()
    assert len(s) == 29 and s[:24] == s[5:] and len(set(s)) == 5
