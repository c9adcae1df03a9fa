import itertools

import numpy as np

from inkstone.llm import decontaminate

from .conftest import prose, rows


def brute(docs, items, min_words, identity):
    """Every document and item laid on every diagonal."""
    table = str.maketrans({chr(c): " " for c in range(128) if not chr(c).isalnum()})
    split = lambda t: (t or "").translate(table).lower().split()
    out = {}
    for doc, text in docs:
        words = split(text)
        for item, other in items:
            theirs = split(other)
            if len(theirs) < decontaminate.LEAST_ITEM:
                continue
            for shift in range(-len(theirs), len(words)):
                same = [words[shift + k] == theirs[k] for k in range(len(theirs)) if 0 <= shift + k < len(words)]
                for a in range(len(same)):
                    for b in range(len(same), a, -1):
                        if b - a >= min(min_words, len(theirs)) and 100 * sum(same[a:b]) >= (100 if len(theirs) < decontaminate.SHORT else identity) * (b - a):
                            best = (b - a, sum(same[a:b]))
                            out[doc, item] = max(out.get((doc, item), (0, 0)), best)
                            break
    return out


def _with(passage, seed, every=None):
    words = passage.split()
    if every:
        words[3::every] = [f"changed{k}" for k in range(len(words[3::every]))]
    return prose(30, seed) + " " + " ".join(words) + ". " + prose(20, seed + 1)


ITEMS = [(1, prose(30, 901)), (2, prose(14, 902)), (3, prose(10, 903)), (4, "no evidence here"), (5, None), (6, prose(30, 901)), (7, "five words are quite short")]


def test_same_as_brute_force(spark):
    docs = [(10, _with(ITEMS[0][1], 1)), (11, _with(ITEMS[0][1], 3, 8)), (12, _with(ITEMS[1][1], 5).upper()), (13, _with(ITEMS[2][1], 7)), (14, prose(90, 9)), (15, _with(" ".join(ITEMS[0][1].split()[4:20]), 11)), (16, None), (17, ITEMS[0][1]), (18, "see five words are QUITE short."), (19, "five words were quite short, no evidence here")]
    found = decontaminate.overlaps(spark, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string"))
    ours = {(r["doc_id"], r["item_id"]): (r["n_words"], r["n_same"]) for r in found.collect()}
    expected = brute(docs, ITEMS[:5] + ITEMS[6:], decontaminate.MIN_WORDS, decontaminate.IDENTITY)
    assert set(ours) == set(expected) and {d for d, _ in ours} == {10, 11, 12, 13, 15, 17, 18}
    assert all(ours[k][0] == expected[k][0] for k in ours)
    assert {r["item_id"]: r["n_items"] for r in found.collect()}[1] == 2


def test_blocks_give_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([(k, _with(ITEMS[k % 3][1], k)) for k in range(12)], "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    whole = rows(decontaminate.overlaps(spark, docs, items), "*")
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 60)
    assert rows(decontaminate.overlaps(spark, docs, items), "*") == whole and len(whole) == 12


def test_no_allowed_substitution_is_missed():
    rng = np.random.default_rng(3)
    for n in range(8, 21):
        item = prose(n, n)
        index = decontaminate.Index([(1, item)])
        for k, changed in enumerate(itertools.combinations(range(n), n // 5)):
            if n < 16 or rng.random() < 0.1:
                words = item.split()
                for at in changed:
                    words[at] = f"other{k}x{at}"
                hashes, rows_ = decontaminate._words(np.frombuffer(" ".join(words).encode(), np.uint8), np.array([0, len(" ".join(words))]))
                assert decontaminate._found(index, hashes, rows_, np.array([0, n]), 13, 80), (n, changed)


def test_shorter_items_on_request(spark):
    docs = spark.createDataFrame([(1, "there is no evidence here at all"), (2, "no other evidence here")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "no evidence here")], "item_id long, text string")
    assert decontaminate.overlaps(spark, docs, items).count() == 0
    assert rows(decontaminate.overlaps(spark, docs, items, least_item=1), "doc_id", "n_words") == [(1, 3)]


def test_longest_alike():
    same = np.array([0, 1, 1, 1, 0, 1, 1, 0, 0, 0, 1], bool)
    assert decontaminate.longest_alike(same, 80) == (1, 7)  # five of six
    assert decontaminate.longest_alike(np.zeros(4, bool)) == (0, 0)


def test_odd_rows(spark, odd, empty):
    items = spark.createDataFrame([(1, prose(80, 3)), (None, prose(60, 1))], "item_id long, text string").selectExpr("*", "1 as doc_id", "2 as item", "3 as n_items")
    found = decontaminate.overlaps(spark, odd, items)
    assert rows(found, "doc_id", "item_id") == sorted([(3, 1), (3, 1), (7, 1), (None, None)], key=repr)
    kept = decontaminate.decontaminate(spark, odd, items)
    assert kept.columns == odd.columns and rows(kept, "doc_id") == sorted([(k,) for k in (1, 2, 3, 4, 5, 6, 8, 9, None)], key=repr)
    assert decontaminate.overlaps(spark, empty, items).count() == 0
    assert decontaminate.overlaps(spark, odd, items.filter("false")).count() == 0
    assert decontaminate.decontaminate(spark, odd, items.filter("false")).count() == odd.count()
