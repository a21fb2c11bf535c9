import random
import sys
from itertools import combinations

import numpy as np
import pyarrow as pa

from driftlens.llm.decontaminate import MASKS, clean, overlaps


def vocabulary(seed, n, size=5000):
    rng = random.Random(seed)
    return [f"v{rng.randrange(size)}" for _ in range(n)]


def with_substitutions(words, every):
    return [w if i % every else f"sub{i}" for i, w in enumerate(words)]


ITEMS = [(1, vocabulary(1, 40)), (2, vocabulary(2, 30)), (3, vocabulary(3, 9)), (4, vocabulary(4, 3)), (5, []), (6, vocabulary(6, 60))]


def bench(spark, rows=ITEMS):
    return spark.createDataFrame([(i, " ".join(w), "t") for i, w in rows] + [(7, None, "t")], "item_id long, text string, row string")


def docs_and_truth():
    item = dict(ITEMS)
    rows, truth = [], set()
    for k, (item_id, words) in enumerate([(1, item[1]), (2, item[2]), (3, item[3]), (6, item[6])]):
        around = vocabulary(100 + k, 200)
        rows.append((10 + k, " ".join(around[:90] + words + around[90:])))
        truth.add((10 + k, item_id))
    rows.append((20, " ".join(w.upper() + "," for w in item[1])))  # case and punctuation
    rows.append((21, " ".join(with_substitutions(item[1], 7))))  # one word in seven replaced
    rows.append((22, " ".join(vocabulary(7, 300) + with_substitutions(item[6], 6)[5:45])))
    truth |= {(20, 1), (21, 1), (22, 6)}
    rows.append((30, " ".join(item[1][:8] + vocabulary(8, 50) + item[1][20:28])))  # two short pieces: no evidence
    rows.append((31, " ".join(with_substitutions(item[2], 2))))  # half replaced
    rows.append((32, " ".join(item[3][:8])))  # a short item must be whole
    rows.append((33, " ".join(item[4])))  # too short to be evidence
    rows += [(34, ""), (35, None), (36, " ".join(vocabulary(9, 500))), (20, " ".join(item[2])), (None, " ".join(item[2]))]
    truth |= {(20, 2), (None, 2)}
    return rows, truth


def brute_force(rows):
    """Every diagonal of every document and item: 13 aligned words, four fifths equal."""
    import re

    def split(text):
        return [w for w in re.split(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (text or "").lower()) if w]

    found = set()
    for doc, text in rows:
        words = split(text)
        for item, own in ITEMS:
            if len(own) < 5:
                continue
            width, share = min(13, len(own)), 0.8 if len(own) >= max(map(len, MASKS)) else 1.0
            for shift in range(-len(own), len(words)):
                equal = [words[shift + i] == w if 0 <= shift + i < len(words) else None for i, w in enumerate(own)]
                equal = [e for e in equal if e is not None]
                if any(sum(equal[i : i + width]) >= share * width for i in range(len(equal) - width + 1)):
                    found.add((doc, item))
    return found


def test_hits_equal_brute_force_and_truth(spark, documents):
    rows, truth = docs_and_truth()
    found = overlaps(documents(rows), bench(spark))
    got = [(r["doc_id"], r["item_id"]) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == truth == brute_force(rows)
    whole = {(r["doc_id"], r["item_id"]): r for r in found.collect()}
    assert (whole[10, 1]["doc_start"], whole[10, 1]["item_start"], whole[10, 1]["n_words"], whole[10, 1]["n_equal"]) == (90, 0, 40, 40)


def test_clean_keeps_the_others_with_all_columns(spark, documents):
    rows, truth = docs_and_truth()
    rows = [r for r in rows if r[0] is not None]
    frame = documents(rows)
    kept = clean(frame, bench(spark))
    assert kept.columns == frame.columns
    gone = {(d, t) for d, t in rows if (d, t) in {(x, y) for x, y in rows if brute_force([(x, y)])}}
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect() if r["text"]) == sorted((d, t) for d, t in rows if t and (d, t) not in gone)
    assert {34, 35} <= {r["doc_id"] for r in kept.collect()}


def test_blocks_of_the_benchmark_give_the_same(spark, documents, monkeypatch):
    from driftlens.llm import decontaminate

    rows, truth = docs_and_truth()
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 200)
    assert {(r["doc_id"], r["item_id"]) for r in overlaps(documents(rows), bench(spark)).collect()} == truth


def test_items_of_all_short_lengths_and_all_pairs_of_other_words(spark, documents, monkeypatch):
    items = [(n, vocabulary(50 + n, n)) for n in range(4, 14)]
    rows = [(n, " ".join(vocabulary(90 + n, 20) + words + vocabulary(70 + n, 20))) for n, words in items]
    for n, words in items:
        for a, b in combinations(range(n), 2):
            rows.append((10_000 * n + 100 * a + b, " ".join(["before", *(f"other{i}" if i in (a, b) else w for i, w in enumerate(words)), "after"])))
    monkeypatch.setattr(sys.modules[__name__], "ITEMS", items)
    truth = brute_force(rows)
    assert {(n, n) for n in range(5, 14)} <= truth and len(truth) == 9 + 66 + 78  # 10 of 12 and 11 of 13 words are enough
    assert {(r["doc_id"], r["item_id"]) for r in overlaps(documents(rows), bench(spark, items)).collect()} == truth
    assert {r["doc_id"] for r in clean(documents(rows), bench(spark, items)).collect()} == {d for d, _ in rows} - {d for d, _ in truth}


def test_empty_tables(spark, documents):
    frame = documents([(1, "a b c")])
    assert overlaps(frame, bench(spark).where("false")).count() == 0
    assert clean(frame, bench(spark).where("false")).count() == 1
    assert overlaps(frame.where("false"), bench(spark)).count() == 0


def test_index_is_small_and_words_that_agree_by_half_a_hash_are_verified(monkeypatch):
    from driftlens.llm import decontaminate

    items = [(i, " ".join(vocabulary(i, 60, 50_000))) for i in range(2000)]
    index = decontaminate.SeedIndex([*items, (None, ""), (2001, None)])
    assert index.nbytes < 13 * sum(len(t) for _, t in items)
    monkeypatch.setattr(decontaminate, "_half", lambda hashes: np.zeros(len(hashes), np.uint32))
    few = decontaminate.SeedIndex(items[:20])
    words, first = decontaminate.WordHasher(separators=decontaminate.NOT_ALPHANUMERIC)(pa.array([items[3][1], items[7][1] + " x", "a b c"]))
    assert [set(found) for found in few.overlapping(words, first)] == [{3}, {7}, set()]
