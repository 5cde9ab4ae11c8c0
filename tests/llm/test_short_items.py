"""Benchmark items of few words, copied whole and with substitutions."""

import itertools

import numpy as np

from crewmetrics.llm import decontaminate


def seeded(words, lost):
    """Whether a window of the copy is equal to the item's in the marked positions of a mask."""
    return any(all(m == "0" or i + j not in lost for j, m in enumerate(mask)) for mask in decontaminate.MASKS for i in range(words - decontaminate.SPAN + 1))


def test_short_items(shared):
    items, docs, wanted, absent = [], [], set(), set()
    for n in range(3, 19):
        words = [f"i{n}w{k}" for k in range(n)]
        items.append((n, " ".join(words)))
        for subs in range(4 if n >= 9 else 2):
            places = list(itertools.combinations(range(n), subs))
            for lost in places[:: max(1, len(places) // 25)]:
                doc = len(docs)
                docs.append((doc, " ".join(["before it", *("x" if k in lost else w for k, w in enumerate(words)), "after it"])))
                if n < decontaminate.SHORTEST or n < 9 and subs:
                    absent.add((doc, n))
                elif not subs or n >= 9 and seeded(n, lost) and n - 3 * subs >= 0.4 * n:
                    wanted.add((doc, n))
    docs += [(-1, " ".join(f"i7w{k}" for k in range(6))), (-2, None), (-3, "")]
    table, bench = shared.createDataFrame(docs, "doc_id long, text string"), shared.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.overlaps(table, bench).collect()}
    assert wanted <= found and not absent & found and all(d >= 0 and f"i{i}w" in docs[d][1] for d, i in found)
    assert {i for _, i in wanted} == set(range(5, 19))


def test_least_score_of_an_item():
    prints = np.array([[1] * n + [0] * (30 - n) for n in (5, 8, 9, 12, 15, 18, 25, 30)])
    assert list(decontaminate.least(prints)) == [5, 8, 4, 5, 6, 8, 10, 10]
