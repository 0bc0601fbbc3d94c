import collections
import math
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from quadrat.llm import decontam

from .conftest import DOCS, prose, words

ITEMS = "item_id long, text string"


def _pairs_of_words(text):
    """2-shingles of a text of ASCII words, by plain Python; a single word is a shingle."""
    w = re.findall(r"\w+", (text or "").lower())
    return [tuple(w[k : k + 2]) for k in range(len(w) - 1)] if len(w) > 1 else [tuple(w)] * len(w)


def _brute(docs, items, threshold):
    """Best similarity of any window with each item, with words, weights and similarities by definition."""
    bags = {(k, i): _pairs_of_words(t) for k, (i, t) in enumerate(items)}
    bags = {k: b for k, b in bags.items() if b}
    df = collections.Counter(s for b in bags.values() for s in set(b))
    weight = lambda s: 1 + math.log((len(bags) + 1) / (df[s] + 1))
    out = {}
    for d, text in docs:
        code = _pairs_of_words(text)
        for (_, item), bag in bags.items():
            want = collections.Counter(bag)
            total = sum(n * weight(s) for s, n in want.items())
            if not set(code) & set(want):
                continue
            for s in range(len(code)):
                got = collections.Counter(code[s : s + len(bag)])
                both = sum(min(n, got[x]) * weight(x) for x, n in want.items())
                sim = both / (total + sum(n * weight(x) for x, n in got.items()) - both) if both else 0.0
                if sim >= threshold and sim > out.get((d, item), 0):
                    out[d, item] = sim
    return out


def _case(rng, edits):
    items = [(k, prose(rng, int(n))) for k, n in enumerate(rng.integers(12, 60, 25))]
    docs = []
    for d in range(60):
        text = words(rng, int(rng.integers(5, 120)))
        if d % 2:
            w = items[int(rng.integers(25))][1].rstrip(".").split(" ")
            for k in rng.choice(len(w), int(edits * len(w)), replace=False):
                w[k] = "zz" + "".join(rng.choice(list("qxyw"), 4))
            at = int(rng.integers(0, len(text)))
            text = text[:at] + w + text[at:]
        docs.append((d, " ".join(text)))
    return docs, items


@pytest.mark.parametrize("edits", [0.0, 0.08, 0.15])
def test_leaks_against_brute_force(spark, rng, edits):
    docs, items = _case(rng, edits)
    df = spark.createDataFrame([(d, t.upper() if d % 3 else t, "en", "s", 0) for d, t in docs], DOCS)
    got = {(r.doc_id, r.item_id): r.similarity for r in decontam.leaks(df, spark.createDataFrame(items, ITEMS)).collect()}
    want = _brute(docs, items, decontam.THRESHOLD)
    assert len(want) >= 10 and not set(got) - set(want)
    assert len(set(got) & set(want)) >= (1 if edits == 0 else 0.9) * len(want)
    assert all(got[k] == pytest.approx(want[k]) or got[k] < want[k] for k in got)
    kept = {r.doc_id for r in decontam.decontaminate(df, spark.createDataFrame(items, ITEMS)).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in got}


def test_one_and_many_passes_give_the_same(spark, rng):
    docs, items = _case(rng, 0.15)
    items += [(100 + k, items[k][1].split(" ", 6)[-1]) for k in range(8)] + [(200, ""), (201, None)]
    df, b = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in docs], DOCS), spark.createDataFrame(items, ITEMS).repartition(3)
    rows = [sorted(map(tuple, decontam.leaks(df, b, pass_bytes=size).collect())) for size in (1 << 30, 40_000)]
    assert len(list(decontam._indexes(b, 0.5, 40_000, "item_id", "text"))) > 3
    assert len(rows[0]) >= 10 and [r[:2] + r[3:] for r in rows[0]] == [r[:2] + r[3:] for r in rows[1]]
    assert [r[2] for r in rows[0]] == pytest.approx([r[2] for r in rows[1]], abs=1e-12)


def test_long_texts_in_stretches(spark, rng, monkeypatch):
    """Many MB of benchmark text in one document, and stretches shorter than an item, give what one stretch gives."""
    docs, items = _case(rng, 0.08)
    texts = pa.array([t for _, t in docs])
    index = decontam.Index([i for i, _ in items], [t for _, t in items], 0.5)
    want = sorted(index.matches(texts))
    for span in (7, 64, 1000):
        monkeypatch.setattr(decontam, "SPAN", span)
        assert sorted(index.matches(texts)) == want and len(want) >= 10
    monkeypatch.undo()
    tracemalloc.start()
    got = index.matches(pa.array([" ".join(t for _, t in items * 400)]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert {index.ids[x[1]] for x in got} == {i for i, _ in items} and all(x[2] == pytest.approx(1) for x in got)
    assert peak < 400 << 20  # 512 bytes for each of 360,000 shingles are 184 MB, several times


def test_equal_windows_and_ids_of_other_types(spark):
    docs = spark.createDataFrame([(1, "x y. alpha beta gamma delta. z w q. alpha beta gamma delta"), (None, "alpha beta gamma delta"), (2, None)], "doc_id long, text string")
    b = spark.createDataFrame([("i1", "alpha beta gamma delta"), (None, "alpha beta gamma delta"), ("i2", None)], "item_id string, text string")
    got = sorted(((r.doc_id, r.item_id, round(r.similarity, 9), r.first_word) for r in decontam.leaks(docs, b).collect()), key=str)
    assert got == sorted([(1, "i1", 1.0, 2), (1, None, 1.0, 2), (None, "i1", 1.0, 0), (None, None, 1.0, 0)], key=str)
    assert [r.doc_id for r in decontam.decontaminate(docs, b).collect()] == [2]


def test_index_finds_every_print_within_the_radius(rng):
    items = [(k, prose(rng, 20)) for k in range(60)]
    index = decontam.Index([i for i, _ in items], [t for _, t in items], 0.5)
    prints = []
    for p in index.prints:
        for flips in (0, 7, decontam.RADIUS, decontam.RADIUS + 1):
            for b in rng.choice(64, flips, replace=False):
                p = p ^ (np.uint64(1) << np.uint64(b))
            prints.append(p)
    prints = np.array(prints, np.uint64)
    for rank in range(len(index.lengths)):
        w, i = index.candidates(rank, prints)
        got = set(zip(w.tolist(), i.tolist()))
        same = np.flatnonzero(index.size == index.lengths[rank])
        want = {(a, int(b)) for a in range(len(prints)) for b in same if int(prints[a] ^ index.prints[b]).bit_count() <= decontam.RADIUS}
        assert got == want


def test_odd_rows(spark, odd, none):
    b = spark.createDataFrame([(1, "One plain text with a few words in it"), (2, None), (3, ""), (None, "nothing like this anywhere"), (1, "One plain text with a few words in it"), (4, "a")], ITEMS)
    got = sorted((r.doc_id, r.item_id) for r in decontam.leaks(odd, b).collect())
    assert got == [(1, 1)] * 4 + [(8, 4)]
    kept = decontam.decontaminate(odd, b)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 3
    assert decontam.leaks(none, b).count() == 0
    empty = spark.createDataFrame([], ITEMS)
    assert decontam.leaks(odd, empty).count() == 0 and decontam.decontaminate(odd, empty).count() == odd.count()
