import numpy as np
import pyarrow as pa
import pytest

from quadrat.llm import exact, neardup, tokens

from .conftest import DOCS, prose, words


def _pairs(df):
    return sorted((r.doc_id, r.duplicate_of) for r in df.collect())


@pytest.mark.parametrize("bits", [64, 3])
def test_exact_copies_against_grouping_by_text(spark, rng, bits):
    """With 3-bit identifiers nearly all chunks collide, and verification must tell them apart."""
    base = [prose(rng, n) for n in rng.integers(1, 2500, 30)]
    texts = [base[k] for k in rng.integers(0, 30, 90)] + [base[0] + " more", "x" + base[1], base[2][:-1]]
    ids = rng.permutation(len(texts))
    df = spark.createDataFrame([(int(i), t, "en", "s", len(t)) for i, t in zip(ids, texts)], DOCS).repartition(5)
    low = {}
    for i, t in zip(ids.tolist(), texts):
        low[t] = min(low.get(t, i), i)
    want = sorted((i, low[t]) for i, t in zip(ids.tolist(), texts) if low[t] != i)
    assert _pairs(exact.duplicates(df, id_bits=bits)) == want
    assert sorted(r.doc_id for r in exact.deduplicate(df, id_bits=bits).collect()) == sorted(low.values())


def test_exact_with_odd_rows(odd, none):
    assert _pairs(exact.duplicates(odd)) == []
    kept = exact.deduplicate(odd)
    assert kept.columns == odd.columns
    got = sorted((r.doc_id is None, r.doc_id or 0, r.text is None) for r in kept.collect())
    assert len(got) == odd.count() - 1 and sum(1 for x in got if x[:2] == (False, 1)) == 1
    assert exact.duplicates(none).count() == 0 and exact.deduplicate(none).count() == 0


def test_ties_and_nulls_of_copies(spark):
    rows = [(5, "same", None, None, None), (None, "same", "a", None, None), (2, "same", "b", None, None), (7, None, "c", None, None), (8, None, "d", None, None), (9, "", "e", None, None), (10, "", "f", None, None)]
    df = spark.createDataFrame(rows, DOCS)
    assert _pairs(exact.duplicates(df)) == [(5, 2), (10, 9)]
    assert sorted(r.doc_id for r in exact.deduplicate(df).collect()) == [2, 7, 8, 9]


def test_ids_that_do_not_tell_rows_apart(spark):
    """Shared and null ids against keeping the first row of each text by hand."""
    rows = [(1, "a"), (1, "a"), (1, "b"), (2, "b"), (2, "c"), (2, None), (3, "c"), (None, "c"), (None, "d"), (None, "d"), (None, None), (4, "e"), (4, "e"), (0, "e"), (1, None)]
    df = spark.createDataFrame([(*r, 1, "k", "f") for r in rows], "doc_id long, text string, copy long, first_id string, key0 string").repartition(4)
    want = sorted(map(str, [(1, "a"), (1, "b"), (2, "c"), (None, "d"), (0, "e"), (2, None), (None, None), (1, None)]))
    for bits in (64, 3):
        kept = exact.deduplicate(df, id_bits=bits)
        assert kept.columns == df.columns and sorted(str((r.doc_id, r.text)) for r in kept.collect()) == want


def test_chunk_borders_follow_the_content(rng):
    text = prose(rng, 8000)
    shifted = "An inserted beginning. " + text
    _, _, a, _ = exact.recipe_columns(pa.array([text]))
    _, _, b, _ = exact.recipe_columns(pa.array([shifted]))
    assert len(set(a.tolist()) & set(b.tolist())) > 0.8 * len(a)
    _, off, ids, digests = exact.recipe_columns(pa.array(["", None, text, "y" * 30_000]))
    assert off.tolist()[:3] == [0, 0, 0] and len(ids) == len(digests) == off[-1]


def _edited(rng, text, share):
    w = text.split(" ")
    for k in rng.choice(len(w), max(1, int(share * len(w))), replace=False):
        w[k] = "".join(rng.choice(list("abcdef"), 6))
    return " ".join(w)


def _sets(texts):
    out = []
    for a, b, buf, off in tokens.blocks(pa.array(texts)):
        key, _, first = neardup.distinct_shingles(buf, off)
        out += [set((key[first[k] : first[k + 1]] & np.uint64(2**44 - 1)).tolist()) for k in range(b - a)]
    return out


def _brute(texts, threshold):
    sets, root = _sets(texts), list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and n / len(sets[i] | sets[j]) >= threshold:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {(i, find(i)) for i in range(len(texts)) if find(i) != i}


def test_near_groups_against_brute_force(spark, rng):
    shared = prose(rng, 60)
    texts = []
    for n in rng.integers(30, 500, 60):
        first = prose(rng, n)
        texts += [first] + [_edited(rng, first, s) for s in rng.uniform(0.005, 0.12, rng.integers(0, 5))]
    texts += [prose(rng, 80) + " " + shared for _ in range(40)]
    big = prose(rng, 300)
    texts += [_edited(rng, big, 0.04) for _ in range(120)]
    df = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], DOCS).repartition(6)
    want, got = _brute(texts, 0.5), set(_pairs(neardup.duplicates(df)))
    assert len({x for x, _ in want} & {x for x, _ in got}) >= 0.97 * len(want)
    assert not {x for x, _ in got} - {x for x, _ in want}
    assert len(want & got) >= 0.9 * len(want)
    kept = {r.doc_id for r in neardup.deduplicate(df).collect()}
    assert kept == set(range(len(texts))) - {x for x, _ in got}


def _bucketed_groups(texts, threshold):
    """Groups by brute force over all pairs that share a bucket and are estimated within the margin."""
    regs, size, _ = neardup.sketch(pa.array(texts))
    bands = regs[:, : neardup.BAND * neardup.BANDS].reshape(len(texts), neardup.BANDS, neardup.BAND)
    sets, root = _sets(texts), list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if (bands[i] == bands[j]).all(1).any() and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= threshold:
                if neardup._estimates(regs[j : j + 1], regs[i : i + 1], size[j : j + 1], size[i : i + 1], 0.0)[0] >= threshold - neardup.MARGIN:
                    a, b = find(i), find(j)
                    root[max(a, b)] = min(a, b)
    return {(i, find(i)) for i in range(len(texts)) if find(i) != i}


def test_partners_that_only_seem_near_the_smallest_are_found(spark, rng):
    """A shared passage: each row is at 0.42 to 0.49 to the smallest one and above 0.5 to its partner only."""
    shared, texts = prose(rng, 120), []
    for _ in range(60):
        both = prose(rng, 20)
        texts += [f"{shared} {both} {prose(rng, int(n))}" for n in rng.integers(36, 52, 2)]
    texts.insert(0, f"{shared} {prose(rng, 70)}")
    sets = _sets(texts)
    to_first = [len(s & sets[0]) / len(s | sets[0]) for s in sets[1:]]
    assert 0.4 <= min(to_first) and max(to_first) < 0.5
    df = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], DOCS).repartition(3)
    want = _bucketed_groups(texts, 0.5)
    assert len(want) >= 40 and set(_pairs(neardup.duplicates(df))) == want


def test_crossing_pairs_are_all_of_different_groups(rng):
    base = prose(rng, 200)
    texts = [_edited(rng, base, s) for s in rng.uniform(0.02, 0.15, 400)]
    regs, size, _ = neardup.sketch(pa.array(texts))
    starts, group = np.array([0, 1, 390, 400]), rng.integers(0, 5, 400)
    got = [(int(a), int(b)) for p in neardup.crossing_pairs(np.arange(400), group, size, regs, starts, 0.5) for a, b in zip(p[0], p[1])]
    want = []
    for lo, hi in zip(starts[:-1], starts[1:]):
        i, j = np.triu_indices(hi - lo, 1)
        i, j = (i + lo)[group[i + lo] != group[j + lo]], (j + lo)[group[i + lo] != group[j + lo]]
        e = neardup._estimates(regs[i], regs[j], size[i], size[j], 0.5 - neardup.MARGIN)
        want += [(int(a), int(b)) for a, b in zip(i[e >= 0.5 - neardup.MARGIN], j[e >= 0.5 - neardup.MARGIN])]
    assert len(got) == len(set(got)) > 1 << 15 and sorted(got) == sorted(want)


def test_split_buckets_give_the_same(spark, rng, monkeypatch):
    """Parts and tiles of a few documents each, and components by joins."""
    shared, texts = prose(rng, 120), []
    for _ in range(20):
        both = prose(rng, 20)
        texts += [f"{shared} {both} {prose(rng, int(n))}" for n in rng.integers(36, 52, 2)]
    big = prose(rng, 200)
    texts += [_edited(rng, big, 0.04) for _ in range(30)]
    df = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], DOCS).repartition(3)
    want = _pairs(neardup.duplicates(df))
    for name, value in (("PART", 4), ("TILE", 3), ("ONE_TASK_EDGES", 0)):
        monkeypatch.setattr(neardup, name, value)
    assert _pairs(neardup.duplicates(df)) == want and set(want) == _bucketed_groups(texts, 0.5)


def test_pairs_that_only_the_second_search_finds_are_verified(spark, rng, monkeypatch):
    """The first search made to find nothing in buckets of three or more, so their texts weren't fetched for it."""
    big = prose(rng, 200)
    texts = [_edited(rng, big, 0.04) for _ in range(25)] + [prose(rng, 50) for _ in range(5)]
    df = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], DOCS).repartition(3)
    want, real = _pairs(neardup.duplicates(df)), neardup._candidates
    monkeypatch.setattr(neardup, "_candidates", lambda members, reps, threshold: real(members.where("size = 2"), reps, threshold))
    assert len(want) == 24 and _pairs(neardup.duplicates(df)) == want


def test_rows_that_share_an_id_are_one_text_in_any_order(spark, rng):
    a, b = prose(rng, 60), prose(rng, 60)
    rows = [(1, a, None, None, None), (2, a + " more", None, None, None), (2, b, None, None, None), (2, "", None, None, None)]
    got = {str(_pairs(neardup.duplicates(spark.createDataFrame([rows[k] for k in order], DOCS).repartition(n)))) for order, n in (((0, 1, 2, 3), 1), ((3, 2, 1, 0), 1), ((2, 0, 3, 1), 3))}
    assert len(got) == 1 and got <= {"[]", "[(2, 1)]"}


def test_near_with_odd_rows(odd, none, spark):
    assert neardup.duplicates(odd).count() == 0
    kept = neardup.deduplicate(odd)
    assert kept.columns == odd.columns and kept.count() == odd.count()
    assert neardup.duplicates(none).count() == 0 and neardup.deduplicate(none).count() == 0
    same = spark.createDataFrame([(3, "a b c d", None, None, None), (1, "A, b c d!", None, None, None), (2, "x", None, None, None), (4, "x", None, None, None), (3, "a b c d", None, None, None)], DOCS)
    assert _pairs(neardup.duplicates(same)) == [(3, 1), (4, 2)]


def test_sketch_merges_and_estimates(rng):
    w = words(rng, 3000)
    texts = [" ".join(w[:2000]), " ".join(w[1000:])]
    regs, size, digest = neardup.sketch(pa.array(texts))
    sets = _sets(texts)
    assert size.tolist() == [len(s) for s in sets] and (digest[0] != digest[1]).any()
    true = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
    est = neardup._estimates(regs[:1], regs[1:], size[:1], size[1:], 0.0)
    assert abs(est[0] - true) < 3 * (true * (1 - true) / neardup.REGISTERS) ** 0.5
    # a sketch of the union is the maximum of the sketches
    mask = np.uint64(2**44 - 1)
    union = np.array(sorted(sets[0] | sets[1]), np.uint64)
    x = (tokens.mix(union & mask) >> np.uint64(32)).astype(np.uint32)
    low = []
    for i in range(neardup.REGISTERS):
        y = x * neardup._MUL[i] + neardup._ADD[i]
        y ^= y >> np.uint32(15)
        low.append((y * np.uint32(0x85EBCA6B)).min())
    assert (neardup.registers(np.array([low], np.uint32))[0] == regs.max(0)).all()


def test_likelihood_peaks_where_a_grid_does(rng):
    more, less, same = rng.integers(0, 30, 20), rng.integers(0, 30, 20), rng.integers(1, 40, 20)
    nu, nv = rng.integers(50, 500, 20), rng.integers(50, 500, 20)
    got = neardup.likelihood(more, less, same, nu, nv)
    c, scale = (neardup.BASE - 1) / neardup.BASE, -1 / np.log(neardup.BASE)
    p = lambda x: scale * np.log1p(-np.maximum(x, 0) * c)
    for k in range(20):
        u, v = nu[k] / (nu[k] + nv[k]), nv[k] / (nu[k] + nv[k])
        j = np.linspace(1e-6, min(u / v, v / u) - 1e-6, 4000)
        like = more[k] * np.log(p(u - v * j) + 1e-12) + less[k] * np.log(p(v - u * j) + 1e-12) + same[k] * np.log(np.maximum(1 - p(u - v * j) - p(v - u * j), 0) + 1e-12)
        assert abs(j[like.argmax()] - got[k]) < 2e-3


def test_components_of_chains_and_stars(spark, rng, monkeypatch):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 130)] + [(50, 51), (51, 50), (60, 60)]
    df = spark.createDataFrame([edges[k] for k in rng.permutation(len(edges))], "a long, b long")
    for most in (0, 1 << 20):
        monkeypatch.setattr(neardup, "ONE_TASK_EDGES", most)
        got = {r.id: r.root for r in neardup.components(df).collect()}
        assert len(got) == neardup.components(df).count() and got == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 130)}, 50: 50, 51: 50}
