import numpy as np
import pyarrow as pa

from quadrat.llm import toxicity

from .conftest import DOCS, words

LABELS = "doc_id long, quality int, toxic int"
BAD = ["idiot", "scum", "moron", "trash"]


def _corpus(rng, n):
    rows, labels = [], []
    for d in range(n):
        w = words(rng, int(rng.integers(20, 200)))
        bad = int(rng.random() < 0.25)
        if bad:
            for k in rng.choice(len(w), 3, replace=False):
                w[k] = str(rng.choice(BAD))
        rows.append((d, " ".join(w), "en", "s", 0))
        labels.append((d, 1, bad))
    return rows, labels


def test_held_out_accuracy(spark, rng):
    rows, labels = _corpus(rng, 900)
    docs = spark.createDataFrame(rows, DOCS)
    out = {r.doc_id: r for r in toxicity.detect(docs, spark.createDataFrame(labels[:600], LABELS)).collect()}
    held = [(d, t) for d, _, t in labels[600:]]
    right = np.mean([out[d].toxic == bool(t) for d, t in held])
    assert len(out) == 900 and right > 0.97
    kept = {r.doc_id for r in toxicity.drop_toxic(docs, spark.createDataFrame(labels[:600], LABELS)).collect()}
    assert kept == {d for d in out if not out[d].toxic}


def test_score_against_a_dictionary(rng):
    texts = ["Some Idiot here", "idiot idiot idiot, idiot", "", "été"]
    model = toxicity.fit(pa.array([" ".join(w) for w in (["idiot", "ab"], ["fine", "cd"]) for _ in range(30)]), np.array([1] * 30 + [0] * 30))
    weights = dict(zip(model[0].tolist(), model[1]))
    for text, got in zip(texts, toxicity.score(pa.array(texts), model)):
        s = model[2]
        for a, b, buf, off in toxicity.tokens.blocks(pa.array([text])):
            for o, doc, h in toxicity._grams(buf, off):
                seen = {}
                for x in h.tolist():
                    seen[x] = seen.get(x, 0) + 1
                for x, n in seen.items():
                    s += sum(weights.get(x + ((o * 3 + c) << toxicity.HASH_BITS), 0) for c, least in enumerate(toxicity.COUNTS) if n >= least)
        assert abs(got - 1 / (1 + np.exp(-s))) < 1e-9


def test_odd_rows(spark, odd, none, rng):
    rows, labels = _corpus(rng, 200)
    train = spark.createDataFrame([(d + 100, 1, t) for d, _, t in labels] + [(None, 1, 1), (1, None, None), (10**9, 0, 1), (100, 1, 1)], LABELS)
    docs = odd.select(*[c.split()[0] for c in DOCS.split(", ")]).unionByName(spark.createDataFrame([(d + 100, t, l, s, n) for d, t, l, s, n in rows], DOCS))
    out = toxicity.detect(docs, train)
    null = [r for r in out.collect() if r.doc_id == 2]
    assert null[0].score is None and null[0].toxic is False and out.count() == docs.count()
    kept = toxicity.drop_toxic(odd, train)
    assert kept.columns == odd.columns and kept.count() == odd.count()
    assert toxicity.detect(none, train).count() == 0
    no_labels = spark.createDataFrame([], LABELS)
    assert not any(r.toxic for r in toxicity.detect(odd, no_labels).collect())
    assert toxicity.drop_toxic(odd, no_labels).count() == odd.count()


def test_labels_are_made_one_before_the_bounds(spark, rng):
    """Documents with both labels are toxic, however few rows of each class the bounds allow."""
    rows, labels = _corpus(rng, 300)
    both = [(d, 1, 0) for d, _, t in labels if t] + [(d, 1, 3 * t) for d, _, t in labels] + [(d, 1, -1) for d, _, t in labels if not t]
    docs = spark.createDataFrame(rows, DOCS)
    bound = toxicity.train(docs, spark.createDataFrame(both, LABELS).repartition(3), max_toxic=20, max_clean=40)
    want = toxicity.train(docs, spark.createDataFrame(labels, LABELS).repartition(3), max_toxic=20, max_clean=40)
    assert (bound[0] == want[0]).all() and (bound[1] == want[1]).all() and bound[2] == want[2]


def test_number_of_features_is_a_parameter(spark, rng):
    rows, labels = _corpus(rng, 200)
    model = toxicity.train(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS), max_features=7)
    assert len(model[0]) == len(model[1]) == 7
