import collections
import math
import re
import textwrap

import numpy as np
import pyarrow as pa
import pytest

from quadrat.llm import licenses

from .conftest import DOCS, prose


@pytest.fixture(scope="module")
def model():
    r = np.random.default_rng(2)
    return licenses.fit([prose(r, int(n)) for n in r.integers(3, 60, 400)])


def test_every_notice_is_told_even_if_altered(model):
    r = np.random.default_rng(5)
    right = total = 0
    for family, notices in licenses.TEMPLATES.items():
        for t in notices:
            assert [x[2] for x in model.findings(pa.array([t]))] == [family], t
            if len(t.split()) >= 8:
                for _ in range(6):
                    w = t.split()
                    del w[int(r.integers(len(w)))]
                    total += 1
                    right += [x[2] for x in model.findings(pa.array([" ".join(w).upper()]))] == [family]
    assert right >= 0.9 * total


def test_talk_of_licences_is_unknown(model, rng):
    unseen = ["She lost her license to practise medicine.", "The public library is free for everyone.", "Version 3 of the plan was licensed to a general contractor.", "MIT and Apache are names.", "copyright"]
    assert model.findings(pa.array(licenses.NO_NOTICE + unseen + [prose(rng, 200) for _ in range(50)])) == []


def test_place_and_calibration(model, rng):
    text = f"{prose(rng, 30)}\n\nReleased under the MIT License.\n{prose(rng, 10)}\nLicensed under CC BY-NC 4.0."
    got = model.findings(pa.array([prose(rng, 5), text, None, ""]))
    assert [(x[0], x[1], x[2]) for x in got] == [(1, 2, "MIT"), (1, 4, "CC-BY-NC")]
    assert all(x[3] >= model.confident and x[5] >= model.contained for x in got) and 0.25 <= model.temperature <= 4


def test_bound_leaves_out_only_what_cannot_be_reported(model, rng):
    """Against classifying and confirming every paragraph."""
    bits = [t for ts in licenses.TEMPLATES.values() for t in ts]
    lines = []
    for _ in range(300):
        w = bits[int(rng.integers(len(bits)))].split()
        a = int(rng.integers(len(w)))
        lines.append(" ".join([*prose(rng, int(rng.integers(1, 10))).split(), *w[a : a + int(rng.integers(1, 30))]]))
    got = {x[0]: x[2] for x in model.findings(pa.array(lines))}
    least, model.least = model.least, 0.0
    every = {x[0]: x[2] for x in model.findings(pa.array(lines))}
    model.least = least
    assert got == every and got


@pytest.mark.parametrize("mark", ["", "# ", " * ", "// "])
@pytest.mark.parametrize("width", [50, 72])
def test_wrapped_notices(model, rng, mark, width):
    for family in ("GPL-3.0", "GPL-2.0", "BSD", "ISC", "MPL-2.0", "LGPL", "MIT"):
        notice = max(licenses.TEMPLATES[family], key=len)
        body = textwrap.wrap(notice, width)
        text = "\n".join([prose(rng, 30), "", *(mark + x for x in body), mark.rstrip(), prose(rng, 30)])
        got = model.findings(pa.array([prose(rng, 20), text]))
        assert {x[2] for x in got} == {family} and all(x[0] == 1 and 2 <= x[1] < 2 + len(body) for x in got), (family, got)
        if family in ("GPL-3.0", "ISC", "MPL-2.0"):
            assert [x[1] for x in got] == [2], got


def test_calibration_holds_out_whole_notices(model):
    """No altered copy of a notice is scored by a model that has seen another one of it."""
    seen, real = [], licenses._descend
    try:
        licenses._descend = lambda have, y, times, *rest: seen.append(times.sum()) or real(have, y, times, *rest[:-1], 1)
        licenses.fit([])
    finally:
        licenses._descend = real
    notices, talk = sum(map(len, licenses.TEMPLATES.values())), len(licenses.NO_NOTICE)
    assert len(seen) == licenses.FOLDS + 1 and seen[-1] == 24 * notices + 12 * talk
    for k, n in enumerate(seen[:-1]):
        assert seen[-1] - n == 24 * len(range(k, notices, licenses.FOLDS)) + 12 * len(range(k, talk, licenses.FOLDS))
    assert 0.25 <= model.temperature <= 4


def test_recall_of_planted_wrapped_notices(model):
    """Notices of 12 words or more at many widths and marks, with a word lost, within other text; clean texts beside them."""
    r = np.random.default_rng(8)
    found = total = 0
    for family, notices in licenses.TEMPLATES.items():
        for t in notices:
            if len(t.split()) < 12:
                continue
            for width in (36, 48, 60, 72, 80, 100):
                w = t.split()
                del w[int(r.integers(len(w)))]
                mark = str(r.choice(["", "# ", " * ", "// ", ";; ", "-- "]))
                text = "\n".join([prose(r, 40), "", *(mark + x for x in textwrap.wrap(" ".join(w), width)), "", prose(r, 60)])
                got = model.findings(pa.array([text, prose(r, 120)]))
                total += 1
                found += any(x[0] == 0 and x[2] == family for x in got)
                assert not [x for x in got if x[0] == 1]
    assert total >= 90 and found >= 0.9 * total  # some have lost the word that tells their family


def test_similarities_and_completeness_by_definition(model):
    """Containment from words counted by plain Python: what is reported holds enough, and lines that hold none never are."""
    pairs = lambda t: set(zip(w := re.findall(r"\w+", t.lower()), w[1:]))
    notices = [(f, t) for f, ts in licenses.TEMPLATES.items() for t in ts]
    df = collections.Counter(p for _, t in notices for p in pairs(t))
    weight = {p: 1 + math.log(len(notices) / n) for p, n in df.items()}
    held = lambda line, t: sum(weight[p] for p in pairs(t) & pairs(line)) / sum(weight[p] for p in pairs(t))
    r = np.random.default_rng(6)
    lines = []
    for _ in range(300):
        w = notices[int(r.integers(len(notices)))][1].split()
        a = int(r.integers(max(1, len(w) // 2)))
        lines.append(" ".join([*prose(r, int(r.integers(1, 8))).split(), *w[a : a + int(r.integers(2, 40))]]))
    got = {x[0]: x for x in model.findings(pa.array(lines))}
    assert len(got) >= 60
    for k, line in enumerate(lines):
        best = {f: max(held(line, t) for t in ts) for f, ts in licenses.TEMPLATES.items()}
        if k in got:
            _, _, family, probability, _, similarity = got[k]
            assert similarity == pytest.approx(best[family]) and similarity >= model.contained and probability >= model.confident
        elif max(best.values()) >= 0.999:  # a whole notice is missed only where two families share it
            assert sum(v >= 0.8 for v in best.values()) > 1


def test_scan(spark, rng, odd, none):
    rows = [(k, prose(rng, 40) + ("\nLicensed under the Apache License, Version 2.0." if k % 5 == 0 else ""), "en", "s", 0) for k in range(60)]
    out = licenses.scan(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(r.doc_id for r in out) == list(range(0, 60, 5)) and {r.family for r in out} == {"Apache-2.0"} and {r.paragraph for r in out} == {1}
    assert licenses.scan(odd).count() == 0 and licenses.scan(none).count() == 0
