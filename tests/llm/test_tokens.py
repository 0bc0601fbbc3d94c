import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from quadrat.llm import tokens

text = st.text(alphabet="ab Z9_.,é日ñ«\n", max_size=40)


def _python_words(s):
    out, word = [], ""
    for c in s.lower():
        if c == "日":
            out += [word] * bool(word) + [c]
            word = ""
        elif c.isalnum() or c == "_":
            word += c
        else:
            out += [word] * bool(word)
            word = ""
    return out + [word] * bool(word)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), text), max_size=6))
def test_words_and_shingles(texts):
    want = [_python_words(t or "") for t in texts]
    got, codes = [], []
    for a, b, buf, off in tokens.blocks(pa.array(texts, pa.string())):
        w = tokens.words(buf, off)
        for d in range(b - a):
            s = slice(w.first[d], w.first[d + 1])
            got.append([bytes(buf[x:y]).decode() for x, y in zip(w.start[s], w.end[s])])
            codes.append(w.code[s].tolist())
        sh, first = tokens.shingles(w, 3)
        for d in range(b - a):
            ws = want[a + d]
            assert first[d + 1] - first[d] == (len(ws) - 2 if len(ws) >= 3 else min(len(ws), 1))
    assert got == want
    names = {}
    for ws, cs in zip(want, codes):
        for x, c in zip(ws, cs):
            assert names.setdefault(x, c) == c
    assert len(set(names.values())) == len(names)


def test_hashes_do_not_depend_on_the_block():
    texts = ["one two three four five", "six seven"]
    alone = [tokens.words(b, o).code.tolist() for t in texts for _, _, b, o in tokens.blocks(pa.array([t]))]
    buf, off = [(b, o) for _, _, b, o in tokens.blocks(pa.array(texts))][0]
    w = tokens.words(buf, off)
    assert [w.code[w.first[k] : w.first[k + 1]].tolist() for k in (0, 1)] == alone


def test_gear_depends_on_32_bytes():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 256, 300, np.uint8), rng.integers(0, 256, 300, np.uint8)
    b[100:] = a[100:]
    ga, gb = tokens.gear(a), tokens.gear(b)
    assert (ga[131:] == gb[131:]).all() and (ga[32:115] != gb[32:115]).any() and ga[110] != gb[110]
    want = 0
    for k in range(32):
        want += int(tokens._GEAR[a[200 - k]]) << k
    assert ga[200] == want % 2**32
