import numpy as np
import pytest

from quadrat.llm import threads

from .conftest import prose

MESSAGES = "conv_id long, turn long, role string, text string"


def test_levels_and_introductions():
    text = "Hi.\n\nOn Monday, A wrote:\n> one\n> > two\n>> three\n>\n> four\nBye."
    assert threads.passages(text) == [(0, "Hi.\n"), (1, "one"), (2, "two\nthree"), (1, "four"), (0, "Bye.")]
    own, _, quoted = threads.split(text)
    assert own == "Hi.\nBye." and {level for level, _ in quoted} == {1, 2}
    assert threads.split("a > b\nc")[0] == "a > b\nc" and threads.split("")[0] == ""


def test_normalisation_ignores_wrapping_case_and_signs():
    assert threads.sentences("The quick,  brown\nfox! Yes.") == threads.sentences("the QUICK brown fox. yes")
    assert threads.sentences(" ... ") == []


def _conversation(rng, conv, n):
    """Messages that quote a random earlier one, nested as deep as that one quoted; the true parents."""
    own = [prose(rng, 12) + " " + prose(rng, 9) for _ in range(n)]
    parent = [None] + [int(rng.integers(0, k)) for k in range(1, n)]
    rows = []
    for k in range(n):
        lines, level, p = [], 1, parent[k]
        while p is not None and level < 4:
            w = own[p].split(" ")
            half = len(w) // 2
            lines += [">" * level + " " + " ".join(w[:half]), ">" * level + " " + " ".join(w[half:])]
            level, p = level + 1, parent[p]
        rows.append((conv, k, "user" if k % 2 else "assistant", "\n".join([f"On day {k} X wrote:", *lines, own[k]]) if lines else own[k]))
    return rows, parent, own


def _order(parent):
    out = []

    def visit(k, depth):
        out.append((k, depth))
        for c in range(len(parent)):
            if parent[c] == k:
                visit(c, depth + 1)

    visit(0, 0)
    return out


def test_replies_against_the_true_tree(spark, rng):
    rows, truth = [], {}
    for conv in range(6):
        r, parent, own = _conversation(rng, conv, int(rng.integers(2, 12)))
        rows += r
        truth[conv] = (parent, own)
    out = threads.conversations(spark.createDataFrame([rows[k] for k in rng.permutation(len(rows))], MESSAGES)).collect()
    for conv, (parent, own) in truth.items():
        got = sorted((r for r in out if r.conv_id == conv), key=lambda r: r.position)
        assert [(r.turn, r.depth) for r in got] == _order(parent)
        assert all(r.reply_to == parent[r.turn] and r.text == own[r.turn] for r in got)


def test_without_quotes_turns_stay_in_order(spark):
    df = spark.createDataFrame([(1, 5, "b", "y"), (1, 2, "a", "x"), (1, 9, "c", "z")], MESSAGES)
    out = threads.conversations(df)
    assert [(r.turn, r.reply_to, r.depth) for r in out.orderBy("position").collect()] == [(2, None, 0), (5, 2, 1), (9, 5, 2)]
    assert threads.rendered(out).first().chat == "<|a|>\nx<|end|>\n<|b|>\ny<|end|>\n<|c|>\nz<|end|>\n"


def test_odd_rows(spark):
    rows = [(None, 1, "u", "x"), (1, None, "u", "x"), (1, 0, "u", None), (1, 1, None, ""), (1, 2, "u", "> gone"), (1, 3, "u", "same"), (1, 3, "u", "same"), (1, 4, "z", "b"), (1, 4, "a", "c"), (2, 0, "u", "w " * 200_000)]
    df = spark.createDataFrame([(*r, "e", 1, 2) for r in rows], f"{MESSAGES}, h string, k long, own long")
    out = threads.conversations(df)
    got = [(r.conv_id, r.turn, r.role, r.text if r.conv_id == 1 else None) for r in out.orderBy("conv_id", "position").collect()]
    assert got == [(1, 0, "u", None), (1, 1, None, ""), (1, 2, "u", ""), (1, 3, "u", "same"), (1, 4, "a", "c"), (2, 0, "u", None)]
    assert threads.rendered(out).count() == 2
    assert threads.conversations(spark.createDataFrame([], MESSAGES)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 30])
def test_reply_order_is_a_preorder(n):
    rng = np.random.default_rng(n)
    to = [None if rng.random() < 0.4 else int(rng.integers(0, k)) * 10 for k in range(n) if k] if n else []
    to = ([None] + to)[:n]
    out = threads.reply_order([k * 10 for k in range(n)], to)
    assert sorted(k for k, _, _ in out) == list(range(n))
    place = {k * 10: i for i, (k, _, _) in enumerate(out)}
    for i, (k, p, depth) in enumerate(out):
        assert p is None or place[p] < i and all(out[x][2] >= depth for x in range(place[p] + 1, i))


def test_a_long_conversation_with_repeated_sentences(spark, rng):
    """2,000 messages, each of which quotes an earlier one among answers that all are alike."""
    own = [prose(rng, 8) for _ in range(2000)]
    parent = [None] + [int(rng.integers(0, k)) for k in range(1, 2000)]
    rows = [(1, k, "u", f"> {own[parent[k]]}\n> Yes.\n{own[k]} Yes." if k else f"{own[0]} Yes.") for k in range(2000)]
    out = {r.turn: r for r in threads.conversations(spark.createDataFrame(rows, MESSAGES)).collect()}
    assert len(out) == 2000 and all(out[k].reply_to == parent[k] and out[k].text == f"{own[k]} Yes." for k in range(2000))
    assert sorted(r.position for r in out.values()) == list(range(2000))
