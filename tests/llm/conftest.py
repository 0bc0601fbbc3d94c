import numpy as np
import pytest

SYLLABLES = "ka lo mi ne ru sa ti vo en ar st il om ud".split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return ["".join(rng.choice(SYLLABLES, rng.integers(1, 4))) for _ in range(n)]


def prose(rng, n):
    return " ".join(words(rng, n)) + "."


@pytest.fixture
def rng():
    return np.random.default_rng(17)


@pytest.fixture
def odd(spark):
    """Nulls in every column, empty and blank texts, repeated rows, a very long text, other scripts, clashing names."""
    long = " ".join(words(np.random.default_rng(1), 60_000))
    rows = [
        (1, "One plain text with a few words in it.", "en", "s", 1),
        (1, "One plain text with a few words in it.", "en", "s", 1),
        (2, None, None, None, None),
        (3, "", "en", "s", 0),
        (4, "   \n\t ", "en", "s", 6),
        (None, "A text without an id, all by itself here.", "en", None, None),
        (None, None, None, None, None),
        (5, long, "en", "s", len(long)),
        (6, "x" * 200_000, "en", "s", 200_000),
        (7, "日本語の文章です。 It has two scripts… «été» naïve", "ja", "s", 9),
        (8, "a", "en", "s", 1),
        (9, "> quoted\n>> twice\nMIT", "en", "s", 1),
    ]
    extra = "id long, t string, n long, key long, recipe string, `copy` string, leaked string, toxicity string, removed_id string, r string, score string, g string, h long, i string, w long, y string, x string, d0 long, part int, size long, page string, gone_id string, shared_id long, key0 string, first_id long, text_bytes string, file string, version string, shard int"
    return spark.createDataFrame([(*r, 1, "t", 2, 3, "a", "b", "c", "d", "e", "f", "g", "h", 1, "i", 2, "y", "x", 3, 4, 5, None, "p", 6, None, 7, "t", "f", "v", 8) for r in rows], f"{DOCS}, {extra}")


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], DOCS)
