import pytest

from emberlog.llm.ship import ship

SF = "/root/testdata/sf0.001"
SPACES = " \t\n\x0b\x0c\r"

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use themselves.
CLASHES = "row string, block long, fp long, kept string, n_words string, ids long, m string"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship(spark)


def texts_of(*texts):
    """Document rows with ids from 1 up."""
    return [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts, start=1)]


@pytest.fixture(scope="session")
def document(spark):
    def make(rows):
        return spark.createDataFrame(rows, DOCUMENT)

    return make


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows and clashing columns."""
    words = " ".join(f"w{k * k % 977}" for k in range(30_000))
    rows = [
        (1, None, None, None, None),
        (2, "", "en", "s", 0),
        (None, "a text without an id stands here for once and for all", "en", None, 3),
        (3, "the same row stands here twice and is no other than itself", "en", "s", 9),
        (3, "the same row stands here twice and is no other than itself", "en", "s", 9),
        (4, words, "xx", "s", len(words)),
        (5, " \n\t ", None, "s", 4),
        (6, "ÄÖ ü 漢字 😀", "de", "s", 10),
    ]
    rows = [(*r, "x", 7, 7, "no", "many", 5, None) for r in rows]
    return spark.createDataFrame(rows, f"{DOCUMENT}, {CLASHES}")


@pytest.fixture(scope="session")
def all_words():
    """Words split at ASCII white space."""

    def split(text):
        for space in SPACES:
            text = (text or "").replace(space, " ")
        return [w for w in text.split(" ") if w]

    return split


def ascii_lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture(scope="session")
def lower():
    return ascii_lower
