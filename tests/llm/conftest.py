import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, failures long, node string, hash string"
WORDS = "the quick brown fox jumps over a lazy dog while nine small birds sing about rain and wind near old stone walls today".split()


def prose(n: int, seed: int) -> str:
    """n words, other ones for other seeds."""
    return " ".join(f"{WORDS[(i * 7 + seed * 13 + i * i * (seed + 1)) % len(WORDS)]}{(i * seed) % 17}" for i in range(n))


@pytest.fixture(scope="session")
def rows():
    """Nulls in any column, empty and long texts, repeats, ties and white space of all kinds."""
    texts = [None, "", " \t\n\x0b\x0c\r ", "one", "Two  words", prose(30, 1), prose(30, 1).upper(), prose(400, 2), prose(400, 2) + " end", prose(25, 3) + "\n" + prose(25, 3) + "\n\n x", "é " * 40, "a b c d e f g h " * 9, " non breaking space \x1c x", prose(30_000, 4)]
    out = [(i * 3, t, "en", f"s{i % 3}" if i % 5 else None, 7, i, "n", "h") for i, t in enumerate(texts)]
    out += [out[5], out[5], (None, texts[5], None, None, None, None, None, None), (None, None, None, "s1", None, None, None, None), (6, texts[7], "en", "s1", 1, 1, "n", "h")]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, COLUMNS).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], COLUMNS)
