import pytest

WORDS = "the of and river stone paper window garden lamp quiet morning letter bridge cloud market forest engine silver ocean winter".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, row string, h long"


def prose(seed: int, n: int) -> str:
    import random

    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + (f"{rng.randrange(400)}" if rng.random() < 0.4 else "") + ("." if rng.random() < 0.1 else "") for _ in range(n))


def awkward() -> list[tuple]:
    """Nulls everywhere, empty, blank and long texts, copies, near copies, shared passages, repeated ids, odd characters."""
    passage = prose(99, 70)
    texts = [
        None, "", "   \n\t ", "word", prose(1, 300), prose(1, 300), prose(1, 300).replace("river", "brook", 1), prose(2, 40) + "\n" + passage + "\n" + prose(3, 40), prose(4, 60) + "\n" + passage + "\n" + prose(5, 30),
        "same line here\n" * 200, "Und " * 500, "äöü ß 漢字かな 🙂 ‍ <|endoftext|> it's 12345    x​", prose(6, 4000), "ABC!! DEF!! " * 50, "a\x0bb\x0cc\rd\n\n\ne", "x" * 5000, prose(7, 9), prose(8, 200),
    ]
    rows = [(k, t, "en" if k % 4 else None, None if k == 3 else f"s{k % 3}", len(t or ""), "k", "r", 1) for k, t in enumerate(texts)]
    rows.append((17, prose(8, 200), "en", "s1", 0, "k", "r", 1))  # a repeated row
    rows.append((None, prose(9, 50), "en", "s1", 0, None, None, None))
    return rows


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(awkward(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
