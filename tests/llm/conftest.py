import random

import pytest


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 5))) for _ in range(n))


def sentences(rng: random.Random, n: int) -> str:
    return "\n".join(words(rng, rng.randint(3, 9)).capitalize() + ". " + words(rng, 4) + "." for _ in range(n))


@pytest.fixture(scope="session")
def hard_docs(spark):
    """Documents with nulls, empty and long texts, copies, a repeated row and clashing extra columns."""
    rng = random.Random(5)
    texts = [sentences(rng, rng.randint(1, 12)) for _ in range(40)]
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    near = texts[3].split(" ")
    near[2] = "changed"
    rows += [(500, texts[3]), (501, texts[3]), (502, " ".join(near)), (503, ""), (504, None), (505, "x"), (506, "Ünï 漢字 \U0001F600 😀😀 end"),
             (507, words(rng, 30_000)), (508, "y" * 200_000), (509, "\n\n \t \x0b\x0c\r"), (510, "A B C"), (511, "a b c"), (None, "no id here"), (512, "same row"), (512, "same row")]
    return [(d, t) for d, t in rows]


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = ", fingerprint string, size int, shard string, slot string, score string, fp int, key string, n_hit int, length string, spans int, next string, __b int"


@pytest.fixture(scope="session")
def docs(spark, hard_docs):
    rows = [(d, t, "en" if i % 2 else None, f"src{i % 3}", len(t or ""), "f", 1, "s", "t", "u", 7, "k", 3, "l", 2, "n", 9) for i, (d, t) in enumerate(hard_docs)]
    return spark.createDataFrame(rows, COLUMNS + EXTRA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], COLUMNS)
