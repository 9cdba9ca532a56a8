import random

import pytest

#: Columns that the operators name themselves, to clash with.
EXTRA = "size long, score double, node long, root long, h long, taken long, target double, hash string, spans string, source_size long"
#: Names that their inner columns have, or had.
EXTRA += "".join(f", {c} int" for c in "row no id digest n part copies cut cut_in rest of marks at start end live example owner __id __digest __n __score __text __row __spans __marks".split())
EXTRA += ", held boolean, class_id long, quality int"


def word(rng):
    return "".join(rng.choice("abcdeéghß") for _ in range(rng.randint(2, 7)))


def texts():
    rng = random.Random(5)
    vocabulary = [word(rng) for _ in range(300)] + ["the", "of", "and"] * 30
    fresh = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    base, passage = fresh(200), fresh(60)
    near = base[:100] + ["other"] + base[101:]
    return [
        (1, " ".join(base)), (2, " ".join(base)), (3, " ".join(near)), (3, " ".join(near)), (4, None), (5, ""), (6, ""), (7, "  \t\n "), (None, " ".join(base)), (None, None),
        (8, " ".join(fresh(30) + passage + fresh(30))), (9, "\n".join(fresh(10) + passage)), (10, "one two three"), (11, "one two three"), (12, "one  two three"),
        (13, " ".join(fresh(30_000))), (14, "x" * 50_000), (15, " ".join(["again"] * 400)), (16, " ".join(["again"] * 300)), (-3, " ".join(fresh(80) + passage[:49])),
        *((100 + i, " ".join(fresh(rng.randint(1, 120)))) for i in range(40)),
    ]


@pytest.fixture(scope="session")
def rows():
    return texts()


@pytest.fixture(scope="session")
def docs(spark, rows):
    out = [(i, t, [None, "a", "b", "ü"][n % 4] if n % 9 else "a", "en", None if t is None else len(t)) + (1, 1.0, 1, 1, 1, 1, 1.0, "x", "x", 1) + (7,) * 26 + (True, 3, 0) for n, (i, t) in enumerate(rows)]
    return spark.createDataFrame(out, "doc_id long, text string, source string, lang string, n_chars long, " + EXTRA).repartition(3)


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)
