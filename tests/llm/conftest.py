import random

import pytest


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdeimnorstu") for _ in range(rng.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Documents with copies, near copies, shared passages, repeated lines, odd and empty ones: (doc_id, text, lang, source)."""
    rng = random.Random(5)
    base = [sentence(rng, rng.randint(30, 160)) for _ in range(30)]
    passage = sentence(rng, 60)
    line = sentence(rng, 12)
    out = list(base)
    out += [base[0], base[0], base[1]]
    for k in (2, 3, 4):  # near copies: one word changed
        w = base[k].split()
        w[len(w) // 2] = "changedword"
        out.append(" ".join(w))
    out += [f"{sentence(rng, 40)} {passage} {sentence(rng, 30)}" for _ in range(4)]
    out += [f"{line}\n{sentence(rng, 25)}\n{line}" for _ in range(5)]
    out += ["a " * 200, "x y " * 90, "", None, " \n\t ", "word", "one two three", "Ünïcödé ßtraße 数据 " * 10, "&amp; <|x|> " * 5]
    out += ["#$%&| " * 40 + sentence(rng, 30)]
    return [(i, t, "en" if i % 2 else None, f"src{i % 3}") for i, t in enumerate(out)]


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The documents with extra columns whose names the operators use too, and one row twice."""
    rows = [(*r, len(r[1] or ""), "k", 7) for r in [*texts, texts[5]]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, n long").repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("false")
