from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng: random.Random, n: int, words: int = 400) -> list[str]:
    return [f"w{min(int(rng.paretovariate(0.6)), words)}" for _ in range(n)]


@pytest.fixture(scope="session")
def rows() -> list[tuple]:
    """Documents with copies, near copies, shared passages, nulls, empties, a very long text and repeated rows."""
    rng = random.Random(4)
    base = [prose(rng, rng.randint(20, 120), 4000) for _ in range(60)]
    passage = prose(rng, 40, 4000)
    texts: list[str | None] = [" ".join(b) for b in base]
    for b in base[:10]:
        near = list(b)
        near[rng.randrange(len(near))] = "changed"
        texts.append("\n".join(near))
    for b in base[10:16]:
        near = list(b)
        for _ in range(4):
            near[rng.randrange(len(near))] = f"x{rng.random()}"
        texts.append(" ".join(near))
    texts += [texts[3]] * 12 + [" ".join([*prose(rng, 30, 4000), *passage, *prose(rng, 9, 4000)]) for _ in range(8)]
    texts += [None, "", "   \t\n", "one", "ONE", "one two three four", "One two three FOUR", "a b c d e", "A b c d E f"]
    texts += [" ".join(prose(rng, 30_000, 50_000)), "ßé ñandú  x y " * 6, "x" * 5000 + " y", " ".join(["same"] * 300), " ".join(["same"] * 200)]
    out = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    out += [out[5], out[5]]  # repeated rows
    out.append((None, texts[0], "en", "s0", 1))
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    from pyspark.sql import functions as F

    # columns whose names clash with those that operators use inside
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for name in ("t", "n", "sid", "g", "rank", "salt", "class", "c", "k", "h", "base"):
        frame = frame.withColumn(name, F.lit("clash"))
    return frame


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
