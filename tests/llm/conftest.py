from __future__ import annotations

import random

import pytest

WORDS = [a + b for a in ("th", "re", "on", "er", "st", "in", "qu", "él") for b in ("a", "en", "ing", "tion", "ly", "és", "or")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(random_, n):
    words = [random_.choice(WORDS) for _ in range(n)]
    return " ".join(w + random_.choice(["", "", "", ",", ".", ".\n"]) for w in words)


def rows():
    """Ordinary texts, copies, near copies, shared passages and lines, and every odd case."""
    r = random.Random(5)
    texts = [prose(r, r.choice([3, 15, 40, 90, 400])) for _ in range(60)]
    passage, lines = prose(r, 60).replace("\n", " "), "\n".join(prose(r, 6).replace("\n", " ") for _ in range(4))
    texts += [texts[0], texts[3], texts[3].replace("a", "o", 1)]
    texts += [prose(r, 20) + " " + passage + " " + prose(r, 20) for _ in range(4)] + [passage + " " + passage]
    texts += [prose(r, 10) + "\n" + lines + "\n" + prose(r, 5) for _ in range(3)] + [lines + "\n" + lines]
    texts += [prose(r, 6000), "x" * 70000, "be " * 300, "\n" * 40, " \t\n", "", None, "naïve ÉLAN\x0bß 日本語 😀 done", "<|endoftext|> plain", "a\r\nb", "   wide"]
    return [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def plain():
    return rows()


@pytest.fixture(scope="session")
def docs(spark, plain):
    made = spark.createDataFrame(plain, SCHEMA).repartition(5)
    return made.cache()


@pytest.fixture(scope="session")
def odd(spark, plain):
    """Repeated rows, one id with two texts, null ids and all nulls."""
    more = [plain[0], plain[0], (5, "other text under an old id " * 9, None, None, None), (None, plain[3][1], None, None, None), (None, None, None, None, None)]
    return spark.createDataFrame(plain + more, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
