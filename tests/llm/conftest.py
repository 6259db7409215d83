import random

import pytest

WORDS = "the and of to in is that with for was on are by this be it as at from or an have not but what all were when we there".split()


def prose(rng: random.Random, n: int) -> str:
    syllables = ["ka", "to", "ri", "mu", "ne", "so", "la", "vi", "de", "pa"]
    return " ".join(rng.choice(WORDS) if rng.random() < 0.4 else "".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_texts():
    """Texts that often break things: null, empty, spaces, one word, long runs, other scripts, a very long text."""
    rng = random.Random(7)
    return [None, "", "   \t\n", "word", "a" * 3000, "éè 中文 \U0001f389\U0001f389", "x\u0000y  z", prose(rng, 6000), "Same SAME same", "1" * 500]


@pytest.fixture(scope="session")
def corpus(odd_texts):
    """(doc_id, text): prose with exact copies, near copies, shared passages, and the odd texts."""
    rng = random.Random(3)
    rows, base = [], [prose(rng, rng.randint(40, 220)) for _ in range(25)]
    passage = prose(rng, 60)
    for t in base:
        rows.append(t)
    for _ in range(20):
        words = rng.choice(base).split()
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = "changed"
        rows.append(" ".join(words))
    for _ in range(15):
        words = prose(rng, 50).split()
        at = rng.randrange(50)
        rows.append(" ".join(words[:at]) + " " + passage + " " + " ".join(words[at:]))
    rows += [base[0], base[0].upper(), base[1] + " "]
    rng.shuffle(rows)
    return list(enumerate(rows + odd_texts))


@pytest.fixture(scope="session")
def documents(spark, corpus):
    """The corpus as a table with more columns, some of names that operators use inside, and a null id."""
    rows = [(i, t, None if i % 3 == 0 else "en", f"src{i % 4}", None if t is None else len(t), "k", 1.5) for i, t in corpus]
    rows.append((None, "a row without an id " * 20, "en", "src0", 5, None, None))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, words double").repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
