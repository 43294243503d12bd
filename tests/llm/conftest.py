import random

import pytest

WORDS = "the of and to in is that for was on are with as his they be at one have this from or had by hot but some what there we can out other were all your when up use word how said an each she which do their time if will way about many then them would write like so these her long make thing see him two has look more day could go come did my sound no most number who over know water than call first people may down side been now find".split()
AWKWARD = [(None, "no id at all here now"), (901, None), (902, ""), (903, "   \n\t "), (904, "one"), (905, "Ünï cödé — 東京 3½"), (906, "x" * 30_000), (907, "a b " * 9_000), (908, "tie tie tie tie tie tie"), (908, "tie tie tie tie tie tie"), (908, "another text of the same id")]


@pytest.fixture(scope="session")
def prose():
    rng = random.Random(11)
    return lambda n: " ".join(rng.choice(WORDS) + (str(rng.randrange(40)) if rng.random() < 0.4 else "") for _ in range(n))


@pytest.fixture(scope="session")
def corpus(spark, prose):
    """(rows, DataFrame): prose, near copies, shared passages, and awkward rows; with columns of clashing names."""
    rng = random.Random(12)
    rows = [(i, prose(rng.randrange(20, 160))) for i in range(60)]
    for i in range(60, 100):
        words = rows[rng.randrange(60)][1].split()
        for _ in range(rng.randrange(0, 6)):
            words[rng.randrange(len(words))] = rng.choice(WORDS)
        rows.append((i, " ".join(words)))
    shared = prose(60)
    rows += [(100 + i, prose(15) + " " + shared + " " + prose(15)) for i in range(12)]
    rows += AWKWARD
    df = spark.createDataFrame([(d, t, "en" if d is None or d % 2 else "xx", "src", None if t is None else len(t), 0.5, "k", 1) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long, score double, key string, n long")
    return rows, df


@pytest.fixture(scope="session")
def empty(corpus):
    return corpus[1].limit(0)
