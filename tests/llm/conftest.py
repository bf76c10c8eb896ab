import random

import pytest
from pyspark import cloudpickle

import llm
import stackleaf

cloudpickle.register_pickle_by_value(stackleaf)
cloudpickle.register_pickle_by_value(llm)

DOCS = "doc_id long, text string, lang string, source string, row string, c long, k long, g string, at int"


@pytest.fixture(scope="session")
def frame(spark):
    """A table of documents with further columns whose names the operators use inside."""

    def make(rows):
        full = [(i, t, "en", "s0", "row", 1, 2, "g", 3) for i, t in rows]
        return spark.createDataFrame(full, DOCS)

    return make


def thue_morse(size):
    """Two words of ``size`` letters that a polynomial modulo 2**64 can't tell apart from 1,024 on."""
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(size))
    return one, one.translate(str.maketrans("ab", "ba"))


@pytest.fixture(scope="session")
def corpus():
    """Texts with copies, near copies, shared passages, odd blanks, nulls, long words and a long text."""
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 8))) for _ in range(400)]

    def words(n):
        return [rng.choice(vocabulary) for _ in range(n)]

    passage, base = words(70), words(120)
    rows = []
    for i in range(40):
        own = words(rng.randrange(1, 150))
        if i % 5 == 0:
            own[len(own) // 2 : len(own) // 2] = passage
        rows.append((i, " ".join(own)))
    for i in range(40, 60):
        own = list(base)
        for _ in range(rng.randrange(5)):
            own[rng.randrange(len(own))] = rng.choice(vocabulary)
        rows.append((i, "\n".join(own) if i % 2 else " ".join(own).title()))
    rows += [(60 + i, rows[7][1]) for i in range(5)]
    rows += [(70, None), (71, ""), (72, " \t\n "), (73, "one two"), (74, "ONE two"), (75, "é è \x0b ü"), (76, "a b a b a b " * 3000)]
    for i, size in ((90, 1024), (92, 4096)):
        one, two = thue_morse(size)
        rows += [(i, f"{one} plain " * 30), (i + 1, f"{two} plain " * 30)]
    rows += [(94, "{0} x y {1} x y".format(*thue_morse(1024)))]
    rows += [(77, " ".join(words(4000) + passage)), (None, rows[0][1]), (None, "lonely words without any id"), (3, rows[3][1])]
    return rows


@pytest.fixture(scope="session")
def empty(frame):
    return frame([(0, "x")]).limit(0)
