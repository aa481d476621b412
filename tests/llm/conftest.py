import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, rep string"


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty and long texts, ties, copies, near copies, extra columns with clashing names."""
    r = random.Random(7)
    words = [f"w{k}" for k in range(300)] + ["The", "OF", "é", "naïve", "x1y2"]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    base = [text(r.randint(1, 80)) for _ in range(60)]
    line = "a line that many documents share, with Punctuation."
    rows = []
    for k in range(150):
        t = base[k % 60] if k % 3 else text(r.randint(0, 60))
        if k % 5 == 0:
            t = t + "\n  " + line + "\t\n" + text(5)
        if k % 7 == 0:
            w = t.split(" ")
            if len(w) > 40:
                w[3] = "changed"
            t = " ".join(w)
        rows.append((k, t))
    rows += [(200, None), (201, ""), (202, " \n\t "), (203, "one"), (204, "one"), (205, text(20000)), (206, "x" * 5000), (207, line), (208, "ein\nzwei\n\n")]
    return spark.createDataFrame([(i, t, "en", "s0", None if t is None else len(t), 1, "z") for i, t in rows], SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def odd_docs(docs, spark):
    """The same with repeated rows and rows without doc_id."""
    more = spark.createDataFrame([(None, "no id here at all, five words and more", None, None, None, None, None), (None, None, None, None, None, None, None), (203, "one", "en", "s0", 3, 1, "z"), (205, "another text under a known id", "en", "s0", 3, 1, "z")], SCHEMA)
    return docs.unionByName(more)


@pytest.fixture(scope="session")
def none(docs):
    return docs.where("false")
