import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LETTERS = {"aa": "abcdefghi", "zz": "mnopqrstu"}


def prose(rng, words, lang="aa"):
    return " ".join("".join(rng.choices(LETTERS[lang], k=rng.randint(2, 7))) for _ in range(words))


@pytest.fixture(scope="session")
def cases(spark):
    """Documents with nulls, empties, a long text, copies, near copies, shared passages,
    repeated rows and columns whose names could clash."""
    rng = random.Random(4)
    texts = [None, "", " \n\t ", "one", "one", "12 34 !?", "naïve café — ☃"]
    base = prose(rng, 120)
    passage = prose(rng, 60)
    for k in range(8):
        near = base.split()
        near[k * 7] = f"edit{k}"
        texts += [base, " ".join(near)]
    texts += [prose(rng, 40) + "\n" + passage + "\n" + prose(rng, 30) for _ in range(6)]
    texts += [prose(rng, 25) + f"\nposted on this day by {w} at 10:{k}\n" + prose(rng, 25)
              for k, w in enumerate(prose(rng, 14).split())]
    texts += [prose(rng, rng.randint(1, 90), "zz") for _ in range(20)]
    texts += [prose(rng, 6000), "ab " * 300, "x" * 500, "#$%&* " * 40 + prose(rng, 60)]
    rows = [(k, t, (None if k % 11 == 0 else "zz" if t and any(c in "mnopqrstu" for c in t[:4]) else "aa"),
             None if k % 13 == 0 else f"s{k % 4}", k) for k, t in enumerate(texts)]
    rows += [rows[8], rows[8], rows[0]]
    return rows


@pytest.fixture(scope="session")
def docs(spark, cases, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("llm") / "documents")
    spark.createDataFrame(cases, SCHEMA).selectExpr("*", "1 AS _n", "'x' AS key", "2 AS gram").write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def none(docs):
    return docs.where("doc_id < 0")
