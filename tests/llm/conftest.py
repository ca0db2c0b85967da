import pytest

DDL = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    def docs(texts, ids=None, **more):
        ids = range(len(texts)) if ids is None else ids
        return spark.createDataFrame([(i, t, "en", f"src{(i or 0) % 3}", len(t or "")) for i, t in zip(ids, texts)], DDL).repartition(2)

    return docs


@pytest.fixture(scope="session")
def odd_texts():
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()
    long = " ".join(words[i * i % 12] + str(i % 97) for i in range(5000))
    base = " ".join(words * 4)
    return [
        None, "", " \t\n", "one", "two words", base, base, base + " end", base.upper(), long, long + " tail", "a  \n\nb  c\x1c 　d 's  \r\né́", "\U0001f600 你好, don't!" * 3,
    ]
