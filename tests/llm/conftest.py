import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    def make(texts, ids=None, **extra):
        ids = range(len(texts)) if ids is None else ids
        rows = [(i, t, *(v[k] for v in extra.values())) for k, (i, t) in enumerate(zip(ids, texts))]
        return spark.createDataFrame(rows, "doc_id long, text string" + "".join(f", {n} string" for n in extra))

    return make
