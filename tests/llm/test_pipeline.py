"""The pipeline's stages on a small corpus with planted cases, and that columns of any name pass through."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from larkspur.llm.common import Scratch
from larkspur.llm.queries import TOKENIZERS

corpus_pipeline = pytest.importorskip("corpus_pipeline")
pytestmark = pytest.mark.skipif(not Path(TOKENIZERS).exists(), reason="no vocabularies here")


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    r = random.Random(9)
    text = lambda n: " ".join(f"w{r.randrange(3000)}" for _ in range(n))
    item = " ".join(f"item{i}" for i in range(14))
    clean = [text(120) for _ in range(150)]
    toxic = [f"{text(50)} vile{r.choice('abc')} vile{r.choice('abc')} {text(20)}" for _ in range(60)]
    near = [" ".join(["other" if k == 60 else w for k, w in enumerate(clean[i].split())]) for i in range(10)]
    leaked = [f"{text(60)} {item} {text(60)}" for _ in range(10)] + [item]
    texts = clean + toxic + clean[10:20] + near + leaked + [None, ""]
    where = tmp_path_factory.mktemp("tables")
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(i, 1, int(150 <= i < 210)) for i in range(0, 210, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return str(where), texts, item


def test_run(spark, corpus):
    where, texts, item = corpus
    got = {x.doc_id: x for x in corpus_pipeline.run(spark, where).collect()}
    assert not [i for i in got if 150 <= i < 210]  # toxic
    assert not [i for i in range(10, 20) if i in got] and all(i in got for i in range(210, 220))  # exact: the largest stays
    assert not [i for i in got if 220 <= i < 230] and all(i in got for i in range(10))  # near: the smallest stays
    assert 240 not in got and all(i in got and "item0" not in got[i].text for i in range(230, 240))  # benchmark
    assert all(i in got and got[i].text == texts[i] for i in range(20, 150))  # clean ones stay as they are
    assert all(x.decodes and x.n_pieces == len(x.ids) and x.n_chars == len(x.text) for x in got.values() if x.text)
    assert len([i for i in got if i > 240]) == 1  # of null and empty texts one stays


def test_extra_columns(spark, corpus):
    where, _, _ = corpus
    docs, scratch = spark.read.parquet(f"{where}/documents.parquet"), Scratch(spark, "extra")
    names = ["ids", "spans", "key", "a", "b", "component_id", "keep_id", "words", "h", "fp", "chunk"]
    docs = docs.select("*", *(F.lit(n).alias(n) for n in names))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.columns
        docs = scratch.save(f"s{k}", stage(spark, docs, where))
        assert set(before) <= set(docs.columns)
    assert docs.where("key = 'key' and fp = 'fp'").count() == docs.count() > 0


def test_empty_table(spark, corpus, tmp_path):
    where, _, _ = corpus
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{where}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
