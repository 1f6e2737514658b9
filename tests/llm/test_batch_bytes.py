"""The stages of the pipeline pass texts to Python in Arrow batches of bounded bytes, whatever the texts' length."""

import corpus_pipeline
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scoreloom.llm import common


@pytest.fixture(scope="module")
def long_texts(spark, tmp_path_factory):
    """1,500 texts of ten thousand characters in one file."""
    path = str(tmp_path_factory.mktemp("long"))
    words = F.expr("transform(sequence(1, 160), x -> concat(sha2(concat(doc_id, ':', x), 256), if(x % 8 = 0, '\\n', ' ')))")
    docs = spark.range(0, 1500, 1, 1).withColumnRenamed("id", "doc_id").withColumn("text", F.array_join(words, ""))
    docs.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars")).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, i % 2) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, "no such words")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.mark.parametrize("stage", ["toxicity", "line_dedup", "ngram_jaccard", "decontamination"])
def test_batches_of_long_texts_are_bounded(spark, long_texts, stage):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(batch)]), pa.array([batch.nbytes])], ["n", "bytes"])

    session = spark.newSession()  # what another stage has set is not seen
    docs = common.table(session, long_texts, "documents")
    kept = dict(corpus_pipeline.STAGES)[stage](session, docs, long_texts)
    found = kept.mapInArrow(sizes, "n long, bytes long").collect()
    assert sum(r["n"] for r in found) >= 1000  # some are toxic by their labels, the others stay
    assert max(r["bytes"] for r in found) < common.BATCH_BYTES + (64 << 10)


def test_a_bound_that_is_set_stays(spark):
    session = spark.newSession()
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    session.conf.set(name, "1000000")
    common.bound_batches(session)
    assert session.conf.get(name) == "1000000"
