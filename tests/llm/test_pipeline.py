"""The pipeline against a plain run of its rules, and the registration."""

import corpus_pipeline
import pyarrow as pa
from pyspark.sql import functions as F

import __spark_entry__ as driver
from tests.llm.test_bpe import Tokenizer
from tests.llm.test_containment import plain as plain_containment
from tests.llm.test_simhash import plain_classes, plain_fingerprint
from tillroll.llm import text, toxicity
from tillroll.llm.queries import BPE_VOCABULARY, learnable
from tillroll.llm.secrets import redact
from tillroll.llm.text import table

FOLDER = "/root/testdata/sf0.001"


def test_registered():
    names = [n for n in driver.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in driver.queries()


def test_against_plain_rules(spark):
    docs = table(spark, FOLDER, "documents")
    rows = sorted((r.asDict() for r in docs.collect()), key=lambda r: r["doc_id"])
    model = toxicity.fit(docs, table(spark, FOLDER, "labels"), learnable(3, 1))
    rows = [r for r in rows if model.scores([(r["text"] or "").encode()])[0][0] < corpus_pipeline.TOXIC]
    classes = plain_classes({r["doc_id"]: plain_fingerprint(r["text"]) for r in rows}, 4)
    rows = [r for r in rows if classes[r["doc_id"]] == r["doc_id"]]
    items = [(r.item_id, r.text) for r in table(spark, FOLDER, "benchmark").collect()]
    leaked = {d for d, *_ in plain_containment([(r["doc_id"], r["text"]) for r in rows], items)}
    rows = [r for r in rows if r["doc_id"] not in leaked]
    library = Tokenizer.from_file(BPE_VOCABULARY)
    expected = {r["doc_id"]: (redact(r["text"] or ""), library.encode(redact(r["text"] or "")).ids) for r in rows}
    got = corpus_pipeline.run(spark, FOLDER)
    assert got.columns[: len(docs.columns)] == docs.columns
    assert {r.doc_id: (r.text, r.token_ids) for r in got.collect()} == expected
    assert 0 < len(expected) < docs.count()


def test_stages_keep_columns(spark):
    docs = table(spark, FOLDER, "documents").withColumn("score", F.lit(1)).limit(40)
    for _, function in corpus_pipeline.STAGES[:-1]:
        assert function(spark, docs, FOLDER).columns == docs.columns


def test_a_batch_is_worked_off_in_stretches_of_bounded_size(spark):
    docs = spark.range(40, numPartitions=1).select("id", F.repeat(F.lit("ab "), 100_000).alias("text"))
    given = text.map_texts(docs, ["id", "text"], [("given", "bigint")], lambda t: [pa.array([sum(map(len, t))] * len(t), pa.int64())])
    assert {f.name for f in given.schema} == {"id", "text", "given"}
    rows = given.collect()
    assert sorted(r["id"] for r in rows) == list(range(40))
    assert max(r["given"] for r in rows) <= text.CHUNK
    assert all(r["text"] == "ab " * 100_000 for r in rows)
