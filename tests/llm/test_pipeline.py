import corpus_pipeline
from codeloom.llm import queries
from tests.llm.helpers import DOCS, EDGE, write
from tests.llm.test_models import documents
from tests.llm.test_tokens_and_wavelet import check_sequences


def test_stages_act_on_what_their_predecessors_kept(spark, tmp_path):
    clean = documents(200, 11)
    item = " ".join(f"bench{k}" for k in range(20))
    junk = (9001, "BUY!! NOW!! CHEAP!! PILLS!! " * 20, *EDGE[0][2:])
    copy = (9002, clean[0][1], *clean[0][2:])
    longer = max((c[1] for c in clean), key=len)
    leak = (9003, longer[: len(longer) // 2] + " und the le " + longer[len(longer) // 2 :] + " " + item, *clean[1][2:])
    rows = [*clean, junk, copy, leak, *EDGE]
    write(spark.createDataFrame(rows, DOCS), tmp_path, "documents")
    write(spark.createDataFrame([(c[0], 1, 0) for c in clean[:100]], "doc_id long, quality int, toxic int"), tmp_path, "labels")
    write(spark.createDataFrame([(1, item)], "item_id long, text string"), tmp_path, "benchmark")
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append({r.doc_id for r in docs.select("doc_id").collect()})
    assert 9001 not in seen[0] and {1, 2, 3}.isdisjoint(seen[0])
    assert {9002, 9003} <= seen[1] and 7 not in seen[1]
    assert 9002 not in seen[2] and 6 not in seen[2] and 9003 in seen[2]
    assert 9003 not in seen[3]
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in rows} == seen[3]
    check_sequences(rows, 2048)
    assert len(corpus_pipeline.STAGES) == 5 and len(queries.QUERIES) == 13
