import duckdb
import pytest

import corpus_pipeline
from quern.llm import queries
from tests.llm.data import docs, texts
from tests.llm.test_dedup import brute_components
from tests.llm.test_text_ops import ENCODING, brute_alignments, brute_base, brute_kept


def test_stages_by_brute_force(spark, tmp_path):
    """Every stage against its brute-force version, on awkward documents and items taken from some of them."""
    rows = [(i, t) for i, t in texts() if i != 1 or t]
    long = [t for _, t in rows if t and len(t.split()) > 80]
    items = [(1, " ".join(long[0].split()[10:30])), (2, " ".join(long[1].split()[5:40]).upper()), (3, "no document holds these words in this order at all"), (4, None)]
    sf_dir = str(tmp_path)
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{sf_dir}/benchmark.parquet")
    df = docs(spark, rows)
    kept = corpus_pipeline.keep_quality(spark, df, sf_dir)
    by_id = lambda found: sorted(found, key=str)
    assert by_id(r.doc_id for r in kept.collect()) == by_id(i for i, t in rows if brute_kept(t))
    texts_of = [(r.doc_id, r.text) for r in kept.collect()]
    single = corpus_pipeline.drop_near_duplicates(spark, kept, sf_dir)
    want = {i for i, c in brute_components(texts_of, 5, 80).items() if i == c}
    assert {r.doc_id for r in single.collect() if r.doc_id is not None} == want
    clean = corpus_pipeline.drop_benchmark_leaks(spark, single, sf_dir)
    assert clean.columns == df.columns
    left = [(r.doc_id, r.text) for r in single.collect()]
    leaks = {i for i, _ in brute_alignments(left, items)}
    assert leaks and {r.doc_id for r in clean.collect()} == {i for i, _ in left} - leaks
    blank = corpus_pipeline.blank_secrets(spark, clean, sf_dir)
    assert all(not brute_base(r.text) for r in blank.collect())
    out = {r.doc_id: list(r.ids) for r in corpus_pipeline.tokens(spark, blank, sf_dir).collect()}
    assert all(out[r.doc_id] == ENCODING.encode_ordinary(r.text) for r in blank.collect())


def test_run_drops_planted_leaks(spark, sf_dir):
    leaked = {r.doc_id for r in queries.op3_decontaminate(spark, sf_dir).collect()}
    got = {r.doc_id for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert leaked and not leaked & got and len(got) > 50


def test_empty_documents(spark, sf_dir):
    frame = docs(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, sf_dir)
    assert frame.count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, sf_dir, name):
    db = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = queries.QUERIES[name](spark, sf_dir).toPandas()
    want = db.execute(queries.ORACLES[name]).df()[list(got.columns)]
    key = lambda f: sorted(map(str, f.astype(object).where(f.notna(), None).itertuples(index=False, name=None)))
    assert key(got) == key(want)
