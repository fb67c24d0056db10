import corpus_pipeline as cp
from pressroom.llm import chosen_path, templates
from tests.llm.test_near import brute


def test_stages_against_brute_force(spark, sf_dir):
    """Each stage on what the one before it kept, at the smallest size."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    kept = {i: r.text for i, r in rows.items() if any(c.isalpha() for c in r.text or "")}
    best = {}
    for i, t in kept.items():
        key = t.encode().lower()
        best[key] = max(i, best.get(key, i))
    kept = {i: kept[i] for i in best.values()}
    kept = {i: kept[i] for i, _, _, keep in brute(list(kept.items()), chosen_path.WIDTH) if keep}
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    words = lambda t: " ".join("".join(c if c.isalnum() else " " for c in t.lower()).split())
    kept = {i: t for i, t in kept.items() if not any(words(x) in words(t) for x in items)}
    got = {r.doc_id: r.n_tokens for r in cp.run(spark, sf_dir).collect()}
    assert set(got) == set(kept)
    assert all(n == len(kept[i].encode().split()) + 1 for i, n in got.items())


def test_stages_on_odd_rows(spark, docs, no_docs, sf_dir):
    for start in (docs, no_docs):
        at = start
        for name, stage in cp.STAGES[:-1]:
            at = stage(spark, at, sf_dir)
            assert at.columns == start.columns, name
        assert cp.STAGES[-1][1](spark, at, sf_dir).count() == at.count()
