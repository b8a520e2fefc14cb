from __future__ import annotations

import re
from collections import Counter

import pytest

import corpus_pipeline
from trackloom.llm.pii import base_spans
from trackloom.llm.tokens import encode, vocabulary_path

from test_text_operators import brute_components, shingles

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES:
        path = corpus_pipeline.written(stage(spark, out[-1][1], DATA), "test")[1]
        out.append((name, spark.read.parquet(path)))
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns_are_kept(stages):
    assert [n for n, _ in stages[1:]] == ["toxicity", "near copies", "decontamination", "personal data", "packing"]
    for _, df in stages[1:-1]:
        assert df.columns == stages[0][1].columns


def test_toxic_documents_go(spark, stages):
    before, after = texts(stages[0][1]), texts(stages[1][1])
    toxic = {r.doc_id for r in spark.read.parquet(f"{DATA}/labels.parquet").where("toxic = 1").collect()}
    gone = set(before) - set(after)
    assert set(after) < set(before) and len(gone & toxic) >= 0.6 * len(toxic)
    clean = {r.doc_id for r in spark.read.parquet(f"{DATA}/labels.parquet").where("toxic = 0").collect()}
    assert len(gone & clean) <= 0.02 * len(clean)


def test_one_of_each_group_stays(stages):
    rows = [tuple(r) for r in stages[1][1].select("doc_id", "text").collect()]
    want = {i for i, _, c in brute_components(rows) if i == c}
    assert set(texts(stages[2][1])) == want


def test_contaminated_documents_go(spark, stages):
    items = [shingles((r.text or "").lower()) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    before, after = texts(stages[2][1]), texts(stages[3][1])
    bad = {i for i, t in before.items() if any(q and 100 * len(q & shingles((t or "").lower())) >= 80 * len(q) for q in items)}
    assert set(after) == set(before) - bad


def test_personal_data_is_masked(stages):
    before, after = texts(stages[3][1]), texts(stages[4][1])
    assert set(before) == set(after)
    for i, t in before.items():
        spans = base_spans(t or "")
        assert len(re.findall(r"\[(?:EMAIL|IP|CARD|PHONE)\]", after[i])) >= bool(spans)
        if not spans:
            assert after[i] == t or "[" in after[i]
        assert not base_spans(after[i])
    for r in stages[4][1].collect():
        assert r.n_chars == len(r.text)


def test_all_of_it_is_packed(stages):
    got = Counter()
    for r in stages[5][1].collect():
        got[r.doc_id] += r.length
    path = vocabulary_path()
    assert got == {i: len(encode(t or "", path)) + 1 for i, t in texts(stages[4][1]).items()}


@pytest.fixture(scope="module")
def odd(spark, docs):
    """Nulls, empties, a very long text, repeated rows, null and repeated ids, and columns named as operators name theirs."""
    from pyspark.sql import functions as F

    again = docs.where("doc_id in (20, 21)").withColumn("doc_id", F.lit(None).cast("long"))
    other = docs.where("doc_id = 22").withColumn("doc_id", F.lit(7).cast("long"))
    nothing = docs.where("doc_id = 30").withColumns({c: F.lit(None).cast(t) for c, t in docs.dtypes})
    out = docs.unionByName(again).unionByName(other).unionByName(nothing)
    names = ("added", "masked", "score", "predicted", "evidence_ids", "component_id", "n_shingles", "row", "key", "_row", "__key", "Masked_", "start")
    return out.select("*", *[F.concat(F.lit(f"{c} "), F.col("doc_id").cast("string")).alias(c) for c in names])


@pytest.fixture(scope="module")
def tables(spark, rows, tmp_path_factory):
    """Labels and items made for these documents: one text and its copies are toxic, and the words of another are an item."""
    where = str(tmp_path_factory.mktemp("tables"))
    by_id = {i: t for i, t, *_ in rows}
    spark.createDataFrame([(i, 0, int(by_id[i] == by_id[3])) for i in range(100) if i != 7], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    items = [(1, " ".join((by_id[21] or "").split()[:12])), (2, None), (3, "")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return where


def all_rows(df):
    return Counter(tuple(r) for r in df.collect())


def test_stages_of_odd_rows(spark, odd, tables):
    from pyspark.sql import functions as F
    from trackloom.llm.toxicity import score_toxicity

    before = all_rows(odd)
    kept = all_rows(corpus_pipeline.drop_toxic(spark, odd, tables))
    scored = score_toxicity(odd, spark.read.parquet(f"{tables}/labels.parquet"), ~corpus_pipeline.held_out()).where("predicted = 1").select("doc_id").collect()
    assert not kept - before and sum((before - kept).values()) == len(scored) > 10

    kept = all_rows(corpus_pipeline.keep_one_of_each_group(spark, odd, tables))
    order = sorted(before.elements(), key=lambda r: (r[0] is None, r[0] or 0))
    sets = [shingles(r[1]) for r in order]
    group = list(range(len(order)))
    for a in range(len(order)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n) and group[a] != group[b]:
                low, high = sorted((group[a], group[b]))
                group = [low if g == high else g for g in group]
    stay = [k for k in range(len(order)) if group[k] == k]
    assert sum(kept.values()) == len(stay) and not kept - before
    assert Counter((r[0], shingles(r[1])) for r in kept.elements()) == Counter((order[k][0], sets[k]) for k in stay)

    kept = all_rows(corpus_pipeline.drop_contaminated(spark, odd, tables))
    item = shingles(" ".join(next(r[1] for r in order if r[0] == 21).split()[:12]).lower())
    bad = Counter(r for r in before.elements() if 100 * len(item & shingles((r[1] or "").lower())) >= 80 * len(item))
    assert kept == before - bad and any(r[0] is None for r in bad)

    out = corpus_pipeline.mask_personal_data(spark, odd, tables)
    assert out.columns == odd.columns
    same = [c for c in odd.columns if c not in ("text", "n_chars")]
    assert all_rows(out.select(*same)) == all_rows(odd.select(*same))
    assert out.where(F.length("text") != F.col("n_chars")).count() == 0 and out.where("text is null").count() == odd.where("text is null").count()

    packed = corpus_pipeline.pack_sequences(spark, odd, tables)
    assert packed.where("start = 0").count() == sum(before.values())


def test_stages_of_empty_tables(spark, odd, tables):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.limit(0), tables).count() == 0, name
