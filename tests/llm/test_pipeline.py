"""The pipeline's stages against plain versions of them, each on what its predecessor kept."""

import collections

import corpus_pipeline
import pytest

from millrace.llm import mixing, quality, queries, storage


def words(text):
    return (text or "").encode().lower().split()


@pytest.fixture(scope="module")
def stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(storage.stash(stage(spark, out[-1], small), "stage"))
    return out


def test_names_and_columns(stages):
    assert len(corpus_pipeline.STAGES) == 5
    assert all(s.columns == stages[0].columns for s in stages[:-1])


def test_quality_stage(spark, small, stages):
    model = quality.fit_quality(stages[0], spark.read.parquet(f"{small}/labels.parquet"))
    want = {r.doc_id for r in quality.score_quality(stages[0], model).collect() if r._quality >= 0.5}
    assert {r.doc_id for r in stages[1].collect()} == want and len(want) > 100


def test_near_dedup_stage(stages):
    rows = stages[1].collect()
    sets = {}
    for r in rows:
        w = words(r.text)
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if root[a] != root[b] and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    assert sorted(r.doc_id for r in stages[2].collect()) == sorted(i for i in root if root[i] == i)


def test_decontamination_stage(spark, small, stages):
    items = [b" ".join(words(r.text)) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    want = [r.doc_id for r in stages[2].collect() if not any(i in b" ".join(words(r.text)) for i in items)]
    assert sorted(r.doc_id for r in stages[3].collect()) == sorted(want)


def test_mixing_stage(stages):
    copies = {r.doc_id: r.copies for r in mixing.mix_sizes(stages[3], weight=mixing.equal).collect()}
    assert collections.Counter(r.doc_id for r in stages[4].collect()) == collections.Counter({i: n for i, n in copies.items() if n})


def test_sharding_stage(stages):
    rows, last = stages[4].collect(), stages[5].collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in last)
    slots = collections.defaultdict(list)
    for r in last:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and max(slots) <= 23


def test_run(spark, small, stages):
    key = lambda r: (r.doc_id, r.shard, r.slot)
    assert sorted(map(key, corpus_pipeline.run(spark, small).collect())) == sorted(map(key, stages[5].collect()))


def test_odd_rows_in_every_stage(spark, small, tmp_path):
    """Null ids, texts and sources, repeated rows, empty and very long texts, extra columns of clashing names; empty tables."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{small}/documents.parquet")
    item = spark.read.parquet(f"{small}/benchmark.parquet").orderBy("item_id").first().text
    other = spark.read.parquet(f"{small}/benchmark.parquet").orderBy(F.desc("item_id")).first().text
    base = [r.text for r in docs.where("lang = 'en' and n_chars > 800").orderBy("doc_id").limit(40).collect()]
    long = " ".join(base * 60)
    near = " ".join(base[0].split()[:200])
    rows = [
        (None, "null id, " + item, "en", "src1"), (10**6, item + " with an id", "en", None), (10**6, "one " + near, "en", "src1"), (10**6 + 1, None, None, None), (10**6 + 2, "", "en", "src2"), (10**6 + 2, "", "en", "src2"),
        (10**6 + 3, near + " x", "en", "src1"), (10**6 + 3, near + " x", "en", "src1"), (None, near + " y", "en", None), (None, near + " y", "en", None), (10**6 + 4, long, "de", "src3"), (None, None, None, None), (10**6 + 5, f"{base[1]} {other}", "fr", "src5"),
    ]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    clash = ["id", "_keep", "quality", "c0", "row", "digest", "g", "n", "size", "_copies", "shard", "part", "least", "t"]
    given = docs.unionByName(odd).withColumns({c: F.lit("clash") for c in clash}).repartition(3)
    stages = dict(corpus_pipeline.STAGES)
    key = lambda r: (r.doc_id, r.text, r.source)

    kept = stages["quality classifier"](spark, given, small)
    assert kept.columns == given.columns and not collections.Counter(map(key, kept.collect())) - collections.Counter(map(key, given.collect()))
    once = stages["MinHash near-dedup"](spark, given, small)
    left = collections.Counter(map(key, once.collect()))
    assert once.columns == given.columns and max(n for k, n in left.items() if k[1]) == 1
    assert left[10**6 + 2, "", "src2"] == 2 and left[None, None, None] == 1 and left[10**6 + 1, None, None] == 1
    assert sum(n for k, n in left.items() if k[1] and near[:500] in k[1] and len(k[1]) < 2 * len(near)) == 1  # one of the near copies, and no other
    clean = stages["benchmark decontamination"](spark, given, small)
    before, after = collections.Counter(map(key, given.collect())), collections.Counter(map(key, clean.collect()))
    gone = before - after
    assert clean.columns == given.columns and not after - before
    assert {k for k in gone if k in set(map(key, odd.collect()))} == {(r[0], r[1], r[3]) for r in rows if r[1] and (item in r[1] or other in r[1])}
    mixed = stages["mixing sources to target weights"](spark, given, small)
    taken = collections.Counter(map(key, mixed.collect()))
    assert mixed.columns == given.columns and all(n <= 3 * before[k] for k, n in taken.items())
    placed = stages["sharding"](spark, given, small).collect()
    assert collections.Counter(r.doc_id for r in placed) == collections.Counter(r.doc_id for r in given.collect()) and len({(r.shard, r.slot) for r in placed}) == len(placed)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, given.limit(0), small).count() == 0, name


def test_registered():
    import __spark_entry__

    assert set(queries.queries()) | {"pipeline"} <= set(__spark_entry__.queries())
