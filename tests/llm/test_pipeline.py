import itertools
import re
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from folioflow.llm import line_crf, quality_rules
from folioflow.llm.queries import trusted

SF = "/root/testdata/sf0.001"


def lowered(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "")


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lowered(text))


def components(rows):
    """The smallest id of each row's component of near copies, by all pairs."""
    sets = []
    for r in rows:
        w = spaced(r.text)
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            parent[root(a)] = root(b)
    least = {}
    for i, r in enumerate(rows):
        least[root(i)] = min(least.get(root(i), r.doc_id), r.doc_id)
    return [least[root(i)] for i in range(len(rows))]


def has_item(text, windows):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))
    return any(tuple(w[p : p + n]) in known for n, known in windows.items() for p in range(len(w) - n + 1))


def test_stages_match_brute_force(spark, tmp_path):
    sf = str(tmp_path)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    more = docs.where("doc_id = 3").unionByName(docs.where("doc_id = 3")).unionByName(docs.where("doc_id = 4").withColumn("text", F.lit(None).cast("string"))).unionByName(docs.where("doc_id = 5").withColumn("source", F.lit(None).cast("string")))
    docs.unionByName(more).withColumn("text_k", F.lit("clash")).withColumn("class_mark", F.lit("clash")).write.parquet(f"{sf}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{sf}/{name}.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    key = lambda r: (r.doc_id, r.text or "", r.source or "")

    weight = quality_rules.weights(docs, trusted(spark, sf))
    want = Counter(key(r) for r in quality_rules.with_quality_rules(docs, weight).collect() if r.kept)
    kept = [stage(spark, docs, sf) for _, stage in corpus_pipeline.STAGES[:1]][0]
    assert kept.columns == docs.columns and Counter(map(key, kept.collect())) == want

    kept.write.parquet(f"{sf}/0")
    docs = spark.read.parquet(f"{sf}/0")
    model = line_crf.fit(spark.read.parquet(f"{sf}/documents.parquet"), labels)
    want = Counter(key(r) for r in docs.collect() if model.score(r.text) >= line_crf.THRESHOLD)
    kept = corpus_pipeline.STAGES[1][1](spark, docs, sf)
    assert kept.columns == docs.columns and Counter(map(key, kept.collect())) == want

    kept.write.parquet(f"{sf}/1")
    docs = spark.read.parquet(f"{sf}/1")
    rows = docs.collect()
    stay = corpus_pipeline.STAGES[2][1](spark, docs, sf)
    found = stay.collect()
    assert stay.columns == docs.columns and sorted(r.doc_id for r in found) == sorted(set(components(rows)))

    stay.write.parquet(f"{sf}/2")
    docs = spark.read.parquet(f"{sf}/2")
    windows = {}
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(r.text))
        n = min(10, len(w))
        for p in range(len(w) - n + 1) if n else ():
            windows.setdefault(n, set()).add(tuple(w[p : p + n]))
    want = Counter(key(r) for r in docs.collect() if not has_item(r.text, windows))
    kept = corpus_pipeline.STAGES[3][1](spark, docs, sf)
    assert kept.columns == docs.columns and Counter(map(key, kept.collect())) == want

    out = corpus_pipeline.run(spark, sf).collect()
    assert Counter(r.doc_id for r in out if r.piece == 0) == Counter(k[0] for k in want)
    assert sum(r.n_units for r in out) == sum(len(spaced(k[1])) * n for k, n in want.items())
    source = {k[0]: k[2] for k in want}
    for _, group in itertools.groupby(sorted(out, key=lambda r: r.bin_id), key=lambda r: r.bin_id):
        group = list(group)
        assert sum(r.n_units for r in group) == group[0].bin_fill <= 2048
        assert max(Counter(source[r.doc_id] for r in group).values()) == 1

    empty = str(tmp_path / "none")
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{empty}/{name}.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0
    assert len(corpus_pipeline.STAGES) == 5


def test_filters_keep_clean_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    marks = spark.read.parquet(f"{SF}/labels.parquet").collect()
    good, bad = ({r.doc_id for r in marks if r.quality == q} for q in (1, 0))
    long_good = {r.doc_id for r in docs.where("size(split(text, ' ')) >= 60").collect()} & good
    for _, stage in corpus_pipeline.STAGES[:2]:
        ids = {r.doc_id for r in stage(spark, docs, SF).select("doc_id").collect()}
        assert len(long_good & ids) >= 0.95 * len(long_good) and len(bad & ids) <= 0.3 * len(bad)


def test_bytes_that_are_not_utf8_pass_all_stages(spark, tmp_path):
    sf = str(tmp_path)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = docs.where("n_chars > 800").limit(30).withColumn("doc_id", F.col("doc_id") + 800_000)
    odd = odd.withColumn("text", F.expr("cast(concat(cast(reverse(text) as binary), X'20FFFE20C3') as string)"))
    docs.unionByName(odd).write.parquet(f"{sf}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{sf}/{name}.parquet")
    read = spark.read.parquet(f"{sf}/documents.parquet")
    model = line_crf.fit(read, spark.read.parquet(f"{sf}/labels.parquet"))
    assert line_crf.scored(read, model).where("doc_id >= 800000").count() == 30
    kept = read.where(F.col("doc_id") >= 800_000)
    assert {(r.doc_id, r.t) for r in line_crf.good(kept, model, threshold=0.0).selectExpr("doc_id", "hex(text) t").collect()} == {(r.doc_id, r.t) for r in kept.selectExpr("doc_id", "hex(text) t").collect()}
    assert corpus_pipeline.run(spark, sf).count() > 0
