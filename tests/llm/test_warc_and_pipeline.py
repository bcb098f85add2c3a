import corpus_pipeline
from pyspark.sql import functions as F

from tapeline.llm import decontam, quality, queries, sharding, warc
from tests.llm.cases import SF, documents, rows


def test_canonical_url(spark):
    urls = ["HTTP://WWW.Example.com:80/a/b/?utm_source=x&b=2&a=1#top", "https://example.com/a/b?a=1&b=2", "example.com", "", None, "http://example.com/?ref=q"]
    got = [r.u for r in spark.createDataFrame([(u,) for u in urls], "url string").select(warc.canonical_url(F.col("url")).alias("u")).collect()]
    assert got == ["example.com/a/b?a=1&b=2", "example.com/a/b?a=1&b=2", "example.com", "", "", "example.com"]


def test_resolve(spark):
    h = [("content-type", "text/html"), ("date", "1"), ("etag", '"a"')]
    data = [
        ("u", 1, 1, True, '"a"', "mon", h), ("u", 5, 2, True, '"b"', None, None), ("u", 5, 3, True, 'W/"c"', "tue", h),
        ("u", 1, 10, False, '"a"', None, None), ("u", 4, 11, False, 'W/"a"', None, [("date", "9"), ("server", "x"), ("etag", 'W/"a"')]),
        ("u", 9000, 12, False, '"c"', None, []), ("u", 9001, 13, False, '"b"', None, []), ("u", 9001, 14, False, None, "tue", []),
        ("u", 9001, 15, False, None, None, []), ("v", 9001, 16, False, '"a"', None, []), (None, None, 17, False, '"a"', None, []), ("u", 9001, 15, False, None, None, []),
    ]
    frame = spark.createDataFrame(data, warc.RECORD).withColumn("bucket", F.lit(1))
    for bucket in (1 << 13, 2):
        got = {r.record_id: (r.refers_to, r.verdict) for r in warc.resolve(frame, bucket).collect()}
        assert got == {
            10: (None, "no response"), 11: (1, "matched"), 12: (3, "matched"), 13: (3, "mismatch"), 14: (3, "matched"),
            15: (3, "unchecked"), 16: (None, "no response"), 17: (None, "no response"),
        }
    assert warc.resolve(frame).count() == 9
    headers = {r.record_id: r.headers for r in warc.resolve(frame).collect()}
    assert [tuple(x) for x in headers[11]] == [("content-type", "text/html"), ("date", "9"), ("etag", 'W/"a"')] and headers[13] is None
    assert rows(warc.resolve(frame.filter("false"))) == []
    cased = spark.createDataFrame([("u", 1, 1, True, '"a"', None, [("Date", "1"), ("Server", "s")]), ("u", 2, 2, False, '"a"', None, [("date", "2")]), (None, 1, 3, True, '"a"', None, []), (None, 2, 4, False, '"a"', None, [])], warc.RECORD)
    got = {r.record_id: (r.verdict, [tuple(h) for h in r.headers or ()]) for r in warc.resolve(cased).collect()}
    assert got == {2: ("matched", [("Server", "s"), ("date", "2")]), 4: ("no response", [])}


def test_registered_revisits_lie_between_fetches(spark):
    """Some find their response in their own bucket, some in an earlier one, some none of other pages."""
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    records = warc.captures(pages, queries.DELAY)
    found = warc.resolve(records, queries.BUCKET).select("record_id", "refers_to")
    apart = F.floor((2 * (F.col("record_id") + queries.DELAY) + 1) / queries.BUCKET) - F.floor(2 * F.col("refers_to") / queries.BUCKET)
    kinds = {r.same for r in found.select((apart == 0).alias("same")).distinct().collect()}
    last = found.agg(F.max("refers_to")).first()[0]
    assert False in kinds and found.filter(F.col("refers_to") < last).count() > 0
    assert rows(warc.resolve(records, queries.BUCKET)) == rows(warc.resolve(records, 1 << 40))


def test_stages_on_edge_rows(spark):
    docs = documents(spark).select(*spark.read.parquet(f"{SF}/documents.parquet").columns)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() > 0, name
        assert stage(spark, docs.filter("false"), SF).count() == 0, name


def test_slots_keep_the_order_of_the_mix(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    many = docs.filter("doc_id < 40").crossJoin(spark.range(50).select("id")).orderBy("id").select("doc_id", "text")
    slots = {}
    for r in sharding.shard_documents(many, 2, in_order=True).collect():
        slots.setdefault((r.shard, r.doc_id), []).append(r.slot)
    assert all(max(s) - min(s) > 25 * 10 for s in slots.values())


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, SF)
        assert kept.columns == columns, name
    final = corpus_pipeline.run(spark, SF)
    assert final.count() == kept.count() > 0
    good = {r.doc_id for r in quality.verdicts(quality.ledger(docs)).filter("kept").collect()}
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    dirty = {r.doc_id for r in decontam.contamination(docs, bench).filter(decontam.is_contaminated()).collect()}
    ids = {r.doc_id for r in final.collect()}
    assert ids <= good - dirty
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near duplicates", "decontamination", "mixing", "sharding"]
