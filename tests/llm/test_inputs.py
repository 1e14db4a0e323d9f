"""Columns whose names the operators use, identifiers beyond 2^53, and the whole pipeline."""

import time

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from marketlake.llm import common, decontaminate, exact_dedup, fingerprints, jaccard_join, page_text, substring_dedup, warc

PASSAGE = " ".join(f"passage{i}" for i in range(20))
CLASHES = ["_file", "_row", "_metadata", "_doc", "_code", "file", "row", "digest", "n", "component", "words", "score"]
DOCS = [
    (1, "one text that stands here with enough words to be compared with the other one"),
    (2, "ONE text that stands here with enough words to be compared with the other one"),
    (3, f"before {PASSAGE} after"), (4, None), (5, ""), (None, "no identifier"), (None, None),
    (6, "long " * 50_000), (7, "a clean text"), (7, "a clean text"),
]


@pytest.fixture(scope="module", params=["file", "frame"])
def clashing(request, spark, tmp_path_factory):
    common.importable(spark)
    rows = spark.createDataFrame(DOCS, "doc_id long, text string")
    rows = rows.select("*", *[F.lit(f"x{i}").alias(name) for i, name in enumerate(CLASHES)])
    if request.param == "frame":
        return rows
    path = str(tmp_path_factory.mktemp("clash") / "documents.parquet")
    rows.write.parquet(path)
    return spark.read.parquet(path)


def test_exact_dedup_clashes(clashing):
    assert exact_dedup.groups(clashing).count() == len(DOCS)
    kept = exact_dedup.deduplicate(clashing)
    assert kept.columns == clashing.columns
    # Equal: 1 and 2, all empty ones, the repeated 7.
    assert sorted(r.doc_id for r in kept.where("doc_id IS NOT NULL").collect()) == [2, 3, 5, 6, 7]


def test_decontaminate_clashes(clashing, spark):
    items = spark.createDataFrame([(1, PASSAGE, "f")], "item_id long, text string, _file string")
    assert [r.doc_id for r in decontaminate.passages(clashing, items).where("contaminated").collect()] == [3]
    kept = decontaminate.clean(clashing, items)
    assert kept.columns == clashing.columns and kept.count() == len(DOCS) - 1


def test_representatives_clash(clashing):
    kept = jaccard_join.representatives(clashing)
    assert kept.columns == clashing.columns
    assert sorted(r.doc_id for r in kept.where("doc_id IS NOT NULL").collect()) == [1, 3, 4, 5, 6, 7, 7]


def test_others_clash(clashing):
    assert fingerprints.digests(clashing).count() == len(DOCS)
    pages = clashing.withColumnRenamed("doc_id", "page_id").withColumn("url", F.lit("http://h/x")).withColumnRenamed("text", "html")
    assert page_text.main_text(pages).count() == len(DOCS)


def test_large_identifiers_beside_null(spark):
    text = " ".join(f"word{i}" for i in range(20))
    docs = spark.createDataFrame([(2**53, text), (2**53 + 1, text), (None, text)], "doc_id long, text string").coalesce(1)
    common.importable(spark)
    found = {r.doc_id: r.n_removed for r in substring_dedup.kept_words(docs).collect()}
    assert found == {2**53: 0, 2**53 + 1: 20, None: 0}


def test_pipeline(spark, sf_dir):
    """Every stage keeps what the operator decides, judged on the rows that it was given."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = common.materialize(stage(spark, docs, sf_dir), f"test-{name}")
        ids = {r.doc_id for r in before.select("doc_id").collect()}
        kept = {r.doc_id for r in docs.select("doc_id").collect()}
        assert kept <= ids and len(kept) >= 0.7 * len(ids)
        if name != "tokens":
            assert docs.columns == common.DOCUMENT
            assert docs.exceptAll(before.select(common.DOCUMENT)).isEmpty()
        if name == "exact_dedup":
            texts = {}
            for r in before.collect():
                key = r.text.translate(str.maketrans(common.UPPER, common.UPPER.lower()))
                texts[key] = max(texts.get(key, r.doc_id), r.doc_id)
            assert kept == set(texts.values())
        if name == "near_duplicates":
            groups = jaccard_join.near_duplicates(before, 5, 80).collect()
            assert kept == {r.component_id for r in groups}
        if name == "decontaminate":
            marked = decontaminate.passages(before, common.table(spark, sf_dir, "benchmark"))
            assert kept == {r.doc_id for r in marked.where("NOT contaminated").collect()}
        if name == "tokens":
            assert kept == ids
    again = {r.doc_id for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert again == kept


@pytest.mark.parametrize("html, text", [
    ('<article aria-hidden="false"><p>one</p></article>', "one"),
    ('<article style="overflow:hidden"><p>one</p></article>', "one"),
    ("<article><p class=it's>one</p><p>two</p></article>", "one two"),
    ('<article><p>one</p><div class="share-price form">two</div></article>', "one two"),
    ('<article><p>a < b <i title="x > y">c</i></p></article>', "a < b c"),
    ('<article><p>one</p><div hidden>no</div><div aria-hidden=true>no</div><div class="comment-list">no</div></article>', "one"),
    ('<article><p>one</p><div style="display : none">no</div><svg/><p>two</p></article>', "one two"),
    ('<article><p>one</p><p class="never closed>two</p></article>', "one two"),
])
def test_lines_of_articles(html, text):
    assert " ".join(line for kind, line in page_text.lines(html) if kind == page_text.MAIN) == text


@pytest.mark.parametrize("piece", ['<a b="', '<a b="x', "<p", "<div>", "<svg>", "</div>", "<a =' ", "<!--", "<"])
def test_tags_are_scanned_in_linear_time(piece):
    page = piece * (1_000_000 // len(piece))
    start = time.perf_counter()
    page_text.lines(page)
    assert time.perf_counter() - start < 20  # quadratic work would take hours


def test_transactions_over_a_whole_table(spark, tmp_path):
    """Requests and metadata of every capture; records without a partner, and double ones."""
    rows = [(i, f"http://h{i % 3}.example/p{i}?q", f"<p>{i % 7}</p>") for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write(pages, str(tmp_path / "w"))
    records = common.materialize(warc.read(spark, str(tmp_path / "w")), "warc-test")
    found = {r.page_id: r for r in warc.captures(records).collect()}
    assert len(found) == 40
    for i, url, html in rows:
        assert found[i].request.payload.startswith(f"GET /p{i}?q HTTP/1.1".encode())
        assert f"payload-length: {len(html)}\r\n".encode() in found[i].metadata.payload
        assert found[i].response.payload.decode() == html
    # The request of page 3 and the metadata of page 4 are lost, those of page 5 are there twice.
    lost = ((F.col("type") == "request") & (F.col("page_id") == 3)) | ((F.col("type") == "metadata") & (F.col("page_id") == 4))
    double = records.where("type <> 'response' AND type <> 'revisit' AND page_id = 5")
    double = double.withColumn("record_id", F.concat("record_id", F.lit("-again")))
    orphan = double.withColumn("concurrent_to", F.lit("<urn:none>"))
    odd = {r.page_id: r for r in warc.captures(records.where(~lost).union(double).union(orphan)).collect()}
    assert len(odd) == 40
    assert odd[3].request is None and odd[3].metadata == found[3].metadata
    assert odd[4].metadata is None and odd[4].request == found[4].request
    assert odd[5] == found[5]


def test_transaction_joins_are_in_the_plan(spark, sf_dir):
    plan = warc.digests(common.table(spark, sf_dir, "pages").limit(20))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 3
