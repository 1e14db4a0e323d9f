"""Page differencing against a plain version, and the models of the secret scan over a whole table."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from marketlake.llm import common, page_text, queries, secrets


def plain_texts(pages: list[dict]) -> dict:
    """The whole rule in memory: runs of copies by URL path, and both pages around a run."""
    cut = [page_text.lines(p["html"] or "") for p in pages]
    codes = [[page_text.code(text) for _, text in x] for x in cut]
    kinds = [bytes(kind for kind, _ in x) for x in cut]
    places = [page_text.place(p["url"]) for p in pages]
    order = sorted((i for i in range(len(pages)) if places[i][0]), key=lambda i: (*places[i], i))

    def copied(i: int, j: int) -> bool:
        return page_text.copies(kinds[i], kinds[j], page_text.common_lines(codes[i], codes[j]))

    runs = []
    for i in order:
        if runs and places[runs[-1][-1]][0] == places[i][0] and copied(i, runs[-1][-1]):
            runs[-1].append(i)
        else:
            runs.append([i])
    shared = {}
    for n, run in enumerate(runs):
        around = [runs[n - 1][-1]] * (n > 0) + [x[0] for x in runs[n + 1 : n + 2]]
        for i in run:
            found = [j for j in around if places[j][0] == places[i][0] and not copied(i, j)]
            found.sort(key=lambda j: (-page_text._alike(places[i][1], places[j][1]), order.index(j)))
            if found:
                shared[i] = page_text.common_lines(codes[i], codes[found[0]])
                for j in found[1:]:
                    shared[i] = {at for at in shared[i] if codes[i][at] in codes[j]}
    out = {}
    for i, page in enumerate(pages):
        kept = [(at, kind, text) for at, (kind, text) in enumerate(cut[i]) if kind != page_text.FURNITURE]
        most = max((kind for _, kind, _ in kept), default=None)
        gone = shared.get(i)
        out[page["page_id"]] = " ".join(
            text for at, kind, text in kept if (kind == most if gone is None else at not in gone)
        )
    return out


@pytest.mark.parametrize("sf, partitions", [("sf0.001", "3"), ("sf0.01", "7")])
def test_page_text_is_the_plain_rule(spark, sf, partitions):
    folder = f"/root/testdata/{sf}"
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        found = {r.page_id: r.text for r in queries.QUERIES["op8_page_text"](spark, folder).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found == plain_texts(pq.read_table(f"{folder}/pages.parquet").to_pylist())


def test_articles_stay_whole(spark, sf_dir):
    """Nearly all articles; a line goes only if both neighbours hold it."""
    pages = pq.read_table(f"{sf_dir}/pages.parquet").to_pylist()
    found = {r.page_id: r.text for r in page_text.main_text(common.table(spark, sf_dir, "pages")).collect()}
    whole = sum(
        found[p["page_id"]] == " ".join(t for k, t in page_text.lines(p["html"]) if k == page_text.MAIN) for p in pages
    )
    assert whole >= 0.95 * len(pages)


def test_lines_that_one_neighbour_shares_stay(spark):
    html = "<p>Site</p><p>{0}</p><p>{0} more</p><p>{1}</p>"
    rows = [(i, f"http://h.example/a/{i}", html.format(f"page {i}", x)) for i, x in enumerate(["q", "q", "r"])]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r.page_id: r.text for r in page_text.main_text(docs).collect()}
    assert found == {0: "page 0 page 0 more", 1: "page 1 page 1 more q", 2: "page 2 page 2 more r"}


def planted(seed: int = 5) -> list[tuple]:
    rng = np.random.default_rng(seed)
    return [
        (10**9 + i, "the key is " + "".join(rng.choice(list(secrets.ALPHABETS[i % 3]), size)) + " in a file", size)
        for i, size in enumerate([20, 24, 32, 40, 64] * 30)
    ]


def test_planted_random_strings(spark, sf_dir, tmp_path):
    """Through the registered query: base62, base64 and base64url strings are found, words are not."""
    rows = planted()
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    docs.union(spark.createDataFrame([r[:2] for r in rows], docs.schema)).write.parquet(
        str(tmp_path / "documents.parquet")
    )
    found = {r.doc_id: r.spans for r in queries.QUERIES["op2_secret_scan"](spark, str(tmp_path)).collect()}
    hits = sum(f"model:11:{11 + size}" == found[doc_id] for doc_id, _, size in rows)
    assert hits >= 0.9 * len(rows)
    assert sum("model" in x for doc_id, x in found.items() if doc_id < 10**9) <= 0.001 * len(found)


def test_models_are_the_plain_ones(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    samples = secrets.random_strings(spark), secrets.ordinary_identifiers(docs)
    found = {r.pair: r.ratio for r in secrets.train(*samples).collect()}
    ratios = []
    for sample in samples:
        pairs = Counter(v.value[i : i + 2] for v in sample.collect() for i in range(len(v.value) - 1))
        first, second = Counter(), Counter()
        for pair, n in pairs.items():
            first[pair[0]] += n
            second[pair[1]] += n
        share = {x: (second[x] + 1) / (sum(pairs.values()) + len(secrets._SYMBOLS)) for x in secrets._SYMBOLS}
        ratios.append({
            a + b: math.log((pairs[a + b] + secrets._PRIOR * share[b]) / (first[a] + secrets._PRIOR))
            for a in secrets._SYMBOLS for b in secrets._SYMBOLS
        })
    assert found.keys() == ratios[0].keys()
    assert all(math.isclose(found[x], ratios[0][x] - ratios[1][x], abs_tol=1e-9) for x in found)


def test_spans_are_the_tokens_of_the_model(spark, sf_dir):
    """``spans`` against a plain scan with the table of pairs and the threshold of ``fit``."""
    extra = [row[:2] for row in planted(6)]
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame(extra, docs.schema))
    model, least = secrets.fit(secrets.random_strings(spark), secrets.ordinary_identifiers(docs))
    ratio = {r.pair: r.ratio for r in model.collect()}
    found = {r.doc_id: r.spans.split(",") if r.spans else [] for r in secrets.digests(docs).collect()}
    for doc_id, text in docs.collect():
        base = [tuple(map(int, x.split(":")[1:])) for x in found[doc_id] if not x.startswith("model")]
        expected = []
        for m in re.finditer(secrets.TOKEN, text or ""):
            total = math.fsum(ratio.get(m[0][i : i + 2], 0.0) for i in range(len(m[0]) - 1))
            inside = any(a < m.end() and m.start() < b for a, b in base)
            if not inside and total / (len(m[0]) - 1) >= least:
                expected.append(f"model:{m.start()}:{m.end()}")
        assert [x for x in found[doc_id] if x.startswith("model")] == expected
