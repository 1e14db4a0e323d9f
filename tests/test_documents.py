import json

from marketlake.operators import documents
from marketlake.sources import dims


def docs(spark, *rows):
    return spark.createDataFrame(
        [(i, n, w, d if isinstance(d, str) else json.dumps(d)) for i, n, w, d in rows],
        "item_id int, item_name string, world string, doc string",
    )


def test_snapshot(spark):
    doc = {
        "worldName": "Siren",
        "items": {
            "5": {"hasData": True, "listingsCount": 3, "averagePrice": 1.5, "regularSaleVelocity": 2.0, "x": 1},
            "6": {"hasData": False, "listingsCount": 1}, "7": {"listingsCount": 9},
        },
    }
    got = documents.snapshot_items(docs(spark, (1, "n", "w", doc))).collect()
    assert [tuple(r) for r in got] == [("Siren", 5, 3, 1.5, 2.0)]


def test_quotes(spark):
    doc = {
        "listings": [{"hq": True, "quantity": 2, "pricePerUnit": 1500, "total": 3000}, {"pricePerUnit": 7}] + [{}] * 9,
        "recentHistory": [{"hq": False, "quantity": 1, "pricePerUnit": 1234567}] * 5,
    }
    (r,) = documents.live_quotes(docs(spark, (1, "Ore", "Siren", doc))).collect()
    assert len(r["listings"]) == 5 and len(r["recent_sales"]) == 3
    assert r["report"].split("\n") == [
        "Live listings for Ore on Siren:",
        "  HQ x2 @ 1,500 gil (total: 3,000 gil)",
        "  NQ x0 @ 7 gil (total: 0 gil)",
        *["  NQ x0 @ 0 gil (total: 0 gil)"] * 3,
        "Recent sales:",
        *["  NQ x1 sold @ 1,234,567 gil"] * 3,
    ]


def test_quotes_without_sales_or_listings(spark):
    rows = docs(spark, (1, "A", "W", {"listings": [{}]}), (2, "B", "W", {"recentHistory": [{}]}), (3, "C", "W", {}))
    reports = {r["item_name"]: r["report"] for r in documents.live_quotes(rows).collect()}
    assert reports == {
        "A": "Live listings for A on W:\n  NQ x0 @ 0 gil (total: 0 gil)",
        "B": "No current listings for B on W.",
        "C": "No current listings for C on W.",
    }


def test_item_details(spark):
    nested = {"fields": {"ItemUICategory": {"Name": "Ore", "id": 3}, "LevelItem": 5, "LevelEquip": 1, "CanBeHq": True, "Description": "d" * 301}}
    flat = {"ItemUICategory": "Metal", "CanBeHq": 1}
    bare = {"fields": {"ItemUICategory": {"id": 3}, "Description": "d" * 300, "CanBeHq": 0}}
    rows = documents.item_details(docs(spark, (1, "a", "", nested), (2, "b", "", flat), (3, "c", "", bare), (4, "e", "", {})))
    got = {r["item_name"]: r for r in rows.collect()}
    assert [got["a"][c] for c in ("category", "item_level", "equip_level", "can_be_hq")] == ["Ore", "5", "1", True]
    assert got["a"]["report"].endswith("  Description: " + "d" * 300 + "...")
    assert [got["b"][c] for c in ("category", "item_level", "can_be_hq", "description")] == ["Metal", "?", True, "No description available."]
    assert [got["c"][c] for c in ("category", "can_be_hq")] == ["Unknown", False]
    assert got["c"]["report"].endswith("  Description: " + "d" * 300)
    assert got["e"]["report"] == (
        "e (ID: 4)\n  Category: Unknown\n  Item Level: ?\n  Equip Level: ?\n  Can be HQ: No\n"
        "  Description: No description available."
    )


def pages(spark, *html):
    return spark.createDataFrame(list(enumerate(html)), "page_id int, html string")


def test_headlines(spark):
    own = "".join(
        f'<li class="news__list--link x"><a><p class="news__list--title"> T{i} &amp;<span>x</span> </p><time>May {i}</time></a></li>'
        for i in range(10)
    )
    listed = (
        '<li>outside</li><ul class="a news__list"><li><p>Para &eacute;</p><span class="news__list--time"> Jun </span></li>'
        "<!-- <li>gone</li> --><li>bare</li></ul>"
    )
    rows = documents.page_headlines(pages(spark, f"<ul>{own}</ul>", listed, "<p>none</p>")).collect()
    got = sorted(tuple(r) for r in rows)
    assert got[:8] == [(0, i + 1, f"T{i} &x", f"May {i}") for i in range(8)]
    assert got[8:] == [(1, 1, "Para é", "Jun"), (1, 2, "Unknown", "")]
    reports = {r["page_id"]: r["report"] for r in documents.headline_report(pages(spark, listed, "none")).collect()}
    assert reports == {
        0: "Latest news:\n  - Para é (Jun)\n  - Unknown",
        1: "Could not parse the news page. The page structure may have changed.",
    }


def test_headlines_of_nested_lists(spark):
    page = (
        "<div class='x news__list'><ul><li><p>One</p><ul><li><p>Inner</p></li></ul></li>"
        "<LI><p>Two &lt;b&gt;<br>more</p><time>May 1</time></li><li><p>Three</p></li></ul></div><li>outside</li>"
    )
    bare = "<ul class=news__list><li class=news__list--link><p class='news__list--title'>Own</p><p>Other"
    found = [tuple(r)[2:] for r in documents.page_headlines(pages(spark, page)).orderBy("position").collect()]
    assert found == [("One", ""), ("Inner", ""), ("Two <b>more", "May 1"), ("Three", "")]
    assert [r.title for r in documents.page_headlines(pages(spark, bare, "", None)).collect()] == ["Own"]
    many = "<ul class='news__list'>" + "<li><p>open" * 100_000
    assert documents.page_headlines(pages(spark, many)).count() == 8


def test_item_names_from_csv(spark, tmp_path):
    path = tmp_path / "items.csv"
    path.write_text('x,#,Name\n1,0,zero\n1,5,"  Iron, Ore "\n1,6,\n1,,lost\n1,7,"two ""q"""\n')
    rows = dims.item_names(dims.read_item_source(spark, str(path))).collect()
    assert [tuple(r) for r in rows] == [(5, "Iron, Ore"), (7, 'two "q"')]


def test_worlds_from_json(spark, tmp_path):
    path = tmp_path / "worlds.json"
    path.write_text('[{"id":21,"name":"A"},\n{"id":2999,"name":"B"},{"id":3000,"name":"C"}]')
    rows = dims.world_names(dims.read_world_source(spark, str(path))).collect()
    assert [tuple(r) for r in rows] == [(21, "A"), (2999, "B")]


def test_region_worlds(spark):
    centers = spark.createDataFrame([("EU", [1, 2]), ("NA", [3])], "region string, worlds array<int>")
    worlds = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, name string")
    assert sorted(r[0] for r in dims.region_worlds(centers, worlds, "EU").collect()) == ["a", "b"]
