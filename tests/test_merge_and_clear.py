"""Merge by absent name, the second metadata form, a cleared archive, crawl forms: small cases."""
from __future__ import annotations

import re

from pricesieve.operators import crawl, links, menu, text
from pricesieve.sources import archive


def test_merge_takes_only_absent_names(spark):
    products = spark.createDataFrame([(1, "Soup", "$4"), (2, None, "$1")], "doc_id long, product_name string, price string")
    items = spark.createDataFrame(
        [(1, "Soup", "$5", "LUNCH"), (1, "Cake", "$3", "LUNCH"), (1, "Cake", "$2", "SWEET"), (2, "", "$9", "X"),
         (3, "Soup", "$6", "LUNCH")], "doc_id long, product_name string, price string, category string")
    got = menu.merge_absent(products, items).collect()
    rows = sorted((r.doc_id, r.product_name or "", r.price, r.category or "") for r in got)
    assert rows == [(1, "Cake", "$2", "SWEET"), (1, "Cake", "$3", "LUNCH"), (1, "Soup", "$4", ""), (2, "", "$1", ""),
                    (3, "Soup", "$6", "LUNCH")]


def test_document_products_describe_the_first_of_a_name(spark):
    docs = spark.createDataFrame([(1, "Apple cake $4.50\nwith cream\n\nApple cake $4.50\n"), (2, "Card\nHOT SOUP\nW1 $2.50\n"
                                  "W2 $3.50\nLUNCH BOX\nW3 $4.50\n"), (3, "T1 £2.00\n"), (4, ""), (5, None)],
                                 "doc_id long, text string")
    got = menu.document_products(docs).collect()
    first = [(r.line_no, r.description) for r in got if r.doc_id == 1 and r.description is not None]
    assert first and all(d == "with cream" for _, d in first) and {n for n, _ in first} == {0}
    assert {(r.product_name, r.category) for r in got if r.doc_id == 2} == {("W1", "HOT SOUP"), ("W2", "HOT SOUP"), ("W3", "LUNCH BOX")}
    assert not [r for r in got if r.doc_id in (3, 4, 5)]


def test_pdf_metadata_of_a_document_without_any(spark):
    docs = spark.createDataFrame([(1, {"/Title": "A"}, 3), (2, {}, 4), (3, None, 5)], "doc_id long, metadata map<string,string>, n_pages long")
    got = {r.doc_id: (r.title, r.author, r.page_count) for r in text.pdf_metadata(docs).collect()}
    assert got == {1: ("A", "", 3), 2: (None, None, None), 3: (None, None, None)}


def test_a_cleared_archive_keeps_its_buckets(spark, tmp_path):
    path = str(tmp_path / "archive")
    old = spark.createDataFrame([("i", "https://a.example/", "20240101_000000", [{"product_name": "x"}])],
                                "scrape_id string, url string, ts string, products array<struct<product_name:string>>")
    archive.write(old, path)
    archive.clear(spark, path, old.schema)
    assert archive.read(spark, path, schema=old.schema).count() == 0
    archive.write(old, path, mode="append")
    assert archive.read(spark, path, urls=["https://a.example/"]).count() == 1
    assert any(p.name.startswith("bucket=") for p in (tmp_path / "archive").iterdir())


def test_thin_answers_are_accepted_last(spark):
    log = spark.createDataFrame([("u", 1, "error", None), ("u", 2, "ok", "x"), ("u", 3, "ok", "yy"), ("v", 1, "ok", "z" * 500),
                                 ("v", 2, "ok", "late"), ("w", 1, "error", None), ("w", 2, "error", None), ("w", 3, "error", None),
                                 ("q", 1, "ok", None)], "url string, attempt int, status string, text string")
    got = {r.url: (r.outcome, r.attempt, r.content) for r in links.fetch_outcome(log).collect()}
    assert got == {"u": ("accepted", 3, "yy"), "v": ("accepted", 1, "z" * 500), "w": ("dropped", 3, None), "q": ("retry", 1, None)}


def test_crawl_forms(spark):
    starts = spark.createDataFrame([(1, "https://a.example/")], "crawl_id long, start_url string")
    graph = spark.createDataFrame([("https://a.example/", 1, "https://a.example/p#x"), ("https://a.example/", 2, "https://a.example/p"),
                                   ("https://a.example/", 3, "https://b.example/"), ("https://b.example/", 1, "https://a.example/q")],
                                  "src string, pos int, dst string")

    def urls(**form):
        return [r.url for r in crawl.crawl_bfs(starts, graph, **form).orderBy("rank").collect()]

    a, b = "https://a.example/", "https://b.example/"
    assert urls() == [a, a + "p#x", a + "p", b, a + "q"]
    assert urls(same_domain_only=True) == [a, a + "p#x", a + "p"]
    assert urls(normalize_fragments=True) == [a, a + "p#x", b, a + "q"]


def test_a_level_is_stored_once_and_ranked_by_one_shuffle(spark, monkeypatch):
    """A level of a capped crawl is written once; candidates and seen URLs are dealt together."""
    n = 30
    starts = spark.createDataFrame([(i, f"https://h/{i}") for i in range(n)] + [(None, "https://h/1")], "crawl_id long, start_url string")
    graph = spark.createDataFrame([(f"https://h/{i}", j, f"https://h/{(3 * i + j) % n}") for i in range(n) for j in (1, 2, 3)]
                                  + [("https://h/0", 4, None)], "src string, pos int, dst string")
    stored = []
    plain = crawl.materialize

    def kept(df):
        stored.append(df._jdf.queryExecution().executedPlan().toString())
        return plain(df)

    monkeypatch.setattr(crawl, "materialize", kept)
    got = crawl.crawl_bfs(starts, graph, max_pages=9).collect()
    depth = max(r.depth for r in got)
    assert depth >= 2 and len(stored) == 2 + depth  # the starts, the links and one table a level
    assert all(len(re.findall(r"Exchange hashpartitioning\(crawl_id", p)) == 1 for p in stored[2:])
    for c in range(n):
        urls = [r.url for r in sorted((r for r in got if r.crawl_id == c), key=lambda r: r["rank"])]
        queue = [f"https://h/{c}"]
        for u in queue:
            i = int(u.rsplit("/", 1)[1]) if u else -1
            for v in ([f"https://h/{(3 * i + j) % n}" for j in (1, 2, 3)] if u else []) + ([None] if i == 0 else []):
                if v not in queue:
                    queue.append(v)
        assert urls == queue[:9]
    assert [r.url for r in got if r.crawl_id is None] == ["https://h/1"]


def test_table_heads(spark):
    cells = spark.createDataFrame(
        [(1, 0, 0, 0, 0, "A"), (1, 0, 0, 0, 1, " B "), (1, 0, 0, 1, 0, "1"), (1, 0, 0, 1, 1, None), (1, 0, 0, 1, 2, "beyond"),
         (1, 0, 1, 2, 0, None), (1, 0, 1, 2, 1, "x"), (1, 0, 1, 3, 0, "y"), (2, 0, 0, 0, 0, ""), (2, 0, 0, 1, 0, None)],
        "doc_id long, page_no int, table_no int, row_no int, col_no int, cell string")
    named = {(r.doc_id, r.table_no, r.row_no, r.col_no): (r.column_name, r.cell) for r in text.table_header(cells).collect()}
    # three columns, two of them in the first row: no header; the second table's first row has a null; the third is empty
    assert named == {(1, 0, 0, 0): ("0", "A"), (1, 0, 0, 1): ("1", " B "), (1, 0, 1, 0): ("0", "1"), (1, 0, 1, 1): ("1", None),
                     (1, 0, 1, 2): ("2", "beyond"), (1, 1, 2, 0): ("0", None), (1, 1, 2, 1): ("1", "x"), (1, 1, 3, 0): ("0", "y")}
    rows = {(r.doc_id, r.table_number, r.row_no, r.header): r.value for r in text.table_rows(cells).collect()}
    assert rows == {(1, 1, 1, "A"): "1", (1, 1, 1, "B"): "", (1, 2, 3, "Column0"): "y", (2, 1, 1, "Column0"): ""}


def test_table_cells_are_dealt_once_and_long_tables_in_stretches(spark, monkeypatch):
    """Heads and rows read one shuffle of the cells; a table longer than a stretch, with its columns
    starting in different stretches and with missing numbers, is read as the whole."""
    import random
    rng = random.Random(3)
    cells = [(d, p, t, r, c, rng.choice(["x", " y ", "", None]))
             for d in (1, 2, None) for p in (0, 1) for t in (0, 1, None) for r in range(rng.randint(1, 30)) for c in range(3)
             if rng.random() < 0.8]
    cells += [(1, 0, 2, None, 0, "n"), (1, 0, 3, 0, 0, "h"), (1, 0, 3, None, 0, "n"), (1, 0, 4, 40, 1, "late")]
    df = spark.createDataFrame(cells, "doc_id long, page_no int, table_no int, row_no int, col_no int, cell string")

    def both():
        return [sorted(map(repr, f(df).collect())) for f in (text.table_rows, text.table_header)]

    whole = both()
    monkeypatch.setattr(text, "STRETCH", 4)
    assert both() == whole
    first = {}
    for d, p, t, r, c, _ in cells:
        if r is not None:
            first[d, p, t] = min(first.get((d, p, t), r), r)
    head = {(d, p, t, c): v for d, p, t, r, c, v in cells if r is not None and r == first[d, p, t]}
    tables = {(d, p): sorted({x[2] for x in cells if x[:2] == (d, p)}, key=lambda t: (t is not None, t)) for d, p, *_ in cells}
    want = sorted((d, p, tables[d, p].index(t) + 1, r, c, (head[d, p, t, c] or f"Column{c}").strip(), (v or "").strip())
                  for d, p, t, r, c, v in cells
                  if None not in (d, p, t, r) and r > first[d, p, t] and (d, p, t, c) in head)
    assert sorted(tuple(r) for r in text.table_rows(df).collect()) == want
    for f in (text.table_rows, text.table_header):
        out = f(df)
        out.collect()
        assert "ReusedExchange" in out._jdf.queryExecution().executedPlan().toString()


def test_cascade_deals_chunks_evenly_and_tests_each_once(spark, monkeypatch):
    """Chunks read in one split are dealt to all tasks, and stored with what the extractors ask."""
    from pricesieve.operators import cascade
    rows = [(f"c{i}", "https://www.shell.example.com/s" if i % 2 else "https://a.example.com/book", "Diesel\n$3.10\nUNLEADED\n$2.90")
            for i in range(200)] + [("n", None, None)]
    chunks = spark.createDataFrame(rows, "chunk_id string, url string, text string").coalesce(1)
    stored = []
    plain = cascade.materialize

    def kept(df):
        stored.append(plain(df))
        return stored[-1]

    monkeypatch.setattr(cascade, "materialize", kept)
    got = cascade.cascade(chunks).collect()
    assert {r.chunk_id for r in got} == {r[0] for r in rows[:200]} and {r.extracted_by for r in got} <= {"fuel_nodes", "fuel_near"}
    assert {"is_fuel", "is_booking", "is_styled"} <= set(stored[0].columns)
    sizes = [len(x) for x in stored[0].rdd.glom().collect()]
    assert len(sizes) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(sizes) < 60
