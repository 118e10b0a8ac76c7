import datetime
import json
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quarry.engine import Corpus
from quarry.functions import arabic
from quarry.operators import highlight, manifest, metadata, nodes, store
from quarry.operators import tokens as tok
from quarry.operators.postings import TermIndex, all_of, any_of
from quarry.operators.search import Filters, Search
from quarry.sources import corpus, export
from quarry.streaming import ingest

VOCAB = ["اب", "ابن", "ابنه", "كتب", "كتاب", "قال", "قول", "من"]


def make(n=60, seed=3):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        s = [r.choice(VOCAB) for _ in range(r.randint(0, 14))]
        rows.append((i % 5, i % 2, i, i % 3, i % 4, None if i % 7 == 0 else 100 + (i * 37) % 300, i % 9, "1", str(i), " ".join(s), s, [w[:2] for w in s], [None if w == "من" else w[0] for w in s]))
    return rows


@pytest.fixture(scope="module")
def rows():
    return make()


@pytest.fixture(scope="module")
def pages(spark, rows):
    df = spark.createDataFrame(rows, ingest.PAGES)
    return corpus.with_strings(df).cache()


def ids(df):
    return {r["page_id"] for r in df.collect()}


def brute(rows, test):
    return {r[2] for r in rows if test(r[10], r[11], r[12])}


def at(s, words):
    return [i for i in range(len(s) - len(words) + 1) if all(w(s[i + k]) if callable(w) else s[i + k] == w for k, w in enumerate(words))]


def test_phrase_against_brute_force(pages, rows):
    s = Search(pages)
    for q in (["اب"], ["ابن", "كتب"], ["قال", "قال"], ["من", "اب", "كتب"]):
        node = nodes.term(" ".join(q), "surface")
        assert ids(s.matching(node)) == brute(rows, lambda x, *_: bool(at(x, q)))
        got = {r["page_id"]: r["matched_token_indices"] for r in s.hits(node, limit=1000).collect()}
        assert got == {r[2]: sorted({p + k for p in at(r[10], q) for k in range(len(q))}) for r in rows if at(r[10], q)}


def test_wildcards_against_brute_force(pages, rows):
    s = Search(pages)
    cases = {"اب*": [lambda w: w.startswith("اب")], "كت*ب": [lambda w: w.startswith("كت") and w.endswith("ب") and len(w) >= 3], "من اب*": ["من", lambda w: w.startswith("اب")], "اب* كتب": [lambda w: w.startswith("اب"), "كتب"]}
    for q, words in cases.items():
        node = nodes.wildcard(q)
        assert ids(s.matching(node)) == brute(rows, lambda x, *_, words=words: bool(at(x, words))), q
        got = {r["page_id"]: r["matched_token_indices"] for r in s.hits(node, limit=1000).collect()}
        assert got == {r[2]: sorted({p + k for p in at(r[10], words) for k in range(len(words))}) for r in rows if at(r[10], words)}, q


@pytest.mark.parametrize("d", [0, 1, 2, 5, 101, 10_000])
def test_near_against_brute_force(pages, rows, d):
    s = Search(pages)
    pairs = lambda x, a, b: [(i, j) for i, u in enumerate(x) for j, v in enumerate(b[1]) if u == a and v == b[0] and abs(i - j) <= d]
    for a, b in (("اب", "كتب"), ("اب", "اب")):
        node = nodes.near((a, "surface"), (b, "surface"), d)
        want = {r[2]: pairs(r[10], a, (b, r[10])) for r in rows}
        assert ids(s.matching(node)) == {k for k, v in want.items() if v}
        got = {r["page_id"]: r["matched_token_indices"] for r in s.proximity((a, "surface"), (b, "surface"), d, limit=1000).collect()}
        assert got == {k: sorted({p for ij in v for p in ij}) for k, v in want.items() if v}
    cross = nodes.near(("قال", "surface"), ("كت", "lemma"), d)
    assert ids(s.matching(cross)) == {r[2] for r in rows if any(u == "قال" and v == "كت" and abs(i - j) <= d for i, u in enumerate(r[10]) for j, v in enumerate(r[11]))}


def test_near_of_any_distance_on_long_pages(spark):
    """A pattern over 10,000 words would end the JVM."""
    def page(i, gap):
        return (1, 0, i, 1, 1, 100, 1, "", "", "", ["x"] * 50 + ["a"] + ["y"] * (gap - 1) + ["b"] + ["z"] * 20_000, None, None)

    s = Search(corpus.with_strings(spark.createDataFrame([page(1, 1), page(2, 2000), page(3, 9_999), page(4, 10_001)], ingest.PAGES)))
    near = lambda d: nodes.near(("a", "surface"), ("b", "surface"), d)
    assert [ids(s.matching(near(d))) for d in (0, 1, 1_999, 2_000, 9_999, 10_000, 10_001)] == [set(), {1}, {1}, {1, 2}, {1, 2, 3}, {1, 2, 3}, {1, 2, 3, 4}]
    assert {r["page_id"]: r["matched_token_indices"] for r in s.hits(near(10_000)).collect()} == {1: [50, 51], 2: [50, 2050], 3: [50, 10_049]}


def test_near_is_monotone_and_phrase_within_and(pages):
    s = Search(pages)
    found = [ids(s.matching(nodes.near(("اب", "surface"), ("كتب", "surface"), d))) for d in range(5)]
    assert all(a <= b for a, b in zip(found, found[1:]))
    assert ids(s.matching(nodes.term("اب كتب", "surface"))) <= ids(s.matching(nodes.combined([("اب", "surface"), ("كتب", "surface")])))
    assert ids(s.matching(nodes.term("اب", "surface"))) <= ids(s.matching(nodes.wildcard("اب*")))


def test_boolean_names_and_empty(pages, rows):
    s = Search(pages)
    node = nodes.combined([("اب", "surface"), ("كت", "lemma")], [("قال", "surface"), ("من", "surface")])
    assert ids(s.matching(node)) == brute(rows, lambda x, y, z: "اب" in x and "كت" in y and ("قال" in x or "من" in x))
    assert node == nodes.combined([("اب", "surface"), ("كت", "lemma"), ("اب", "surface")], [("قال", "surface"), ("من", "surface"), ("من", "surface")])
    assert s.matching(nodes.combined([], [])).count() == 0 and s.matching(nodes.names([[" "], []])).count() == 0
    two = nodes.names([["اب كتب", "قال"], ["من"]])
    assert ids(s.matching(two)) == brute(rows, lambda x, *_: (bool(at(x, ["اب", "كتب"])) or "قال" in x) and "من" in x)
    assert node.label() == "(اب AND كت) AND (قال OR من)"


def test_clitics_keep_groups_apart_unless_compat(pages, rows):
    q = [("اب", "surface", True), ("كتب", "surface", True)]
    s = Search(pages)
    assert ids(s.matching(nodes.with_clitics(q))) == brute(rows, lambda x, *_: "اب" in x and "كتب" in x)
    assert ids(s.matching(nodes.with_clitics(q, compat=True))) == brute(rows, lambda x, *_: "اب" in x or "كتب" in x)


def test_order_paging_and_limits(pages, rows):
    s = Search(pages)
    node = nodes.term("اب", "surface")
    full = [r["page_id"] for r in s.keys(node, limit=1000).collect()]
    want = sorted((r for r in rows if "اب" in r[10]), key=lambda r: (r[5] or 0, r[0], r[1], r[2]))
    assert full == [r[2] for r in want]
    assert [r["page_id"] for k in (0, 4, 8) for r in s.keys(node, limit=4, offset=k).collect()] == full[:12]
    assert Search(pages, max_limit=3).keys(node, limit=50).count() == 3
    assert {r["total_hits"] for r in s.with_total(node, limit=3).collect()} == {len(full)}


def test_filters(pages, rows):
    s, node = Search(pages), nodes.term("اب", "surface")
    for f, test in ((Filters(book_ids=[1, 2]), lambda r: r[0] in (1, 2)), (Filters(book_ids=list(range(1500))), lambda r: True), (Filters(author_id=1, genre_id=2), lambda r: r[3] == 1 and r[4] == 2), (Filters(death_ah_min=150, death_ah_max=250), lambda r: r[5] and 150 <= r[5] <= 250), (Filters(century_ah=3), lambda r: r[6] == 3)):
        assert ids(s.matching(node, f)) == {r[2] for r in rows if "اب" in r[10] and test(r)}


def test_match_runs_in_codegen_and_reaches_the_scan(spark, pages, tmp_path):
    pages.write.parquet(str(tmp_path / "p"))
    s = Search(corpus.read_pages(spark, str(tmp_path / "p")))
    plan = s.keys(nodes.near(("اب", "surface"), ("كتب", "surface"), 3), Filters(book_ids=[1, 2]))._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "In(text_id, [1,2])" in plan and "TakeOrderedAndProject" in plan
    assert "body" not in plan.split("ReadSchema")[-1] and "lambda" not in plan


def test_term_index_layout(spark, pages, rows, tmp_path):
    corpus.write_term_index(pages, str(tmp_path / "t"))
    got = spark.read.parquet(str(tmp_path / "t")).where("term = 'اب'").collect()
    assert {r["page_id"]: r["positions"] for r in got} == {r[2]: at(r[10], ["اب"]) for r in rows if "اب" in r[10]}


def test_postings_agree_with_page_scans(spark, pages, rows, tmp_path):
    corpus.write_term_index(pages, str(tmp_path / "i"))
    ix, s = TermIndex.open(spark, str(tmp_path / "i")), Search(pages)
    got = lambda df, c="positions": {r["page_id"]: r[c] for r in df.collect()}
    hits = lambda node: got(s.hits(node, limit=1000), "matched_token_indices")
    assert got(ix.phrase(["اب", "كتب"])) == hits(nodes.term("اب كتب", "surface"))
    assert got(ix.near("اب", "كتب", 2)) == hits(nodes.near(("اب", "surface"), ("كتب", "surface"), 2))
    assert got(ix.prefix("اب")) == hits(nodes.wildcard("اب*")) and got(ix.prefix("كت", "ب")) == hits(nodes.wildcard("كت*ب"))
    assert got(all_of([ix.term("اب"), ix.term("من")])) == hits(nodes.combined([("اب", "surface"), ("من", "surface")]))
    assert got(any_of([ix.term("اب"), ix.term("من")])) == hits(nodes.combined([], [("اب", "surface"), ("من", "surface")]))
    assert "EqualTo(term,اب)" in ix.term("اب")._jdf.queryExecution().toString()


def test_streaming_gives_what_batch_gives(spark, pages, rows, tmp_path):
    base = pages.drop("surface_j", "lemma_j", "root_j")
    base.repartition(3).write.parquet(str(tmp_path / "in"))
    node = nodes.near(("اب", "surface"), ("كتب", "surface"), 2)
    q = ingest.to_parquet(ingest.standing_query(ingest.page_stream(spark, str(tmp_path / "in"), 1), node), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert ids(spark.read.parquet(str(tmp_path / "out"))) == ids(Search(pages).matching(node))


def test_token_ids(spark):
    blobs = spark.createDataFrame([(bytearray([1, 2, 3, 4]),), (bytearray([1, 2, 3, 4, 9]),), (bytearray(),), (bytearray([255] * 4),)], "b binary")
    assert [r[0] for r in blobs.select(tok.decode_ids(F.col("b"))).collect()] == [[67305985], [67305985], [], [4294967295]]
    n = spark.createDataFrame([([5, 70000, 4294967295],)], "x array<bigint>")
    assert n.select(tok.decode_ids(tok.encode_ids(F.col("x")))).first()[0] == [5, 70000, 4294967295]


def test_overlay_keeps_places(spark, pages):
    d, packed = tok.dictionary_of(corpus.tokens(pages))
    full = tok.page_tokens(packed, d)
    assert full.count() == corpus.tokens(pages).count()
    d.definitions = d.definitions.where("id != 1")
    t = tok.page_tokens(packed, d)
    assert t.count() == full.count() and t.where("lemma = 'unknown' and pos = 'UNK' and root is null").count() == full.count() - full.join(d.definitions.select("surface").distinct(), "surface", "left_semi").count()
    with pytest.raises(ValueError):
        tok.find_positions(t, "pos", "x")


def test_history_and_saved(spark):
    empty = spark.createDataFrame([], store.HISTORY)
    h = lambda i: spark.createDataFrame([(i, "term", f"q{i % 4}", "l", 0, None, f"2024-01-01T00:{i:02}:00Z")], store.HISTORY)
    t = empty
    for i in range(5):
        t = store.add_history(t, h(i), keep=3)
    assert sorted(r["id"] for r in t.collect()) == [2, 3, 4]
    saved = spark.createDataFrame([(1, "q3")], "id bigint, query_data string")
    assert {r["id"]: r["is_saved"] for r in store.history_with_saved(t, saved).collect()} == {2: False, 3: True, 4: False}
    twice = spark.createDataFrame([(7, "q3"), (8, "q9"), (9, "q9")], "id bigint, query_data string")
    assert sorted(map(tuple, store.save_search(saved, twice).collect())) == [(1, "q3"), (8, "q9")]
    assert store.is_saved(saved, "q3") and not store.is_saved(store.unsave(saved, query_data="q3"), "q3")


def test_store_and_collections(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"))
    c = store.create_collection(s.get("collections"), "a", [1, 2], "t1", "d" * 200)
    s.put("collections", c)
    c = s.get("collections")
    assert len(c.first()["description"]) == 150
    with pytest.raises(ValueError):
        store.create_collection(c, "a", [], "t2")
    with pytest.raises(KeyError):
        store.update_collection(c, 99, "t2", name="z")
    s.put("collections", store.update_collection(c, 1, "t2", name="b", book_ids=[5]))
    row = s.get("collections").first()
    assert (row["name"], row["book_ids"], row["updated_at"]) == ("b", [5], "t2")
    s.put("collections", store.delete_collection(s.get("collections"), 1))
    assert s.get("collections").count() == 0
    s.put("user_settings", store.put_setting(store.put_setting(s.get("user_settings"), "k", "1"), "k", "2"))
    assert store.get_setting(s.get("user_settings"), "k") == "2" and store.get_setting(s.get("user_settings"), "x") is None
    s.put("dismissed", store.dismiss(store.dismiss(s.get("dismissed"), ["a"], "t"), ["a", "b"], "t"))
    assert s.get("dismissed").count() == 2
    s.clear("dismissed")
    assert s.get("dismissed").count() == 0


def test_manifests(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"corpus_version": "2", "schema_version": 1, "min_app_version": "0.1.0", "built_at": "x", "files": [{"name": n, "hash": h, "size": 10} for n, h in (("a", "1"), ("b", "2"), ("c", "3"), ("e", "5"))]}, indent=1))
    (tmp_path / "l.json").write_text(json.dumps({"corpus_version": "1", "schema_version": 1, "downloaded_at": "x", "files": {n: {"hash": h, "size": 10, "complete": ok} for n, h, ok in (("a", "1", True), ("b", "9", True), ("c", "3", False), ("d", "4", True), ("e", "5", True))}}))
    remote = manifest.remote_files(manifest.read_manifest(spark, str(tmp_path / "r.json"), manifest.REMOTE))
    # A map of file names is read by giving its keys: JSON objects fit map columns.
    local = manifest.local_files(manifest.read_manifest(spark, str(tmp_path / "l.json"), manifest.LOCAL))
    disk = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "name string")
    missing = manifest.missing_files(remote, local, disk)
    assert tuple(manifest.download_size(missing).first()) == (30, ["b", "c", "e"])
    assert [r["name"] for r in manifest.orphans(remote, local).collect()] == ["d"]
    assert manifest.read_manifest(spark, str(tmp_path / "none.json"), manifest.LOCAL) is None
    assert not manifest.is_complete(local, disk) and manifest.is_complete(local.where("name in ('a', 'b')"), disk)
    assert not manifest.is_complete(local.where("name = 'e'"), disk)
    r, here = {"min_app_version": "0.5.0", "schema_version": 1, "corpus_version": "2"}, {"schema_version": 1, "corpus_version": "1"}
    x = manifest.corpus_status(r, here, "1.0.0", (30, ["b"]))
    assert not x.ready and x.update_available and (x.missing_files, x.total_download_size, x.local_version, x.remote_version) == (["b"], 30, "1", "2")
    assert "at least 0.5.0" in manifest.corpus_status(r, here, "0.4.9").error
    rel = spark.createDataFrame([("1.3.0", "1.0.0", [("1.1.0", "", False, "new", ("w", "m", "l")), ("1.2.0", "", True, "", None)])], manifest.RELEASES)
    row = manifest.update_status(rel, "1.1.0", "windows").first()
    assert (row["update_required"], row["update_available"], row["release_notes"], row["download_url"], row["min_supported_version"]) == (True, True, "new", "w", "1.0.0")
    assert manifest.update_status(rel.withColumn("releases", F.slice("releases", 1, 0)), "x").first()["release_notes"] is None


def test_announcements(spark):
    row = lambda i, target, start, end, prio, once, least=None: (i, "", "", "", "", target, least, None, start, end, prio, True, once, None)
    t = spark.createDataFrame([row("n1", "all", "2024-01-01", None, "normal", False), row("f1", "desktop", "2024-01-02", None, "forced", True), row("w", "web", "2024-01-01", None, "forced", False), row("late", "all", "2025-01-01", None, "forced", False), row("gone", "all", "2023-01-01", "2023-02-01", "forced", False), row("i1", "all", "2024-01-03", None, "important", True), row("new", "all", "2024-01-01", None, "normal", False, "9.0.0"), row("n2", "all", "2024-01-05", None, "normal", False)], manifest.ANNOUNCEMENT)
    seen = spark.createDataFrame([("f1", ""), ("i1", "")], store.DISMISSED)
    now = datetime.datetime(2024, 6, 1)
    assert [r["id"] for r in manifest.eligible_announcements(t, seen, now, "1.0.0").collect()] == ["f1", "n2", "n1"]
    assert [r["id"] for r in manifest.eligible_announcements(t, seen, now, "1.0.0", skip_normal=True).collect()] == ["f1"]
    assert [r["id"] for r in manifest.eligible_announcements(t, seen, now, "1.0.0", web=True).collect()] == ["w", "n2", "n1", "new"]


def test_exports(spark, pages, tmp_path):
    books = spark.createDataFrame([(1, "c", 'T, "x"', 5, 100, 1, 2, 3, 4, "o", True, None, None, None)], "id bigint, corpus string, title string, author_id bigint, death_ah bigint, century_ah bigint, genre_id bigint, page_count bigint, token_count bigint, original_id string, paginated boolean, tags string, book_meta string, author_meta string")
    authors, genres = spark.createDataFrame([(5, "A")], "id bigint, author string"), spark.createDataFrame([], "id bigint, genre string")
    path = tmp_path / "b.csv"
    export.write_csv(export.books_sheet(books, authors, genres), str(path))
    assert path.read_text(encoding="utf-8").split("\n")[1] == '1,"T, ""x""",A,5,100,1,,2,3,4,c,o,Yes' and path.read_bytes()[:3] == b"\xef\xbb\xbf"
    hits = metadata.enriched(Search(pages).hits(nodes.term("اب", "surface"), limit=3), books, authors, genres)
    assert export.results_sheet(hits).columns[0] == "Book ID" and hits.count() == 3
    export.write_csv_dir(export.authors_sheet(metadata.author_rollup(books, authors, genres)), str(tmp_path / "a"))
    ranges = highlight.highlight_ranges(spark.createDataFrame([("اب كتب", [1])], "body string, matched_token_indices array<int>")).first()["ranges"]
    assert [tuple(r) for r in ranges] == [(3, 6)]


def test_unknown_author_and_workbook(spark, tmp_path):
    from zipfile import ZipFile

    schema = "id bigint, author_id bigint, death_ah bigint, genre_id bigint, page_count bigint"
    books = spark.createDataFrame([(1, None, None, 1, 5), (2, 5, 300, 1, 1), (3, 5, 200, None, 2), (4, 6, 90, 1, 3)], schema)
    authors, genres = spark.createDataFrame([(5, "<A> & \x01b")], "id bigint, author string"), spark.createDataFrame([(1, "g")], "id bigint, genre string")
    rollup = metadata.author_rollup(books, authors, genres)
    assert {r["author_id"]: (r["author"], r["death_ah"]) for r in rollup.collect()} == {-1: ("Unknown", None), 5: ("<A> & \x01b", 200), 6: ("Unknown", 90)}
    sheet = export.authors_sheet(rollup)
    assert "Unknown,,,1,5,g" in {r["value"] for r in export.csv_lines(sheet).collect()}
    export.write_xlsx({"Authors": sheet, "Other": genres}, str(tmp_path / "a.xlsx"))
    with ZipFile(tmp_path / "a.xlsx") as z:
        import xml.etree.ElementTree as ET

        assert z.testzip() is None and all(ET.fromstring(z.read(n)) is not None for n in z.namelist())
        one = z.read("xl/worksheets/sheet1.xml").decode()
        assert one.count("<row ") == 4 and "&lt;A&gt; &amp; b" in one and '<c r="C2"><v>90</v></c>' in one and 'name="Authors"' in z.read("xl/workbook.xml").decode()
    with pytest.raises(ValueError):
        export.write_xlsx({"Authors": sheet}, str(tmp_path / "b.xlsx"), most=2)


def test_corpus_opens_from_a_folder_and_a_database(spark, pages, tmp_path):
    import sqlite3

    d, packed = tok.dictionary_of(corpus.tokens(pages))
    books = spark.createDataFrame([(i, "c", f"T{i}", i % 3, 100 + i, 1, 2, 3, 4, "o", True, None, None, None) for i in range(5)], "id bigint, corpus string, title string, author_id bigint, death_ah bigint, century_ah bigint, genre_id bigint, page_count bigint, token_count bigint, original_id string, paginated boolean, tags string, book_meta string, author_meta string")
    tables = {"page_tokens": packed, "token_definitions": d.definitions, "roots": d.roots, "lemmas": d.lemmas, "pos_types": d.pos_types, "feature_sets": d.feature_sets, "clitic_sets": d.clitic_sets, "books": books, "authors": spark.createDataFrame([(0, "A"), (1, "B")], "id bigint, author string"), "genres": spark.createDataFrame([(2, "g")], "id bigint, genre string")}
    folder, user = str(tmp_path / "corpus"), str(tmp_path / "user")
    corpus.write_tables(tables, folder)
    pages.drop("surface_j", "lemma_j", "root_j").write.parquet(f"{folder}/pages")
    with sqlite3.connect(tmp_path / "corpus.db") as db:
        for name, df in tables.items():
            db.execute(f"CREATE TABLE {name} ({', '.join(df.columns).replace('text_id', 'book_id')})")
            db.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(df.columns))})", [tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in df.collect()])
    here, there = Corpus.open(spark, folder, user), Corpus.open_database(spark, f"{folder}/pages", str(tmp_path / "corpus.db"), user, server=True)
    plain = lambda df: sorted(map(str, df.collect()))
    key = tuple(packed.where("length(token_ids) > 8").select("text_id", "part_index", "page_id").first())
    want = plain(here.all_tokens().where(f"text_id = {key[0]} and part_index = {key[1]} and page_id = {key[2]}"))
    for c in (here, there):
        assert plain(c.page_tokens(key)) == want and len(want) > 2
        assert c.token_at(key, 1).count() == 1 and c.token_at(key, 999).count() == 0
        assert tuple(c.stats().first()) == (60, 5) and plain(c.books()) == plain(books) and c.book(3).first()["title"] == "T3"
        assert c.authors().count() == 2 and c.genres().count() == 1 and c.centuries().first()["n_books"] == 5 and c.search_authors("AAA").count() == 0
        assert c.list_books(genre_id=2).count() == 5 and c.list_books_filtered(death_ah_min=103).count() == 2
        assert c.enriched(c.search("اب", "surface")).count() == min(50, len(ids(c.matching(nodes.term("اب", "surface")))))
    assert plain(there.all_tokens()) == plain(here.all_tokens()) and there.max_limit == 100
    here.store.put("collections", store.create_collection(here.store.get("collections"), "mine", [1, 4], "t"))
    assert sorted(r["id"] for r in there.text_selection(metadata.BookFilter(death_min=102), ["mine"]).collect()) == [4]
    assert there.text_selection(metadata.BookFilter(text="t1")).count() == 1
    with pytest.raises(FileNotFoundError):
        corpus.read_tables(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError):
        Corpus(pages, {}).store  # noqa: B018


def test_selections(spark):
    assert metadata.toggled([1, 2], [2, 3]) == [1, 2, 3] and metadata.toggled([1, 2, 3], [2, 3]) == [1] and metadata.toggled([], []) == []
    t = lambda *x: spark.createDataFrame([(i,) for i in x], "id bigint")
    assert metadata.selection_differs(t(1, 2), t(1)) and not metadata.selection_differs(t(1, 2), t(2, 1))


def test_reader_and_snippet(spark):
    df = spark.createDataFrame([(1, 0, 1, "قال، الإ1مام abc رحمه الله", [1]), (1, 0, 2, "abc", [])], "text_id int, part_index int, page_id int, body string, matched_token_indices array<int>")
    spans = {r["page_id"]: [(x["text"], x["token"], x["lit"]) for x in r["spans"]] for r in highlight.reader_spans(df).collect()}
    assert spans[1][:6] == [("قال", 0, False), ("،", None, False), (" ", None, False), ("الإ", 1, True), ("1", None, False), ("مام", 1, True)]
    assert "".join(x[0] for x in spans[1]) == df.first()["body"] and spans[2] == [(c, None, False) for c in "abc"]
    tokens = spark.createDataFrame([(1, 0, 1, 1, "الإمام")], "text_id int, part_index int, page_id int, idx int, surface string")
    got = {r["at"]: r["surface"] for r in highlight.reader_tokens(highlight.reader_spans(df), tokens).where("page_id = 1").collect()}
    assert got[3] == got[5] == "الإمام" and got[0] is None and len(got) == len(spans[1])
    cut = lambda size, before: [r[0] for r in df.select(highlight.kwic(F.col("body"), F.col("matched_token_indices"), size, before)).collect()]
    assert cut(50, 5) == ["قال، الإ1مام abc رحمه الله", "abc"] and cut(2, 0)[0] == "… الإ1مام abc رحمه"


def test_author_search_needs_three_bytes(spark):
    authors = spark.createDataFrame([(1, "ابو"), (2, "Xab")], "id bigint, author string")
    books = spark.createDataFrame([(1, 1, 90)], "id bigint, author_id bigint, death_ah bigint")
    assert metadata.search_authors(authors, books, "ab").count() == 0
    assert [r["id"] for r in metadata.search_authors(authors, books, "اب").collect()] == [1]


def test_reader_spans_of_odd_and_long_texts(spark):
    """as the character map says, in memory that the texts bound."""
    odd = ["", None, "١قا1ل،\U00010330 اب", "،،", "ا" * 3000, "اب\n\tج دa ه", " ا", "ـُا x", "a" * 10]
    rows = [(i, t, m) for i, t in enumerate(odd) for m in ([0], [1, 2, 99, -1], None)]
    df = spark.createDataFrame(rows, "page_id int, body string, matched_token_indices array<int>")
    got = sorted(((r["page_id"], [tuple(x) for x in r["spans"]]) for r in highlight.reader_spans(df).collect()), key=str)

    def pieces(text, matched):
        out, last = [], None
        for ch, token in zip(text, arabic.token_map(text)):
            if token is not None and token == last:
                out[-1] = (out[-1][0] + ch, *out[-1][1:])
            else:
                out.append((ch, token, token is not None and token in matched))
            last = token
        return out

    assert got == sorted(((i, pieces(t or "", set(m or ()))) for i, t, m in rows), key=str)


def test_reader_spans_memory(spark):
    """3,000 texts of 4,000 characters in one task; objects for each piece took over 2 GB of the worker."""
    import threading

    psutil = pytest.importorskip("psutil")
    df = spark.range(0, 3000, 1, 1).select(F.col("id").alias("page_id"), F.lit("اب ج، " * 660).alias("body"), F.array(F.lit(1)).alias("matched_token_indices"))
    most, over = [0], threading.Event()

    def watch():
        while not over.wait(0.1):
            for p in psutil.Process().children(recursive=True):
                try:
                    most[0] = max(most[0], 0 if "java" in p.name() else p.memory_info().rss >> 20)
                except psutil.Error:
                    pass

    t = threading.Thread(target=watch)
    t.start()
    try:
        assert highlight.reader_spans(df).select(F.sum(F.size("spans"))).first()[0] == 3000 * 660 * 5
    finally:
        over.set()
        t.join()
    assert 0 < most[0] < 800


def test_pages_from_documents_as_built_in_functions_have_them(spark):
    """the numpy tokens against the expressions on rows, odd texts among them."""
    texts = ["The cat sat \x0b on\tthe\r\nmat", "", None, "  ", "ﻙ Éًà", "qgod jQz", "wya aei ووو ذذ", "\U0001F600 Ab\U0001F600cde", "أإآؤئى ٱب", "x" * 3000, "\x1c a \x85 b"]
    docs = spark.createDataFrame([(i, t, ("en", "de", "xx")[i % 3], f"src{i % 9}") for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string")
    surface = arabic.words(arabic.fold_column(F.translate("text", corpus.LATIN, corpus.SCRIPT)))
    root = lambda s: F.array_join(F.split(F.translate(F.substring(F.regexp_replace(s, "[جذضق]", ""), 1, 3), "وياء", "####"), ""), ".")
    want = docs.select(F.col("doc_id").alias("page_id"), surface.alias("surface"), F.transform(surface, lambda s: F.substring(s, 1, 4)).alias("lemma"), F.transform(surface, lambda s: F.nullif(root(s), F.lit(""))).alias("root"))
    got = corpus.pages_from_documents(docs)
    assert "surface_j" in got.columns and sorted(got.select(*want.columns).collect(), key=str) == sorted(want.collect(), key=str)


def test_pages_are_spread_and_made_without_lambdas(spark, tmp_path):
    """one file of texts isn't one task, and no word goes through interpreted functions."""
    from quarry.plans import catalogue

    spark.createDataFrame([(1, "The cat", "en", "src1", 7)], "doc_id bigint, text string, lang string, source string, n_chars bigint").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    plan = corpus.pages_from_documents(catalogue.documents(spark, str(tmp_path)))._jdf.queryExecution().toString()
    assert "hashpartitioning(doc_id" in plan and "lambdafunction" not in plan and "regexp" not in plan


def test_postings_are_packed_before_they_move(spark, pages, rows):
    """no row for each token; blocks of few tokens, missing tokens, null keys and pages of one key give what rows give."""

    def brute(df, stream):
        t = corpus.tokens(df).where(f"{stream} is not null")
        return t.groupBy(F.col(stream).alias("term"), "text_id", "part_index", "page_id").agg(F.array_sort(F.collect_list("pos")).alias("positions"))

    for stream in ("surface", "root"):
        for most in (1, 7, 1 << 20):
            for df in (pages.repartition(3), pages.withColumn("text_id", F.when(F.col("text_id") > 1, F.col("text_id"))), pages.withColumn("page_id", (F.col("page_id") / 2).cast("int")), pages.limit(0)):
                got = corpus.postings(df, stream, most)
                assert sorted(got.collect(), key=str) == sorted(brute(df, stream).collect(), key=str) and got.dtypes == brute(df, stream).dtypes
    assert "Generate" not in corpus.postings(pages)._jdf.queryExecution().toString()
    one = corpus.postings(pages).withColumn("p", F.spark_partition_id()).collect()
    assert all(a["term"] <= b["term"] for a, b in zip(one, one[1:]) if a["p"] == b["p"])


@pytest.mark.parametrize("most", [3, 1_000_000])
def test_large_dictionaries_meet_pages_by_block(spark, pages, monkeypatch, most):
    """tokens of a dictionary too large to send aren't shuffled one by one; placeholders and places stay."""
    monkeypatch.setattr(tok, "BROADCAST_ROWS", most)
    key = ["text_id", "part_index", "page_id"]
    d, packed = tok.dictionary_of_pages(pages.repartition(3))
    assert sorted(r["id"] for r in d.definitions.collect()) == list(range(1, d.definitions.count() + 1))
    d.definitions = d.definitions.where("id != 2")
    gone = pages.select(F.explode(F.arrays_zip("surface", "lemma", "root")).alias("t")).select("t.*").distinct().orderBy("surface", "lemma", "root").collect()[1]["surface"]
    odd = packed.withColumn("token_ids", F.concat("token_ids", F.lit(b"\x01"))).union(spark.createDataFrame([(77, 0, 1, None)], packed.schema))
    t = tok.page_tokens(odd, d)
    want = sorted((r["text_id"], r["part_index"], r["page_id"], r["pos"], "�" if r["surface"] == gone else r["surface"], "unknown" if r["surface"] == gone else r["lemma"], None if r["surface"] == gone else r["root"] or "", "UNK" if r["surface"] == gone else "noun") for r in corpus.tokens(pages).collect())
    got = sorted((r["text_id"], r["part_index"], r["page_id"], r["idx"], r["surface"], r["lemma"], None if r["pos"] == "UNK" else r["root"] or "", r["pos"]) for r in t.collect())
    assert got == want and "noclitic_surface" in t.columns
    if most == 3:
        assert "hashpartitioning(block" in t._jdf.queryExecution().toString()


def test_packed_segments_answer_as_rows_do(spark, pages, rows, tmp_path):
    """a row for each group of terms and no shuffle; null keys, small blocks and groups, and pages of one key give what rows give."""
    flat = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    odd = pages.withColumn("text_id", F.when(F.col("text_id") > 1, F.col("text_id"))).repartition(3)
    for n, (df, most, group) in enumerate([(pages, 1 << 23, 1 << 15), (odd, 60, 1), (odd, 200, 300), (pages.limit(0), 1 << 23, 1)]):
        packed = corpus.segments(df.select(*corpus.KEY, "surface_j"), most, group)
        assert "Exchange" not in corpus.segments(pages, most, group)._jdf.queryExecution().executedPlan().toString()
        packed.write.parquet(str(tmp_path / f"s{n}"))
        a, b = TermIndex.open(spark, str(tmp_path / f"s{n}")), TermIndex(corpus.postings(df))
        assert a.packed and not b.packed and flat(a.frequencies()) == flat(b.frequencies()) and a.frequencies().dtypes == b.frequencies().dtypes
        for w in ("اب", "قول", "no", "", "ي"):
            assert flat(a.term(w)) == flat(b.term(w)) and flat(a.prefix(w)) == flat(b.prefix(w))
        assert flat(a.prefix("اب", "ه")) == flat(b.prefix("اب", "ه")) and flat(a.prefix("ابن", "نه")) == flat(b.prefix("ابن", "نه"))
        assert flat(a.near("اب", "من", 2)) == flat(b.near("اب", "من", 2)) and a.term("اب").dtypes == b.term("اب").dtypes
    corpus.write_term_segments(pages.select(*corpus.KEY, "surface_j"), str(tmp_path / "one"))
    written = spark.read.parquet(str(tmp_path / "one"))
    assert written.count() < len(VOCAB) * written.rdd.getNumPartitions() + 1 and written.count() < TermIndex(corpus.postings(pages)).frequencies().agg(F.sum("n_pages")).first()[0] / 4
    shared = pages.select("text_id", "part_index", (F.col("page_id") / 2).cast("bigint").alias("page_id"), "surface_j", "surface", "lemma", "root")
    corpus.write_term_segments(shared, str(tmp_path / "shared"), shared.select(*corpus.KEY))
    assert flat(TermIndex.open(spark, str(tmp_path / "shared")).term("من")) == flat(TermIndex(corpus.postings(shared)).term("من"))


def test_stored_pages_hold_one_string_and_give_the_same_table(spark, tmp_path):
    """F14 to F20: what is written of a page has no array of tokens, and each column comes out as numpy tokenises it."""
    from quarry.plans import catalogue

    texts = ["The cat sat \x0b on\tthe\r\nmat", "", None, "  ", " \n", "ﻙ Éًà", "qgod jQz", "wya aei ووو ذذ", "\U0001F600 Ab\U0001F600cde", "أإآؤئى ٱب", "x" * 3000, "\x1c a \x85 b", "~ ج ج ~ق ق~ جذ a~b", "ًّ a ً b", " $1 \\ a$b \\S", "   x", "~~ ~~~~~ ج"]
    docs = spark.createDataFrame([(i, t, ("en", "de", "xx")[i % 3], f"src{i % 9}" if i != 5 else None, 1) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    want = corpus.pages_from_documents(docs)
    got = catalogue.pages(spark, str(tmp_path))
    assert got.dtypes == want.dtypes and sorted(got.collect(), key=str) == sorted(want.collect(), key=str)
    assert not [c for c, kind in catalogue.stored(spark, str(tmp_path)).dtypes if kind.startswith("array")]
    plan = Search(got).keys(nodes.near(("اب", "surface"), ("كتب", "surface"), 3))._jdf.queryExecution().executedPlan().toString()
    assert "body" not in plan and "split" not in plan


def test_wide_proximity_splits_a_page_once(spark):
    """over tokens that are split when read, no function of a word holds the whole page."""
    n = 3000
    docs = spark.createDataFrame([(1, "of " + "x " * n + "to", "en", "src1"), (2, "of " + "x " * (n + 1) + "to", "en", "src1"), (3, "", "en", "src1")], "doc_id bigint, text string, lang string, source string")
    pages = corpus.with_streams(corpus.stored_pages(docs))
    fold = lambda w: arabic.fold(w.translate(str.maketrans(corpus.LATIN, corpus.SCRIPT)))
    hit = Search(pages).matching(nodes.near((fold("of"), "surface"), (fold("to"), "lemma"), n + 1))
    assert ids(hit) == {1}
    plan = hit._jdf.queryExecution().optimizedPlan().toString()
    assert not [part for part in plan.split("lambdafunction(")[1:] if part.split("lambda ")[0].count("split(")]


def test_one_page_is_had_without_the_others(spark, tmp_path):
    """positions on one page write no page table, and are those that the built table gives."""
    from quarry.plans import catalogue

    key = (spark.sparkContext.applicationId, str(tmp_path))
    docs = spark.createDataFrame([(i, f"of the cat {i} of of the", "en", f"src{i % 9}", 1) for i in (1, 2, 2, 11)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    one_page = ("page_lookup", "page_with_matches", "page_positions", "positions_combined", "positions_names", "positions_wildcard", "positions_multi")
    alone = {name: catalogue.QUERIES[name](spark, str(tmp_path)).collect() for name in one_page}
    assert key not in catalogue._BUILT and alone["positions_names"][0]["positions"] == "0,1,4,5,6"
    plan = catalogue.QUERIES["positions_names"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(doc_id,2)" in plan and "Exchange" not in plan
    catalogue.pages(spark, str(tmp_path))
    assert key in catalogue._BUILT and alone == {name: catalogue.QUERIES[name](spark, str(tmp_path)).collect() for name in one_page}


def test_lemma_and_root_strings_are_laid_down_for_queries_on_them(spark, tmp_path):
    """F15 to F19, the shared step: such a query reads strings instead of working them out by patterns, and they are the same."""
    from quarry.plans import catalogue

    texts = ["The cat sat \x0b on\tthe\r\nmat", "", None, "  ", " \n", "ﻙ Éًà", "qgod jQz", "wya aei ووو ذذ", "\U0001F600 Ab\U0001F600cde", "أإآؤئى ٱب", "x" * 3000, "\x1c a \x85 b", "~ ج ج ~ق ق~ جذ a~b", "ًّ a ً b", " $1 \\ a$b \\S", "   x", "~~ ~~~~~ ج", "ج"]
    docs = spark.createDataFrame([(i, t, "en", f"src{i % 9}", 1) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    narrow = corpus.with_streams(corpus.stored_pages(docs))
    for df in (docs, docs.limit(0)):
        got = corpus.with_streams(corpus.with_other_strings(corpus.stored_pages(df)))
        want = corpus.with_streams(corpus.stored_pages(df))
        assert got.columns == want.columns and sorted(got.collect(), key=str) == sorted(want.collect(), key=str)
    surface = catalogue.stored(spark, str(tmp_path))
    assert "root_j" not in surface.columns and "regexp" not in catalogue.QUERIES["bool_mixed_modes"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(catalogue.pages(spark, str(tmp_path)).collect(), key=str) == sorted(narrow.collect(), key=str) and catalogue.stored(spark, str(tmp_path)).columns[-1] == "root_j"
    assert nodes.combined([("a", "surface"), ("b", "lemma")], [("c", "root"), ("d", "root")]).streams() == {"surface", "lemma", "root"} and nodes.near(("a", "surface"), ("b", "lemma"), 3).streams() == {"surface", "lemma"} and nodes.combined([]).streams() == set()


def test_texts_are_not_read_into_direct_memory_too(spark, tmp_path):
    """F16: a row group is held once, in the heap; a vectored read keeps as many bytes more outside it."""
    from quarry.plans import catalogue

    r = random.Random(5)
    docs = [(i, r.randbytes(1 << 20).hex(), "en", "src1", 1) for i in range(24)]
    table = pa.Table.from_pylist([dict(zip(("doc_id", "text", "lang", "source", "n_chars"), d)) for d in docs])
    pq.write_table(table, tmp_path / "documents.parquet", compression="none", use_dictionary=False)
    beans = spark._jvm.java.lang.management.ManagementFactory.getPlatformMXBeans(spark._jvm.java.lang.Class.forName("java.lang.management.BufferPoolMXBean"))
    direct = lambda: next(b.getMemoryUsed() for b in beans if b.getName() == "direct")
    before = direct()
    got = catalogue.documents(spark, str(tmp_path)).agg(F.sum(F.length("text"))).first()[0]
    assert got == 24 << 21 and direct() - before < 24 << 20
