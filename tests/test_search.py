import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from verbatlas.config import IndexConfig
from verbatlas.functions import text
from verbatlas.operators import dictionary, search
from verbatlas.plans.search_index import SearchIndex

SONGS = IndexConfig(("title",), ("genre",), k=10)
PRODUCTS = IndexConfig(("title", "tags"), ("genre",), k=10)


def ids(hits):
    return [r.external_id for r in hits.collect()]


def build(spark, rows, schema, config):
    return SearchIndex.build(spark.createDataFrame(rows, schema), config, order=["id"])


def test_tokenizer(spark):
    odd = "İK café don't foo-bar The AND x\x85y\x0bz  A. ​ q"
    want = ["ik", "caf", "dont", "foobar", "x", "y", "z", "q"]
    assert text.tokenize(odd) == want
    assert spark.createDataFrame([(odd,)], "t string").select(text.tokens(F.col("t"))).first()[0] == want


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(max_size=30), min_size=1, max_size=20))
def test_tokenizer_twins(spark, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", text.tokens(F.col("t")).alias("w")).orderBy("k").collect()
    for r, t in zip(rows, texts):
        if t.lower().isascii() or all(len(c.lower()) == 1 for c in t):
            assert r.w == text.tokenize(t)


def test_one_term_and_dead_documents(spark):
    posted = spark.createDataFrame([("apple", 1, 10), ("apple", 2, 20), ("apple", 3, 5), ("phone", 2, 25), ("phone", 3, 40)], "term string, internal_id bigint, score bigint").where("internal_id <> 3")
    assert [(r.internal_id, r.score) for r in search.one_term(posted, "apple", 100).collect()] == [(2, 20), (1, 10)]
    assert [r.internal_id for r in search.one_term(posted, "phone", 100).collect()] == [2]


def test_groups(spark):
    rows = [("apple", {1: 10, 2: 20, 3: 5}), ("mapple", {4: 7, 2: 20, 7: 5}), ("iphone", {10: 30, 2: 15}), ("phone", {7: 25, 12: 40}), ("phona", {70: 25})]
    posted = spark.createDataFrame([(t, i, s) for t, d in rows for i, s in d.items() if i != 3], "term string, internal_id bigint, score bigint")
    groups = [["apple", "mapple"], ["iphone", "phone", "phona"]]
    asked = spark.createDataFrame([(0, 2, g, r, t) for g, ts in enumerate(groups) for r, t in enumerate(ts)], "query_id int, n_groups int, group_id int, rank int, term string")
    assert [(r.internal_id, r.score) for r in search.all_groups(asked, posted, 2).orderBy("rank").collect()] == [(2, 35), (7, 30)]


def test_fuzzy_prefix_ranking(spark):
    rows = [("1", "apple phone phone", "phone mobile", "tech"), ("2", "apple phone", "phone", "tech"), ("3", "apple device", "phone", "tech"), ("4", "apple something else", "other", "tech")]
    hits = build(spark, rows, "id string, title string, tags string, genre string", PRODUCTS).search("appre pho").collect()
    assert [(r.external_id, r.score) for r in hits] == [("2", 99999), ("1", 80000), ("3", 66666)]


def test_upserts_deletes_and_vacuum(spark):
    index = build(spark, [("1", "Sunny Rio", "rock"), ("2", "Rio Nights", "pop"), ("3", "Cloudy Day", "jazz")], "id string, title string, genre string", SONGS)
    assert sorted(ids(index.search("rio"))) == ["1", "2"]
    index = index.upsert(spark.createDataFrame([("2", "Sunny Days", "pop")], "id string, title string, genre string"))
    assert ids(index.search("rio")) == ["1"] and sorted(ids(index.search("sunny"))) == ["1", "2"]
    index, gone = index.delete("1")
    assert gone and index.delete("1")[1] and not index.delete("9")[1] and not index.delete("")[1]
    assert ids(index.search("sunny")) == ["2"]
    assert ids(index.search("sunny", {"genre": ["rock"]})) == [] and ids(index.search("sunny", {"genre": ["pop", "x"]})) == ["2"]
    assert index.total_docs() == 4
    assert ids(index.search("nights")) == [] and index.vocabulary.where("term = 'nights'").count() == 1
    assert index.vacuum().vocabulary.where("term = 'nights'").count() == 0
    with pytest.raises(ValueError):
        index.upsert(spark.createDataFrame([(None, "x")], "id string, title string"))


def test_dead_term_suppresses_fuzzy_until_vacuum(spark):
    index = build(spark, [("1", "zebra", "a"), ("2", "zebre", "a")], "id string, title string, genre string", SONGS)
    index, _ = index.delete("1")
    assert ids(index.search("zebra")) == [] and ids(index.vacuum().search("zebra")) == ["2"]


def test_few_and_many_tokens_are_looked_up_alike(spark, monkeypatch):
    from verbatlas.operators import expand
    from verbatlas.plans import search_index

    rows = [("1", "apple phone case", "a"), ("2", "apples phones", "b"), ("3", "aple cases", "a"), ("4", "grape phone", "b")]
    index = build(spark, rows, "id string, title string, genre string", SONGS).upsert(spark.createDataFrame([("3", "applet phone", "a")], "id string, title string, genre string"))
    asked = spark.createDataFrame(list(enumerate(["apple", "appl", "aplle", "apple pho", "aple phne", "the", "case cas", "zz apple", "phone phone"])), "query_id long, text string")
    shown = lambda: sorted(map(tuple, index.search_many(asked).collect()))
    few = shown()
    monkeypatch.setattr(expand, "FEW", 0)
    assert few and shown() == few
    monkeypatch.setattr(search_index, "MOST_SENT", 0)
    assert shown() == few


def test_terms_reach_the_scan(spark, capsys):
    index = build(spark, [("1", "red blue", "a")], "id string, title string, genre string", SONGS)
    index.search_one_term("red").explain("formatted")
    shown = capsys.readouterr().out
    assert "EqualTo(term,red)" in shown or "In(term, [red])" in shown


def test_segments(spark):
    from verbatlas.tables import Segments

    table = Segments("t", ("v",), spark.createDataFrame([], "v int"))
    for n in range(9):
        table = table.appended(spark.createDataFrame([(n,)], "v int"))
        sizes = [size for size, _ in table.parts]
        assert all(a > 2 * b for a, b in zip(sizes, sizes[1:])) and table.rows == n + 1
    assert sorted(r.v for r in table.table.collect()) == list(range(9))
    assert table.appended(spark.createDataFrame([], "v int")).rows == 9


def test_percentiles_of_ties_nulls_and_large_groups(spark):
    from verbatlas.operators import stats

    rows = [("a", float(v % 7)) for v in range(500)] + [("b", 1.0), ("c", None), (None, 2.0), (None, 4.0)]
    found = stats.percentiles(spark.createDataFrame(rows, "g string, v double"), "g", "v", {"half": 0.5, "most": 0.95})
    ordered = sorted(v % 7 for v in range(500))
    assert {r.g: (r.n, r.half, r.most) for r in found.collect()} == {"a": (500, ordered[249], ordered[474]), "b": (1, 1.0, 1.0), None: (2, 2.0, 4.0)}


def test_commands(spark, tmp_path, capsys):
    import json as j
    import threading

    from verbatlas import commands
    from verbatlas.service import SearchService, serve

    words, data = str(tmp_path / "words"), str(tmp_path / "data")
    commands.main(["vocab", "--size", "50", "--out", words], spark)
    commands.main(["datagen", "--count", "40", "--vocab", words, "--out", data], spark)
    capsys.readouterr()
    commands.main(["benchmark", "--data", data, "--vocab", words, "--queries", "2"], spark)
    shown = j.loads(capsys.readouterr().out)
    assert shown["documents"] == 40 and shown["modes"]["multi, filtered"]["n"] == 2
    server = serve(SearchService(spark, str(tmp_path)), 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    commands.main(["loadtest", "--url", f"http://localhost:{server.server_address[1]}/search", "--vocab", words, "--requests", "6", "--workers", "2"], spark)
    shown = j.loads(capsys.readouterr().out)
    assert shown["requests"] == shown["errors"] == 6  # there is no such index
    server.shutdown()
    with pytest.raises(SystemExit):
        commands.main(["unknown"], spark)


def test_duplicate_hits_and_first_match(spark):
    index = build(spark, [("1", "phone phones", "a")], "id string, title string, genre string", SONGS)
    assert ids(index.search("phone")) == ["1", "1"]
    index = build(spark, [("1", "apple apples pie", "a")], "id string, title string, genre string", SONGS)
    assert [r.score for r in index.search("apple pie").collect()] == [66666]


def test_batch_duplicates(spark):
    rows = spark.createDataFrame([("1", "red", 1), ("1", "blue", 2)], "id string, title string, n int")
    index = SearchIndex.build(rows, SONGS, order=["n"])
    assert ids(index.search("red")) == ["1"] and ids(index.search("blue")) == ["1"]
    assert ids(index.vacuum().search("red")) == [] and ids(index.vacuum().search("blue")) == ["1"]
    assert ids(SearchIndex.build(rows, IndexConfig(("title",), duplicate_policy="last"), order=["n"]).search("red")) == []


def test_numbers_filters_and_missing_fields(spark):
    config = IndexConfig(("title", "absent"), ("year", "none"))
    for kind, value in (("int", 2020), ("double", 2020.0), ("string", "2020")):
        index = SearchIndex.build(spark.createDataFrame([("1", "x y", value)], f"id string, title string, year {kind}"), config)
        assert ids(index.search("x", {"year": ["2020"]})) == ["1"]
        assert ids(index.search("x", {"none": ["1"]})) == [] and ids(index.search("x", {"year": []})) == []
    shown = spark.createDataFrame([(1234567.0,), (0.00001,), (3.5,), (2020.0,), (1e7,)], "v double")
    assert [r[0] for r in shown.select(text.canonical(shown, "v", True)).collect()] == ["1.234567e+06", "1e-05", "3.5", "2020", "1e+07"]


def test_filter_strings():
    assert text.parse_filter("garbage") == {} and text.parse_filter("a:1,a:2,b:") == {"a": ["1", "2"], "b": [""]}


def test_empty_index_and_queries(spark):
    index = SearchIndex.empty(spark, SONGS)
    assert index.search("the a and") is None and index.search("x").collect() == []
    with pytest.raises(ValueError):
        IndexConfig(("x",), k=-1)


def test_deletion_dictionary(spark):
    words = ["black", "block", "back", "blacks", "slack", "flack"]
    d = dictionary.DeletionDictionary(spark, words)
    assert d.fuzzy("blacj", 9) == ["black"] and set(d.fuzzy("blac", 9)) == {"black", "back"}
    assert d.fuzzy("blackso", 9) == ["blacks"] and set(d.fuzzy("lack", 9)) == {"black", "flack", "slack", "back"}
    assert d.fuzzy("xyz", 9) == [] and d.delete("black").fuzzy("blacj", 9) == []
    assert dictionary.DeletionDictionary(spark, ["ab", "ac", "abc"]).fuzzy("ab", 9)[0] == "abc"


def test_dictionary(spark, tmp_path):
    d = dictionary.Dictionary.empty(spark).insert("app", "apple", "apple", "banana")
    assert d.complete("app", 5) == ["apple", "app"] and d.complete("zz", 5) == []
    words = dictionary.Dictionary.empty(spark).insert("black", "block", "back", "blacks", "slack", "flack")
    for query, want in [("black", ["black"]), ("blacj", ["black"]), ("blackk", ["black"]), ("blac", ["black"]), ("xyz", []), ("bck", ["back"])]:
        assert words.fuzzy(query, 1, 1) == want, query
    with pytest.raises(KeyError):
        d.remove("none")
    d = d.update("apple", "grape")
    assert d.complete("", 9) == ["app", "banana", "grape"]
    d.save(str(tmp_path / "d"))
    assert dictionary.Dictionary.load(spark, str(tmp_path / "d")).complete("", 9) == d.complete("", 9)
    assert dictionary.Dictionary.load(spark, str(tmp_path / "none")).complete("", 9) == []


def test_service(spark, tmp_path):
    from verbatlas.service import SearchService

    s = SearchService(spark, str(tmp_path))
    post = lambda path, body, **q: s.handle("POST", path, q, json.dumps(body).encode())
    assert s.handle("GET", "/create-index")[0] == 405 and post("/create-index", {})[0] == 400
    made = {"indexName": "i", "indexFields": ["name", "tags"], "filters": ["year"], "resultCount": 5}
    assert post("/create-index", made)[0] == 201 and post("/create-index", made)[0] == 409
    assert s.handle("GET", "/search", {"index": "none", "q": "x"})[0] == 404 and s.handle("GET", "/search", {})[0] == 400
    up = json.dumps([{"id": 1, "name": "Alpha one", "tags": ["red", 5, "blue"], "year": 2020}, None, {"id": "2", "name": "Beta", "tags": "red", "year": "2020"}, {"name": "no id"}]).encode()
    status, answer = s.handle("POST", "/add-to-index", {"indexName": "i"}, b"", up)
    assert status == 200 and answer["addedCount"] == 4 and answer["totalDocs"] == 2
    docs = s.handle("GET", "/search", {"index": "i", "q": "red", "filter": "year:2020"})[1]["response"]["Docs"]
    assert [d["ID"] for d in docs] == ["2", "1"]
    assert s.handle("GET", "/search", {"index": "i", "q": "the"})[1]["response"] is None
    assert s.handle("GET", "/search", {"index": "i", "q": "qqq"})[1]["response"] == {"Docs": None}
    assert s.handle("POST", "/add-to-index", {"indexName": "i"}, b"", b"id,name\n3,Gamma\n")[1]["addedCount"] == 1
    assert s.handle("POST", "/add-to-index", {"indexName": "i"}, b"", b"id,name\n3\n")[0] == 400
    assert post("/document", {"document": {"id": "2", "name": "Delta"}}, indexName="i")[0] == 200 and post("/document", {"document": {}}, indexName="i")[0] == 400
    assert s.handle("DELETE", "/document", {"indexName": "i", "id": "1"})[1]["deleted"] and s.handle("PUT", "/document") == (405, "method not allowed\n")
    assert post("/save-controller", {"indexName": "i"})[0] == 200 and post("/load-controller", {"indexName": "i"})[0] == 200
    assert post("/load-controller", {"indexName": "../x"})[0] == 400 and post("/load-controller", {"indexName": "no"})[0] == 500
    assert s.handle("GET", "/search", {"index": "i", "q": "delta"})[1]["response"]["Docs"][0]["ID"] == "2"
    assert s.handle("GET", "/health")[1]["status"] == "ok"


def test_stream_of_upserts(spark, tmp_path):
    from verbatlas.streaming.upserts import LiveIndex

    live = LiveIndex(SearchIndex.empty(spark, SONGS))
    src = tmp_path / "in"
    schema = "id string, op string, op_seq long, title string, genre string"
    spark.createDataFrame([("1", "upsert", 1, "red", "a"), ("2", "upsert", 2, "red", "b"), ("1", "upsert", 3, "blue", "a"), ("2", "delete", 4, None, None)], schema).write.parquet(str(src))
    live.follow(spark.readStream.schema(schema).parquet(str(src)), str(tmp_path / "c")).awaitTermination()
    assert ids(live.index.search("red")) == [] and ids(live.index.search("blue")) == ["1"]


def test_workload_is_seeded(spark):
    from verbatlas.sources import workload as w

    words = w.vocabulary(200)
    assert words == w.vocabulary(200) and len(set(words)) == 200
    assert w.documents(spark, words, 50).collect() == w.documents(spark, words, 50).collect()
    assert len(w.multi_queries(words, 9)) == len(w.single_queries(words, 9)) == 9 and all("year" in f for f in w.year_filters(3))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_whole_rows_are_posted_without_a_shuffle(spark):
    from verbatlas.operators import index

    rows = spark.createDataFrame([(1, 1, "1", 1, "red Blue red"), (2, 2, "2", 1, None), (3, 3, "3", 1, "the ,")], "internal_id long, target long, external_id string, batch int, title string")
    posted = index.postings(rows, SONGS, whole=True)
    assert sorted(map(tuple, posted.collect())) == [("blue", 1, 33333, 1), ("red", 1, 66666, 1)] == sorted(map(tuple, index.postings(rows, SONGS).collect()))
    deleted = index.deletion_table(spark.createDataFrame([("aabb", 1)], "term string, first_seen long"))
    assert sorted(r.key for r in deleted.collect()) == ["aab", "aabb", "abb"]
    assert "Exchange" not in _plan(posted) and "Exchange" not in _plan(deleted)


def test_postings_stay_where_they_are_when_nothing_is_dead(spark):
    index = build(spark, [("1", "red blue", "a")], "id string, title string, genre string", SONGS)
    assert "Join" not in _plan(index._visible(None))


def test_many_keys_are_not_broadcast(spark):
    from verbatlas.tables import among

    table = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    found = among(table, "k", spark.createDataFrame([("a",)], "x string").where("x <> ''").limit(1), False)
    assert [r.v for r in found.collect()] == [1] and "SortMergeJoin" in _plan(found) and "Broadcast" not in _plan(found)
