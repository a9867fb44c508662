import zipfile

import pytest
from pyspark.sql import functions as F

from linkspark.operators.blocking import ngram_index, phonetic_block, trigram_block
from linkspark.operators.components import connected_components, pairs_within
from linkspark.operators.ensemble import Ensemble
from linkspark.operators.entity_types import COMPANY, EntityTypeConfig, EntityTypeRegistry
from linkspark.operators.resolver import Resolver, compare, unmatched, validated
from linkspark.operators.service import Service
from linkspark.operators.strategies import Strategy, StrategyRegistry
from linkspark.settings import ResolverSettings
from linkspark.sources import registry as R

NAMES = ["Sony Corporation", "Sony Group Corp.", "株式会社ソニー", "Toyota Motor", "トヨタ自動車株式会社", "Samsung Electronics", "Sonic Ltd."]


@pytest.fixture(scope="module")
def company(spark):
    lines = [(i, f"{i:013d}", "0", n, None, "13", "c", "a", None) for i, n in enumerate(NAMES)]
    raw = spark.createDataFrame(lines, "row_no bigint, corporate_number string, latest string, name string, furigana string, prefecture_code string, city string, address string, en_name string")
    entities = R.prepare_entities(R.latest_lines(raw)).cache()
    return entities, ngram_index(entities, COMPANY.ngram_fields).cache()


def asked(spark, *queries):
    return spark.createDataFrame([(i, q, n) for i, (q, n) in enumerate(queries)], "query_id bigint, query_text string, max_results int")


def test_ingest(spark):
    raw = [(1, "1", "0", " A ", "", "", "", "", ""), (2, "1", "0", "B", None, "13", None, None, None), (3, "2", "1", "C", None, "13", None, None, None), (4, "3", "0", "D", None, None, None, None, None), (5, "", "0", "E", None, "13", None, None, None), (6, "4", "0", "  ", None, "13", None, None, None)]
    df = spark.createDataFrame(raw, "row_no bigint, corporate_number string, latest string, name string, furigana string, prefecture_code string, city string, address string, en_name string")
    got = R.latest_lines(df).collect()
    assert [(r.corporate_number, r.name, r.furigana, r.en_name) for r in got] == [("1", "A", None, None)]
    assert R.latest_lines(df.limit(0)).count() == 0


def test_csv_and_zip(spark, tmp_path):
    line = ",".join(["1", "4000012090001", "01", "0", "", "", "ソニー株式会社", "ソニー", "13", "港区", "港南1-7-1"] + [""] * 13 + ["Sony"])
    data = (line + "\r\nshort,line\r\n").encode("cp932")
    (tmp_path / "x.csv").write_bytes(data)
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("x.csv", data)
    for df in (R.read_registry_csv(spark, str(tmp_path / "x.csv")), R.read_registry_zip(spark, str(tmp_path / "x.zip"))):
        got = R.prepare_entities(R.latest_lines(df)).collect()
        assert [(r.name, r.name_normalized, r.en_name_normalized, r.city) for r in got] == [("ソニー株式会社", "ソニー", "sony", "港区")]


def test_registry_write_and_lookup(spark, company, tmp_path):
    entities, _ = company
    R.write_registry(entities, COMPANY, str(tmp_path), "overwrite")
    back = spark.read.parquet(f"{tmp_path}/companies")
    assert back.count() == len(NAMES)
    ids = [r.id for r in back.limit(3).collect()]
    order = spark.createDataFrame([(ids[2], 0), (ids[0], 1), (-5, 2)], "id bigint, ord int")
    assert [r.id for r in R.by_ids(back, COMPANY, order).collect()] == [ids[2], ids[0]]
    assert R.by_id(back, COMPANY, ids[0]).count() == 1
    assert R.stats({"company": (entities, ngram_index(entities, COMPANY.ngram_fields))}).first().entity_count == len(NAMES)


def test_ddl(spark):
    assert COMPANY.ddl(8)[1].endswith("CLUSTERED BY (ngram) INTO 8 BUCKETS")
    assert COMPANY.schema()["name"].nullable is False


def test_search(spark, company):
    r = Resolver(*company)
    checked = validated(asked(spark, ("Sony Corp", None), ("ソニー", 2), ("", 3), ("zzzz", None), ("x" * 201, None), ("Sony", 99), ("Sony Corp", 1)), r.settings)
    got = r.matches(checked, payload=True, explain=True).collect()
    by = {}
    for x in sorted(got, key=lambda x: (x.query_id, x.rank)):
        by.setdefault(x.query_id, []).append(x)
    assert by[0][0].entity_name == "Sony Corporation" and by[0][0].score > 0.9 and by[0][0].band == "high"
    assert [x.rank for x in by[0]] == list(range(1, len(by[0]) + 1)) and all(x.score >= 0.3 for x in got)
    assert len(by[6]) == 1 and len(by[1]) <= 2 and set(by) <= {0, 1, 3, 6}
    assert by[1][0].entity_name == "株式会社ソニー"
    steps = [s.step for s in by[0][1].explanations]
    assert steps == ["language_detection", "normalization", "phonetic_encoding", "blocking", "scoring", "scoring"]
    assert "transliteration" in [s.step for s in by[1][0].explanations]
    assert {x.query_id: x.status for x in r.summaries(checked).collect()} == {0: "ok", 1: "ok", 2: "error", 3: "ok", 4: "error", 5: "error", 6: "ok"}
    assert {x.query_id for x in unmatched(checked.where("status = 'ok'"), r.matches(checked)).collect()} == {3} - set(by)


def test_plan_has_no_cartesian_product(spark, company):
    r = Resolver(*company)
    plan = trigram_block(spark.createDataFrame([(1, "sony")], "query_id bigint, t string"), "t", company[1], 200)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "WindowGroupLimit" in plan
    assert r.candidates(r.query_forms(validated(asked(spark, ("Sony", None)), r.settings))).count() <= 500


def test_phonetic_block_limit_and_ties(spark):
    entities = spark.createDataFrame([(i, "S50000") for i in range(5)] + [(9, ""), (10, None)], "id bigint, phonetic_key string")
    q = spark.createDataFrame([(1, "S50012"), (2, "")], "query_id bigint, k string")
    assert sorted(r.entity_id for r in phonetic_block(q, "k", entities, 3).collect()) == [0, 1, 2]


def test_compare(spark):
    df = spark.createDataFrame([("Sony", "Sony"), ("Sony Corporation", "Sony Corp"), ("Sony", "Toyota"), (None, "")], "name_a string, name_b string")
    got = compare(df).collect()
    assert got[0].final_score > 0.9 and got[1].final_score > 0.5 and got[2].final_score < 0.6
    assert [s.strategy_name for s in got[0].strategy_results] == ["jaro_winkler", "levenshtein", "token_sort", "phonetic"]


def test_registries():
    s = StrategyRegistry.default()
    with pytest.raises(ValueError):
        s.register(Strategy("phonetic", lambda a, b: F.lit(1.0)))
    with pytest.raises(KeyError):
        s.get("none")
    s.unregister("phonetic")
    with pytest.raises(KeyError):
        s.unregister("phonetic")
    t = EntityTypeRegistry.default()
    with pytest.raises(KeyError, match="company"):
        t.get("person")
    t.register(EntityTypeConfig("person", (), "people"))
    assert "person" in t and t.names() == ["company", "person"]


def test_ensemble_without_pairs_and_own_strategy(spark):
    df = spark.createDataFrame([("a", None)], "x string, y string")
    e = Ensemble()
    p = e.prepare(e.prepare(df, {"normalized": F.col("x")}, "q"), {"name_normalized": F.col("y")}, "c")
    got = e.explain(e.score(p)).select("result.*").first()
    assert got.final_score == 0.0 and all(s.score == 0.0 for s in got.strategy_results) and got.best_strategy == "jaro_winkler"
    own = StrategyRegistry()
    own.register(Strategy("equal", lambda a, b: (a == b).cast("double"), 2.0))
    e = Ensemble(own, {"equal": 4.0})
    p = e.prepare(e.prepare(df, {"normalized": F.col("x")}, "q"), {"name_normalized": F.col("x")}, "c")
    assert e.score(p).first().final_score == 1.0


def test_service_and_batch(spark, company):
    s = Service(spark)
    s.attach("company", *company)
    assert s.health()["status"] == "healthy" and s.stats()["entity_count"] == len(NAMES)
    found = s.search("Sony Corporation", 3)
    assert found["matches"][0]["entity_name"] == "Sony Corporation" and found["matches"][0]["entity_type"] == found["entity_type"] == "company"
    assert found["query_forms"]["normalized"] == "sony" and found["query_forms"]["phonetic"] == "S50000" and "variants" not in found["query_forms"]
    assert [x["step"] for x in found["processing_steps"]][:4] == ["language_detection", "normalization", "phonetic_encoding", "blocking"]
    assert [x["step"] for x in found["processing_steps"]][4:] == ["scoring"] * len(found["matches"])
    nothing = s.search("qqqq", 3)
    assert nothing["matches"] == [] and [x["step"] for x in nothing["processing_steps"]] == ["language_detection", "normalization", "phonetic_encoding", "blocking"]
    assert "variants" in s.search("ソニー", 1)["query_forms"]
    told = s.match("Sony", "Sony")
    assert told["final_score"] > 0.9 and [(x["step"], x["details"]["normalized"]) for x in told["explanation"]] == [("normalization_a", "sony"), ("normalization_b", "sony")]
    with pytest.raises(ValueError):
        s.search("", 3)
    with pytest.raises(KeyError):
        s.search("Sony", 3, "person")
    job = s.submit_batch([("Sony", 2), ("", 2), ("Toyota", None)], wait=True)
    assert job.status == "completed" and [r["status"] for r in job.results] == ["ok", "error", "ok"] and job.results[1]["matches"] == []
    assert [r["index"] for r in job.results] == [0, 1, 2] and job.completed == job.total == 3
    best = job.results[0]["matches"][0]
    assert best["rank"] == 1 and best["entity_type"] == "company" and best["entity_data"]["name"] == best["entity_name"]
    assert s.batch_status(job.id) is job and s.batch_status("none") is None


def test_batch_isolates_what_fails(spark, company, monkeypatch):
    from linkspark.operators import service

    whole, seen = service.batch_results, []

    def failing(resolver, requests):
        texts = [r.query_text for r in requests.collect()]
        seen.append(len(texts))
        if "boom" in texts:
            raise RuntimeError("no plan")
        return whole(resolver, requests)

    monkeypatch.setattr(service, "batch_results", failing)
    s = Service(spark)
    s.attach("company", *company)
    s._batches["company"] = service.BatchManager(s.resolver(), slice_size=2)
    job = s.submit_batch([("Sony", 1), ("boom", 1), ("Toyota", 1)], wait=True)
    assert [r["status"] for r in job.results] == ["ok", "error", "ok"] and job.results[1]["error"] == "no plan" and job.results[1]["index"] == 1
    assert seen == [2, 1, 1, 1] and job.status == "completed" and job.completed == 3


def test_blocking_is_the_same_on_every_path(spark, company, monkeypatch):
    from linkspark.operators import blocking

    entities, ngrams = company
    queries = spark.createDataFrame([(i, n) for i, n in enumerate(["sony", "toyota motor", "ソニー", "", None])], "query_id bigint, q string")
    paths = []
    for broadcast, many in ((1_000_000, 64), (1_000_000, 1), (0, 64)):
        monkeypatch.setattr(blocking, "MOST_BROADCAST_GRAMS", broadcast)
        monkeypatch.setattr(blocking, "MANY_TEXTS", many)
        paths.append(sorted(map(tuple, blocking.trigram_block(queries, "q", ngrams, 5).collect())))
        assert paths[-1] == sorted(map(tuple, blocking.trigram_block(queries, "q", ngrams.unionAll(ngrams), 5, repeated=True).collect()))
    assert paths[0] == paths[1] == paths[2] and len(paths[0]) > 3


def test_pairs_of_many_texts_stay_in_their_task(spark, monkeypatch):
    from linkspark.operators import blocking, overlap

    words = [f"{a}{b}{c} {c}{a}" for a in ("sony", "kabu", "shiki") for b in ("to", "ka", "gai", "sha") for c in ("moto", "ri", "n", "")]
    entities = [(None if i == 7 else i, t, f) for i, t in enumerate(words) for f in ("name", "en")]
    ngrams = ngram_index(spark.createDataFrame([(e, t, t[1:] if f == "en" else t) for e, t, f in entities if f == "en"], "id bigint, name string, en string"), ("name", "en"))
    queries = spark.createDataFrame([(f"q{i}", t) for i, t in enumerate([*words, "kab", "zzz"])], "query_id string, q string")
    few = sorted(map(str, blocking.trigram_block(queries, "q", ngrams, 9).collect()))
    monkeypatch.setattr(blocking, "MANY_TEXTS", 1)
    for block in (overlap.BLOCK_POSTINGS, 300):
        monkeypatch.setattr(overlap, "BLOCK_POSTINGS", block)
        many = blocking.trigram_block(queries, "q", ngrams, 9)
        plan = many._jdf.queryExecution().toString()
        assert "MapInArrow" in plan and "count(1)" not in plan  # no row for each pair that shares a gram
        assert sorted(map(str, many.collect())) == few and len(few) > 300


def test_matches_are_the_same_by_broadcast_and_exchange(spark, company, monkeypatch):
    from linkspark.operators import resolver

    r = Resolver(*company)
    checked = validated(spark.createDataFrame([(1, "Sony", 1), (2, "Sony", 2), (3, "toyota motor", None)], "query_id bigint, query_text string, max_results int"), r.settings)
    found = []
    for most in (50_000, 0):
        monkeypatch.setattr(resolver, "MOST_BROADCAST_TEXTS", most)
        found.append(sorted((x.query_id, x.rank, x.entity_id, x.score) for x in r.matches(checked).collect()))
    assert found[0] == found[1] and [x[:2] for x in found[0]][:1] == [(1, 1)] and sum(x[0] == 1 for x in found[0]) == 1


def test_stream(spark, company, tmp_path):
    from linkspark.streaming.resolve_stream import resolve_stream

    asked(spark, ("Sony", 2), ("Toyota", 1)).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("query_id bigint, query_text string, max_results int").parquet(f"{tmp_path}/in")
    resolve_stream(stream, Resolver(*company), f"{tmp_path}/out", f"{tmp_path}/cp", True).awaitTermination(120)
    got = spark.read.parquet(f"{tmp_path}/out").groupBy("query_id").count().collect()
    assert {r.query_id: r["count"] for r in got} == {0: 2, 1: 1}


def test_settings(spark):
    spark.conf.set("linkspark.min_score_threshold", "0.5")
    assert ResolverSettings.from_session(spark).min_score_threshold == 0.5
    spark.conf.unset("linkspark.min_score_threshold")


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (4, 5), (5, 6), (10, 11), (11, 10), (20, 20), (None, 1), (30, 31), (31, 32), (32, 30)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1, 10: 10, 11: 10, 30: 30, 31: 30, 32: 30}
    chain = [(i, i + 1) for i in range(200)]
    assert {r.component for r in connected_components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()} == {0}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
    m = spark.createDataFrame([(1, "b"), (1, "a"), (1, "a"), (2, "c"), (None, "d"), (2, None)], "g int, m string")
    assert [tuple(r) for r in pairs_within(m, "g", "m", "x", "y").collect()] == [("a", "b")]


def test_insert_into_a_standing_registry(spark, tmp_path):
    from linkspark.operators.entity_types import COMPANY
    from linkspark.sources.registry import insert_lines, latest_lines, numbered

    schema = "row_no bigint, corporate_number string, latest string, name string, furigana string, prefecture_code string, city string, address string, en_name string"
    line = lambda i, number, name: (i, number, "0", name, None, "13", None, None, None)
    first = spark.createDataFrame([line(5, "b", "Beta"), line(3, "a", "Alpha"), line(9, "a", "Other")], schema)
    again = spark.createDataFrame([line(1, "a", "Newer"), line(2, "c", "Gamma"), line(4, "d", "Delta"), line(6, None, "x")], schema)
    path = str(tmp_path)
    assert insert_lines(spark, latest_lines(first), COMPANY, path) == 2
    assert insert_lines(spark, latest_lines(again), COMPANY, path) == 2
    assert insert_lines(spark, latest_lines(again), COMPANY, path) == 0
    assert insert_lines(spark, latest_lines(first.limit(0)), COMPANY, path) == 0
    rows = spark.read.parquet(f"{path}/companies").select("id", "corporate_number", "name").orderBy("id").collect()
    assert [tuple(r) for r in rows] == [(1, "a", "Alpha"), (2, "b", "Beta"), (3, "c", "Gamma"), (4, "d", "Delta")]
    postings = spark.read.parquet(f"{path}/company_ngrams")
    assert {r.entity_id for r in postings.collect()} == {1, 2, 3, 4} and postings.count() == postings.distinct().count()
    many = numbered(spark.range(0, 5000, 1, 7).selectExpr("5000 - id AS o"), "o", 10)
    assert [tuple(r) for r in many.orderBy("id").collect()] == [(i, i + 10) for i in range(1, 5001)]


def test_settings_from_session_and_environment(spark, monkeypatch):
    from linkspark.settings import ResolverSettings

    monkeypatch.setenv("LINKSPARK_MAX_LIMIT", "7")
    monkeypatch.setenv("LINKSPARK_MIN_SCORE_THRESHOLD", "0.5")
    spark.conf.set("linkspark.max_limit", "9")
    try:
        got = ResolverSettings.from_session(spark)
    finally:
        spark.conf.unset("linkspark.max_limit")
    assert (got.max_limit, got.min_score_threshold, got.default_limit) == (9, 0.5, 10)


def test_answers_as_files(spark, company, tmp_path):
    from linkspark.sources.registry import write_answers

    r = Resolver(*company)
    asked = validated(spark.createDataFrame([(1, "Sony", 3)], "query_id bigint, query_text string, max_results int"), r.settings)
    found = r.matches(asked, payload=True)
    for form in ("json", "parquet", "csv"):
        write_answers(found, f"{tmp_path}/{form}", form)
    back = spark.read.json(f"{tmp_path}/json")
    assert back.count() == found.count() > 0 and back.orderBy("rank").first().entity_data.name == "Sony Corporation"
    assert "Sony Corporation" in spark.read.csv(f"{tmp_path}/csv", header=True).where("rank = 1").first().entity_data


def test_similarities_are_computed_once(spark, company):
    r = Resolver(*company)
    ready = r.prepared(validated(spark.createDataFrame([(1, "ソニー", 5)], "query_id long, query_text string, max_results int"), r.settings))
    plan = r.ranked(ready)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("levenshtein(") == len(r.config.text_pairs)
