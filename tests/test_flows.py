"""Sources, landed JSON, translation, insights, streaming, learning and skew."""

from __future__ import annotations

import inspect
import json
import os
import time
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from talkmill import schemas as S
from talkmill.operators import insights as I, learning as LE, master as M, terms as TE, translation as TR
from talkmill.plans import jobs
from talkmill.sources import files, landed_json as J
from talkmill.streaming import jobs as stream


def test_globbed_files(spark, tmp_path):
    base = str(tmp_path / "c")
    spark.createDataFrame([("c1",)], "comment_id string").coalesce(1).write.parquet(f"{base}/iphone_comments_processed.parquet")
    spark.createDataFrame([("c2", "x")], "comment_id string, extra string").coalesce(1).write.parquet(f"{base}/future_comments_processed.parquet")
    df = files.scan_parquet_glob(spark, f"{base}/*_comments_processed.parquet", "*.parquet", provenance=True)
    assert {r["comment_id"]: r["extra"] for r in df.collect()} == {"c1": None, "c2": "x"} and {"source_file", "source_row"} <= set(df.columns)
    assert files.scan_parquet_glob(spark, f"{base}/nothing", "*.parquet", S.COMMENTS).count() == 0
    assert files.list_files(spark, f"{base}/nothing", "*").count() == 0


def test_latest_dataset(spark, tmp_path):
    for i, name in enumerate(("b", "a")):
        spark.range(i, i + 1).coalesce(1).write.parquet(str(tmp_path / name))
        time.sleep(1.1)
    assert files.latest_dataset(spark, str(tmp_path / "*"), "*.parquet").first()["id"] == 1


def test_latest_dataset_of_several_parts(spark, tmp_path):
    files.write_parquet(spark.range(50).repartition(2), str(tmp_path / "old"))
    time.sleep(1.1)
    files.write_parquet(spark.range(100).repartition(4), str(tmp_path / "new"))
    assert files.latest_dataset(spark, str(tmp_path / "*"), "*.parquet").count() == 100


def test_only_missing_files_are_empty_tables(spark, tmp_path):
    path = tmp_path / "broken"
    path.mkdir()
    (path / "x.parquet").write_bytes(b"this is no parquet file")
    with pytest.raises(Exception):
        files.scan_parquet_glob(spark, str(path), "*.parquet").count()


def test_report_is_one_file_made_by_many_tasks(spark, tmp_path):
    report = spark.range(0, 1000, 1, 8).groupBy((F.col("id") % 3).alias("k")).count()
    files.write_report_json(report, str(tmp_path / "r"))
    assert len([f for f in os.listdir(tmp_path / "r") if f.endswith(".json")]) == 1 and spark.read.json(str(tmp_path / "r")).count() == 3


def test_all_landed_comments_stay(spark):
    def thread(i):
        return {"snippet": {"videoId": "v1", "topLevelComment": {"id": f"c{i}", "snippet": {"textDisplay": "t"}}}}

    raw = bodies(spark, {"items": [thread(i) for i in range(130)]})
    assert J.flatten_comments(raw, "p").count() == 130
    capped = J.flatten_comments(raw, "p", per_video=3).collect()
    assert sorted(r["comment_id"] for r in capped) == ["c0", "c1", "c2"]


def test_stream_dedup_keeps_late_first_copies(spark, tmp_path):
    land, out, check = (str(tmp_path / x) for x in ("land", "out", "check"))
    schema = "id string, at timestamp, n int"

    def arrive(rows):
        spark.createDataFrame(rows, "id string, at string, n int").withColumn("at", F.col("at").cast("timestamp")).coalesce(1).write.mode("append").parquet(land)
        landed = stream.read_landed(spark, land, spark.createDataFrame([], schema).schema)
        stream.stream_dedup(landed, "id", out, check, ["at"])

    arrive([("c1", "2024-06-01 00:00:00", 1), ("c1", "2024-06-02 00:00:00", 2)])
    arrive([("c2", "2024-01-01 00:00:00", 3), ("c1", "2023-01-01 00:00:00", 4), (None, "2023-01-01 00:00:00", 5)])
    arrive([("c2", "2024-01-01 00:00:00", 6), (None, "2022-01-01 00:00:00", 7)])
    assert sorted((r["n"] for r in spark.read.parquet(out).collect())) == [1, 3, 5]


def test_csv_round_trip_and_mark(spark, tmp_path):
    path = str(tmp_path / "csv")
    text = ' a "quoted", text\nwith lines '
    files.write_csv(spark.createDataFrame([("c1", text)], "comment_id string, t string"), path)
    part = next(f for f in os.listdir(path) if f.endswith(".csv"))
    assert open(f"{path}/{part}", "rb").read(3) == b"\xef\xbb\xbf"
    back = files.scan_csv(spark, path)
    assert back.columns == ["comment_id", "t"] and back.first()["t"] == text


def test_report_json_and_dictionary(spark, tmp_path):
    files.write_report_json(spark.createDataFrame([(1,)], "n int"), str(tmp_path / "r"))
    part = next(f for f in os.listdir(tmp_path / "r") if f.endswith(".json"))
    assert json.loads(open(tmp_path / "r" / part).read()) == {"n": 1}
    (tmp_path / "d.csv").write_text("source,english\nhai,is\n")
    assert files.load_dictionary(spark, str(tmp_path / "d.csv")) == {"hai": "is"}
    with pytest.raises(ValueError):
        files.load_dictionary(spark, str(tmp_path / "d.csv"), max_entries=0)


def bodies(spark, *responses):
    return spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(responses)], "page int, body string")


def test_landed_json(spark):
    search = bodies(spark, {"items": [{"id": {"videoId": "v1"}, "snippet": {"title": "T", "channelTitle": "C"}}, {"id": {}}, {"snippet": {}}]}, {})
    rows = J.flatten_search(search, " iPhone ").collect()
    assert len(rows) == 1 and rows[0]["product_query"] == "iPhone" and rows[0]["video_url"].endswith("watch?v=v1") and rows[0]["description"] is None
    video = {"id": "v1", "snippet": {"title": "T", "tags": ["a"]}, "statistics": {"viewCount": "12", "likeCount": "n/a"}}
    videos = J.flatten_videos(bodies(spark, {"items": [video, {"id": ""}]}, {"items": [{**video, "snippet": {"title": "second"}}, {"id": "v2"}]}), "p", page="page")
    got = {r["video_id"]: r for r in videos.collect()}
    assert set(got) == {"v1", "v2"} and got["v1"]["title"] == "T" and got["v1"]["view_count"] == 12 and got["v1"]["like_count"] is None and got["v2"]["tags"] == []

    def thread(i, likes):
        return {"snippet": {"videoId": "v1", "topLevelComment": {"id": i, "snippet": {"textDisplay": f"t{i}", "likeCount": likes}}}}

    comments = J.flatten_comments(bodies(spark, {"items": [thread("c1", 3), thread(None, 1)]}, {"items": [thread("c2", 4), thread("c3", 5)]}), "p", page="page", per_video=2)
    assert sorted((r["comment_id"], r["like_count"]) for r in comments.collect()) == [("c1", 3), ("c2", 4)]
    assert comments.columns == [f.name for f in S.COMMENTS]
    with pytest.raises(ValueError):
        J.flatten_search(search, "  ")
    with pytest.raises(ValueError):
        J.flatten_comments(search, "p", per_video=0)


@pytest.fixture(scope="module")
def mixed(spark):
    rows = [("c1", "great camera phone", "english"), ("c2", "bahut accha phone hai", "hinglish"), ("c3", "यह फोन अच्छा है", "hindi"),
            ("c4", "привет мир как дела", "unknown"), ("c5", "🔥🔥", "mystery"), ("c6", "ഈ ഫോൺ", "malayalam"), ("c7", "guter alter text", None)]
    return spark.createDataFrame(rows, "comment_id string, comment_text string, detected_language string").withColumn(S.CLEANED, F.lower("comment_text"))


def test_source_codes(mixed):
    got = {r["comment_id"]: r[TR.CODE] for r in TR.resolve_source_code(TR.route_non_english(mixed), "comment_id").collect()}
    assert got == {"c2": "hin_Deva", "c3": "hin_Deva", "c4": "rus_Cyrl", "c5": None, "c6": "mal_Mlym", "c7": None}


def test_translation_flow(spark, mixed):
    landed = spark.createDataFrame([("c2", "Bahut accha phone hai"), ("c3", "This phone is good!!"), ("c4", "привет мир как дела"), ("c6", " ")], "comment_id string, translation string")
    stage = jobs.translate_and_cleanup(mixed, lambda d: TR.apply_translations(d, landed, ["comment_id"]), {"bahut": "very", "accha": "good", "hai": "is"})
    assert {r["comment_id"]: (r[S.CLEANED], r[S.IS_TRANSLATED]) for r in stage.table.collect()} == {
        "c1": ("great camera phone", False), "c2": ("very good phone is", True), "c3": ("this phone is good!", True)}
    ready = stage.reports["readiness"].first()
    assert (ready["rows_before_cleanup"], ready["rows_after_cleanup"], ready["removed_by_translation_failure"], ready["annotation_readiness"]) == (7, 3, 4, "READY")
    assert ready["all_comments_english"] is False and ready["minimum_cleaned_word_count"] == 3
    assert stage.reports["translation"].first()["translated_comments"] == 2


def test_translator_function_falls_back_per_batch(mixed):
    def upper(texts, code):
        if code == "mal_Mlym":
            raise RuntimeError("no model")
        return [t.upper() for t in texts]

    coded = TR.resolve_source_code(TR.route_non_english(mixed), "comment_id")
    got = {r["comment_id"]: r["translation"] for r in TR.translate_with(coded, upper, batch_size=1).collect()}
    assert got["c2"] == "BAHUT ACCHA PHONE HAI" and got["c6"] == "ഈ ഫോൺ" and got["c5"] is None


def test_insights(spark):
    rows = [("Steam Deck", f"c{i}", t) for i, t in enumerate(["good rog ally", "bad", "good", "plain switch 2 text", None])]
    df = spark.createDataFrame(rows, "product_query string, comment_id string, cleaned_comment_text string")
    got = I.product_insights(df).first()
    assert got["total_comments"] == 5 and got["sentiment_distribution"]["positive"]["count"] == 2 and got["sentiment_distribution"]["negative"]["pct"] == 20.0
    assert {c["competitor"]: c["mentions"] for c in got["competitor_mentions"]} == {"Rog Ally": 1, "Switch": 1, "Switch 2": 1}
    assert got["sample_comments"]["positive"] == ["good rog ally", "good"]
    assert set(got["sample_comments"]) == {"positive", "neutral", "negative"}
    summary = I.insight_summary(df).first()
    assert (summary["positive_pct"], summary["negative_pct"], summary["competitor"]) == (40.0, 20.0, "Rog Ally")


def test_lexicon_and_terms(spark):
    df = spark.createDataFrame([(1, "Good GOOD day"), (2, "a bad, bad night"), (3, "nothing"), (4, None)], "id int, cleaned_comment_text string")
    lexicon = spark.createDataFrame([("good", 1.9), ("bad", -2.5)], "token string, valence double")
    assert {r["id"]: r["label"] for r in I.lexicon_compound(df, lexicon, "id").collect()} == {1: "Positive", 2: "Negative", 3: "Neutral", 4: "Neutral"}
    assert [(r["term"], r["n"]) for r in TE.top_terms(df, 2).collect()] == [("bad", 2), ("good", 2)]
    assert {r["term"] for r in TE.top_terms(df, 9, size=2, stop_words=["good"]).collect()} == {"bad bad", "bad night"}
    assert {r["keyword"]: r["n"] for r in TE.keyword_rows(df, ["bad", "go"]).collect()} == {"bad": 1, "go": 0}


def test_stream_equals_batch_and_runs_once(spark, tmp_path):
    schema = "comment_id string, comment_text string"
    landing, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    one = spark.createDataFrame([("c1", "a good phone"), ("c2", "spam http://x y z")], schema)
    two = spark.createDataFrame([("c3", "यह फोन अच्छा है")], schema)
    for batch in (one, two):
        batch.coalesce(1).write.mode("append").parquet(landing)
        stream.incremental_ingest(stream.read_landed(spark, landing, one.schema), out, mark)
    got = {tuple(r) for r in spark.read.parquet(out).select("comment_id", S.CLEANED, S.LANGUAGE).collect()}
    want = {tuple(r) for r in stream.detect_clean_filter(one.unionByName(two)).select("comment_id", S.CLEANED, S.LANGUAGE).collect()}
    assert got == want and spark.read.parquet(out).count() == 2


def test_learning_loops(spark, tmp_path):
    # A session that has observed metrics can still send models to the executors.
    jobs.staged_with(spark.range(3), str(tmp_path), "t", {"r": [F.count("*").alias("n")]})
    rows = [(i, "battery lasts long power" if i % 2 else "camera photo lens zoom", "Battery" if i % 2 else "Camera") for i in range(60)]
    df = spark.createDataFrame(rows, "id int, cleaned_comment_text string, aspect_label string")
    clf = LE.TextClassifier(features=256, iterations=5)
    seeds, pool = df.filter("id < 20"), df.filter("id >= 20")
    model = clf.best_of(seeds, pool, [0.01, 1.0])
    assert clf.predict(model, pool).filter("predicted <> aspect_label").count() == 0
    scored = clf.predict_with_scores(model, pool).first()
    assert abs(sum(scored["scores"].values()) - 1) < 1e-9 and scored["confidence"] == max(scored["scores"].values())
    _, train, log = LE.self_train(clf, seeds, pool.drop("aspect_label"), "id", rounds=2, cap=7)
    assert [r["new"] for r in log] == [14, 14] and train.count() == 48
    assert LE.unlabeled(df, seeds, "id").count() == 40


def test_learning_queries_run_the_whole_job(monkeypatch):
    """Registered with the operators' own features, iterations, folds, rounds and cap."""
    from talkmill.checks import all_queries, learning_queries

    class Done(Exception):
        pass

    def bound(name):
        own, found = inspect.signature(getattr(LE, name)), {}

        def record(*args, **kwargs):
            values = own.bind(*args, **kwargs)
            values.apply_defaults()
            found.update(values.arguments)
            raise Done

        monkeypatch.setattr(LE, name, record)
        monkeypatch.setattr(learning_queries, "_labelled", lambda t: None)
        monkeypatch.setattr(learning_queries, "_seeds", lambda t: None)
        monkeypatch.setattr(LE, "unlabeled", lambda *a: None)
        with pytest.raises(Done):
            all_queries()[name][0](SimpleNamespace(labels=None))
        return found

    assert learning_queries._CLF == LE.TextClassifier(text="text", label="lang")
    assert (learning_queries._CLF.features, learning_queries._CLF.iterations) == (1 << 16, 20)
    assert bound("cross_validate")["folds"] == 5
    rounds = bound("self_train")
    assert (rounds["rounds"], rounds["cap"]) == (3, 150)


def test_hot_key_join_is_split(spark):
    """A third of the rows on one key: AQE splits that partition of the shuffle join."""
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100k",
    }
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        left = spark.range(0, 200_000, 1, 8).selectExpr("CAST(id AS string) AS comment_id", "IF(id % 3 = 0, 'hot', CAST(id AS string)) AS video_id", "repeat('x', 20) AS t")
        right = spark.range(1000).selectExpr("CAST(id AS string) AS video_id", "id AS view_count").union(spark.sql("SELECT 'hot', 1L"))
        joined = M.left_join_unique(left, right, "video_id")
        assert joined.filter("_r_view_count = 1").count() >= 66_667
        out = joined.groupBy("video_id").count()
        rows = joined.select("comment_id", "_r_view_count").collect()
        assert len(rows) == 200_000 and out.count() > 1
        executed = joined.select("comment_id", "_r_view_count")
        executed.collect()
        assert "skew=true" in executed._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_no_lineage_shortcuts_or_cross_joins():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for folder, _, names in os.walk(os.path.join(root, "talkmill")):
        for name in (n for n in names if n.endswith(".py")):
            source = open(os.path.join(folder, name), encoding="utf-8").read()
            assert "localCheckpoint" not in source and "crossJoin" not in source and ".rdd.map" not in source, name
