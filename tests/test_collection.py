import pytest
from pyspark.sql import functions as F

from tidewatch.operators import listing, prepare as prep
from tidewatch.schemas import ANSWER, LABEL, RAW_POST
from tidewatch.sources import commits, corpus, labels, outputs, snapshots
from tidewatch.streaming import jobs

NOW = 1_700_000_000.0


def posts(spark, names, subreddit="marvel"):
    return spark.createDataFrame(
        [(n, subreddit, f"title {n}", "", 1.7e9, 1.7e9) for n in names],
        "id string, subreddit string, title string, body string, created_utc double, "
        "snapshot_utc double")


def stored_ids(spark, path):
    return sorted(r.id for r in snapshots.scan_snapshots(spark, path).collect())


def test_resume_adds_only_unseen_and_keeps_the_rest(spark, tmp_path):
    store = tmp_path / "raw"
    first = [f"p{i}" for i in range(4)]
    every = [f"p{i}" for i in range(10)]
    run = lambda ids: snapshots.incremental_ingest(                          # noqa: E731
        posts(spark, ids + ids), store, ["marvel", "lotr"], rows_per_file=4).collect()
    assert {r.subreddit: r.n for r in run(first)} == {"marvel": 4, "lotr": 0}
    assert {r.subreddit: r.n for r in run(every)} == {"marvel": 6, "lotr": 0}
    assert {r.subreddit: r.n for r in run(every)} == {"marvel": 0, "lotr": 0}
    assert stored_ids(spark, store) == sorted(every)


def test_parts_are_bounded_and_partitioned(spark, tmp_path):
    snapshots.append_snapshots(posts(spark, [f"p{i}" for i in range(10)], "123"), tmp_path / "raw",
                               rows_per_file=4)
    parts = list((tmp_path / "raw" / "subreddit=123").glob("part-*.parquet"))
    assert len(parts) == 3
    scanned = snapshots.scan_snapshots(spark, tmp_path / "raw")
    assert dict(scanned.dtypes)["subreddit"] == "string"
    assert {r.subreddit for r in scanned.collect()} == {"123"}


def test_empty_stores(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        snapshots.scan_snapshots(spark, tmp_path / "nothing")
    assert labels.scan_labels(spark, tmp_path / "nothing").columns == LABEL.names
    assert outputs.scan_answers(spark, str(tmp_path / "answers_*.csv")).columns == ANSWER.names


def test_parts_written_without_types(spark, tmp_path):
    posts(spark, ["a"]).withColumn("flair", F.lit(None).cast("int")).write.parquet(
        str(tmp_path / "odd"))
    rows = snapshots.scan_parts(spark, [tmp_path / "odd"])
    assert rows.schema.names == RAW_POST.names and rows.first().flair is None


def entries(spark, **windows):
    return spark.createDataFrame(
        [("x", w, i, n) for w, names in windows.items() for i, n in enumerate(names)],
        "subreddit string, window string, pos int, id string")


@pytest.mark.parametrize("windows, limit, seen, wanted", [
    ({"all": "abc", "year": "bcde"}, 10, "", "abcde"),
    ({"all": "ab", "year": "bcd"}, 3, "", "abc"),
    ({"all": "abcde"}, 4, "ab", "cd"),
    ({"all": "abcde"}, 2000, "", "abcde")])
def test_listing_windows(spark, windows, limit, seen, wanted):
    done = spark.createDataFrame([(s,) for s in seen], "id string")
    merged = listing.merged_listing(entries(spark, **windows), limit, seen=done)
    assert sorted(r.id for r in merged.collect()) == sorted(wanted)


def test_listing_names(spark):
    both = entries(spark, new="n", all="t")
    assert [r.id for r in listing.merged_listing(both, 5, "new").collect()] == ["n"]
    with pytest.raises(ValueError):
        listing.merged_listing(both, 5, "controversial")


SUBMISSION = ("id string, subreddit string, title string, selftext string, score long, "
              "num_comments long, created_utc double, upvote_ratio double, link_flair_text string, "
              "is_self boolean, permalink string, domain string, over_18 boolean, spoiler boolean, "
              "comments array<struct<body:string,score:bigint,author:string,stickied:boolean,"
              "distinguished:string>>")


def test_submissions_are_normalised_and_flattened(spark):
    comments = [("é one", 1, None, True, None), (None, 2, "x", False, "moderator"),
                ("three", 3, "y", None, None)]
    raw = spark.createDataFrame([("a", "m", None, None, 1, 3, 1.0, None, None, True, None, None,
                                  None, True, comments)], SUBMISSION)
    row = listing.flatten_snapshot(listing.normalise_submissions(raw, NOW, 2)).first()
    assert (row.title, row.body, row.domain, row.over_18, row.spoiler) == ("", "", "", False, True)
    assert row.upvote_ratio != row.upvote_ratio and row.snapshot_utc == NOW
    assert row.n_comments_collected == 2 and "é one" in row.comments_json
    assert '"distinguished":null' in row.comments_json and '"author":""' in row.comments_json
    bare = listing.flatten_snapshot(listing.normalise_submissions(raw, NOW)).first()
    assert (bare.comments_json, bare.n_comments_collected) == ("[]", 0)


def test_legacy_csv_round_trip(spark, tmp_path):
    path = tmp_path / "marvel.csv"
    path.write_text('id,title,content,score,num_comments,author,created_utc,upvote_ratio,'
                    'subreddit_flair\n'
                    'a1,"He said ""hi"", twice","line one\nline two",3,1,x,1600000000.0,0.9,Fan\n'
                    'a2,Bare,,4,0,y,1600000001.0,,\n', encoding="utf-8")
    rows = {r.id: r for r in corpus.from_legacy(spark, {"marvel": path}).collect()}
    assert rows["a1"].title == 'He said "hi", twice' and rows["a1"].body == "line one\nline two"
    assert rows["a2"].body == "" and rows["a2"].flair is None and rows["a2"].comments_json == "[]"
    texts = {r.id: r.text for r in corpus.load_corpus(spark, {"marvel": path}).collect()}
    assert texts["a2"] == "Bare"
    corpus.export_csv(corpus.load_corpus(spark, {"marvel": path}), tmp_path / "out")
    assert (tmp_path / "out" / "subreddit=marvel").is_dir()


def test_labels_are_recorded_once(spark, tmp_path):
    raw = posts(spark, ["p0", "p1"]).withColumn("created_utc", F.lit(NOW - 72 * 3600))
    status = spark.createDataFrame([("p0", "moderator")], "id string, removed_by_category string")
    first = labels.record_labels(raw, status, tmp_path / "labels", NOW)
    assert {r.outcome: r.n for r in first.collect()} == {"removed_by_moderation": 1, "missing": 1}
    again = labels.record_labels(raw, status, tmp_path / "labels", NOW + 3600)
    assert labels.label_summary(again).first().labelled == 0
    assert labels.scan_labels(spark, tmp_path / "labels").count() == 2


def test_an_append_run_twice_leaves_one_label_a_post(spark, tmp_path):
    raw = posts(spark, ["p0", "p1"]).withColumn("created_utc", F.lit(NOW - 72 * 3600))
    labels.record_labels(raw, spark.createDataFrame([], "id string, removed_by_category string"),
                         tmp_path / "labels", NOW)
    torn = commits.read_committed(spark, tmp_path / "labels", LABEL)
    labels.append_labels(torn.where("id = 'p1'").withColumn("checked_utc", F.lit(NOW + 9)),
                         tmp_path / "labels")
    rows = labels.scan_labels(spark, tmp_path / "labels").collect()
    assert sorted((r.id, r.checked_utc) for r in rows) == [("p0", NOW), ("p1", NOW)]


def test_a_large_community_is_written_by_many_tasks(spark, tmp_path):
    rows = posts(spark, [f"p{i}" for i in range(4000)], "busy").unionByName(
        posts(spark, ["q"], "calm")).unionByName(posts(spark, ["n"], None))
    merge = "spark.sql.adaptive.coalescePartitions.enabled"       # small partitions are put together
    spark.conf.set(merge, "false")
    snapshots.append_snapshots(rows, tmp_path / "raw", rows_per_file=100)
    spark.conf.unset(merge)
    tasks = {p.name.split("-")[1] for p in (tmp_path / "raw" / "subreddit=busy").glob("part-*")}
    assert len(tasks) > 1 and len(list((tmp_path / "raw" / "subreddit=calm").glob("part-*"))) == 1
    assert snapshots.scan_snapshots(spark, tmp_path / "raw").count() == 4002


def test_ingest_stream_stores_each_id_once_ever(spark, tmp_path):
    landing, store = str(tmp_path / "landing"), tmp_path / "store"
    for names in (["a", "b"], ["b", "c", "d"], ["a", "e"]):
        snapshots.to_schema(posts(spark, names), RAW_POST).coalesce(1).write.mode(
            "append").parquet(landing)
        jobs.ingest_stream(spark, landing, store, tmp_path / "cp").awaitTermination(120)
    assert stored_ids(spark, store) == ["a", "b", "c", "d", "e"]
    # A lost checkpoint replays everything that landed and still adds nothing.
    jobs.ingest_stream(spark, landing, store, tmp_path / "cp2").awaitTermination(120)
    assert stored_ids(spark, store) == ["a", "b", "c", "d", "e"]


@pytest.mark.parametrize("dies_at", ["posts", "ledger"])
def test_a_killed_ingest_leaves_nothing_to_be_seen(spark, tmp_path, monkeypatch, dies_at):
    """The run dies after writing its posts, or its ids too, before the log has it; its retry stores all."""
    store = tmp_path / "raw"
    snapshots.incremental_ingest(posts(spark, ["a", "b"]), store)
    def killed(*_, **__):
        raise KeyboardInterrupt
    with monkeypatch.context() as patch:
        if dies_at == "posts":
            patch.setattr(commits.IdLedger, "append", killed)
        else:
            patch.setattr(snapshots, "commit", killed)
        with pytest.raises(KeyboardInterrupt):
            snapshots.incremental_ingest(posts(spark, ["b", "c", "d"]), store)
    assert stored_ids(spark, store) == ["a", "b"]
    again = snapshots.incremental_ingest(posts(spark, ["b", "c", "d"]), store, batch=7).collect()
    assert [r.n for r in again] == [2] and stored_ids(spark, store) == ["a", "b", "c", "d"]
    assert sorted((r.batch is None, r.n_rows) for r in commits.commits(spark, store).collect()) == [(False, 2), (True, 2)]


def test_a_torn_label_append_is_not_seen(spark, tmp_path, monkeypatch):
    raw = posts(spark, ["p0"]).withColumn("created_utc", F.lit(NOW - 72 * 3600))
    status = spark.createDataFrame([("p0", "moderator")], "id string, removed_by_category string")
    with monkeypatch.context() as patch:
        patch.setattr(labels, "commit", lambda *_: None)
        labels.record_labels(raw, status, tmp_path / "labels", NOW)
    assert labels.scan_labels(spark, tmp_path / "labels").count() == 0
    labels.record_labels(raw, status, tmp_path / "labels", NOW + 5)
    assert [r.checked_utc for r in labels.scan_labels(spark, tmp_path / "labels").collect()] == [NOW + 5]


def test_the_ledger_is_not_moved_and_small_batches_read_their_buckets(spark, tmp_path, monkeypatch):
    store = tmp_path / "it's a store"
    snapshots.incremental_ingest(posts(spark, [f"p{i}" for i in range(400)]), store)
    spark.sql(f"DROP TABLE {commits.IdLedger(spark, store).name}")              # as in a new session
    ledger = commits.IdLedger(spark, store, 999)
    assert ledger.buckets == commits.LEAST_BUCKETS and ledger.known(posts(spark, ["p1", "q"])).count() == 1
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()        # noqa: E731
    few = posts(spark, ["p1", "q"]).where("id = 'p1'")
    assert "SelectedBucketsCount: 1 out of 16" in plan(few.join(ledger.known(few).hint("merge"), "id", "left_anti"))
    monkeypatch.setattr(commits, "LITERAL_IDS", 2)
    batch = spark.range(1000).selectExpr("concat('p', id) AS id")
    joined = batch.join(ledger.known(batch).hint("merge"), "id", "left_anti")
    assert plan(joined).count("Exchange") == 1 and joined.count() == 600


def test_a_store_without_a_ledger_gets_one(spark, tmp_path):
    """Posts written by another tool, without tags, a log or a ledger."""
    store = tmp_path / "raw"
    snapshots.to_schema(posts(spark, ["a", "b", None]), RAW_POST).write.partitionBy("subreddit").parquet(str(store))
    snapshots.incremental_ingest(posts(spark, ["b", "c"]), store)
    snapshots.append_snapshots(posts(spark, ["d"]), store)
    snapshots.incremental_ingest(posts(spark, ["d", "e"]), store)
    assert sorted(r.id or "" for r in snapshots.scan_snapshots(spark, store).collect()) == ["", "a", "b", "c", "d", "e"]


def test_a_ledger_that_was_not_completed_is_made_again(spark, tmp_path, monkeypatch):
    """The run dies between the ids and the note that they are all there; another size is asked for next."""
    store = tmp_path / "raw"
    snapshots.append_snapshots(posts(spark, [f"p{i}" for i in range(50)]), store)
    note = commits.IdLedger._note
    def dies(ledger, name):
        if name == "_complete":
            raise KeyboardInterrupt
        note(ledger, name)
    with monkeypatch.context() as patch:
        patch.setattr(commits.IdLedger, "_note", dies)
        with pytest.raises(KeyboardInterrupt):
            commits.IdLedger(spark, store, 3).lay_out(snapshots.scan_snapshots(spark, store))
    assert commits.IdLedger(spark, store).buckets is None
    snapshots.incremental_ingest(posts(spark, ["p1", "p49", "new"]), store)
    assert commits.IdLedger(spark, store, 5).buckets == 3
    assert stored_ids(spark, store) == sorted([f"p{i}" for i in range(50)] + ["new"])


def test_label_stream(spark, tmp_path):
    store, landed = tmp_path / "store", str(tmp_path / "status")
    raw = posts(spark, ["p0", "p1", "p2"]).withColumn("created_utc", F.lit(NOW - 72 * 3600))
    snapshots.append_snapshots(raw, store)
    for _ in range(2):
        spark.createDataFrame([("p0", "moderator"), ("p1", None)],
                              "id string, removed_by_category string").coalesce(1) \
            .write.mode("append").parquet(landed)
    jobs.label_stream(spark, landed, store, tmp_path / "labels", tmp_path / "cp",
                      lambda: NOW).awaitTermination(120)
    got = {r.id: r.outcome for r in labels.scan_labels(spark, tmp_path / "labels").collect()}
    assert got == {"p0": "removed_by_moderation", "p1": "kept", "p2": "missing"}


def test_landed_records_become_training_text(spark, tmp_path):
    """Three landings, one of them a repeat, of communities of unequal size; text is looked at by post."""
    def record(name, community, born, title, body, *comments):
        return (name, community, title, body, 7, len(comments), born, .5, "News", False, "", "", False, False,
                list(comments))
    said = lambda body, author="wren", stickied=False: (body, 2, author, stickied, None)      # noqa: E731
    kiln = [record(f"k{i}", "kiln", 1.61e9 + 3600 * i, f"firing number {i}", "cone six held",
                   said(f"glaze {i} crawled"), said("[deleted]"), said("beep", "sortingBot")) for i in range(9)]
    loom = [record(f"l{i}", "loom", 1.61e9 + 7200 * i, f"warp number {i}", "", said("weekly thread", stickied=True))
            for i in range(4)]
    same = [record("k90", "kiln", 1.62e9, "Shared question!", "x"), record("l90", "loom", 1.62e9, "shared   QUESTION", "y")]
    for rows in (kiln[:5] + loom, kiln[:5], kiln[5:] + same):
        spark.createDataFrame(rows, SUBMISSION).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        jobs.submission_stream(spark, tmp_path / "in", tmp_path / "store", tmp_path / "cp", lambda: NOW,
                               comments_per_post=2).awaitTermination(120)
    assert len(stored_ids(spark, tmp_path / "store")) == 15
    prepared = prep.prepare(snapshots.scan_snapshots(spark, tmp_path / "store"), include_comments=True)
    report = prepared.report.first()
    # the third comment of a kiln post is beyond what is taken; the shared title drops both its posts
    assert report.comments_kept == 9 and report.input_posts == 15
    target = outputs.write_prepared(prepared, tmp_path / "prepared")
    text = {r.id: r.text for part in ("train", "test") for r in outputs.read_prepared(spark, target, part).collect()}
    assert set(text) == {f"k{i}" for i in range(9)} | {f"l{i}" for i in range(4)}
    assert all(f"glaze {i} crawled" in text[f"k{i}"] and "beep" not in text[f"k{i}"] for i in range(9))
    assert all("weekly" not in text[f"l{i}"] and f"warp number {i}" in text[f"l{i}"] for i in range(4))


def test_sample_is_fixed_on_first_use(spark, tmp_path):
    draw = lambda n: lambda: spark.createDataFrame(                          # noqa: E731
        [(str(i), i) for i in range(n)], "id string, position long")
    assert outputs.fixed_sample(spark, tmp_path / "s", draw(3)).count() == 3
    assert outputs.fixed_sample(spark, tmp_path / "s", draw(9)).count() == 3
