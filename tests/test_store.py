"""The snapshot store: what a crash leaves, what a second run reads, and the rules watched on the way in."""
import pytest
from pyspark.sql import functions as F
from support import by

from loanwatch.operators import feed_checks
from loanwatch.plans import ingest
from loanwatch.sources import store, tables

COLS = "LOAN_ID long, SNAPSHOT_DATE long, NATIONAL_CODE string, DPD_DAYS int, LOAN_CATEGORY int, WORST_FUTURE_CAT int, LABEL_HORIZON_DATE long"


def feed(spark, *months, bad=0):
    """Four loans a month; the last has no label. In months named ``bad`` one label is below its category."""
    rows = [(i, m, f"c{i}", 5 * i, 1, (0 if m == bad and i == 2 else None if i == 4 else 2), m + 600) for m in months for i in range(1, 5)]
    return spark.createDataFrame(rows, COLS)


def ledger(spark, *months, unlabelled=1):
    df = spark.createDataFrame([(m, "FINAL", unlabelled, 0) for m in months], "SNAPSHOT_DATE long, STATUS string, LOANS_UNLABELLED int, LOANS_MISSING_MONTHS int")
    return tables.label_ledger(df)


def on_disk(spark, df, path):
    """A loan table partitioned by snapshot, and the path its plans name."""
    df.write.partitionBy("SNAPSHOT_DATE").parquet(str(path))
    return spark.read.schema(df.schema).parquet(str(path))


class Died(Exception):
    pass


@pytest.mark.parametrize("where", ["_commit", "_facts"])
def test_rows_of_a_job_that_died_are_never_read_and_are_staged_again(spark, tmp_path, monkeypatch, where):
    path = str(tmp_path / "s")
    store.store_mature(feed(spark, 20240101), ledger(spark, 20240101), path)

    def die(*_):
        raise Died
    with monkeypatch.context() as m:
        m.setattr(store.SnapshotStore, where, die)
        with pytest.raises(Died):
            store.store_mature(feed(spark, 20240101, 20240201), ledger(spark, 20240101, 20240201), path)
    assert store.stored_snapshots(spark, path) == [20240101]
    assert store.read_store(spark, path).count() == 3                   # though the rows of the second are on disk
    assert len(list((tmp_path / "s" / "data").glob("commit=*"))) == 2
    assert store.store_mature(feed(spark, 20240101, 20240201), ledger(spark, 20240101, 20240201), path) == [20240201]
    kept = store.read_store(spark, path)
    assert sorted((r["SNAPSHOT_DATE"], r["LOAN_ID"]) for r in kept.collect()) == [(m, i) for m in (20240101, 20240201) for i in (1, 2, 3)]
    assert len(store.SnapshotStore(spark, path).vacuum()) == 1
    assert kept.count() == 6 and store.SnapshotStore(spark, path).vacuum() == []


def test_a_second_run_reads_no_source_rows(spark, tmp_path):
    loans = on_disk(spark, feed(spark, 20240101, 20240201, 20240301), tmp_path / "source")
    led = ledger(spark, 20240101, 20240201)
    first = ingest.training_loans(loans, led, str(tmp_path / "s"))
    assert first.count() == 6 and first.columns == loans.columns
    unreadable = spark.read.schema(loans.schema).option("basePath", str(tmp_path)).parquet(str(tmp_path / "source"))
    for f in (tmp_path / "source").rglob("*.parquet"):
        f.write_bytes(b"not a parquet file")
    again = ingest.training_loans(unreadable, led, str(tmp_path / "s"))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, first.collect()))
    plan = again._jdf.queryExecution().executedPlan().toString()
    assert f"{tmp_path}/source" not in plan and f"{tmp_path}/s/" in plan


def test_only_a_new_snapshot_is_read_from_the_source(spark, tmp_path, monkeypatch):
    led = ledger(spark, 20240101, 20240201)
    asked = []
    fill = store.SnapshotStore.fill
    monkeypatch.setattr(store.SnapshotStore, "fill", lambda self, rows, snapshots, *a, **k: asked.append(list(snapshots)) or fill(self, rows, snapshots, *a, **k))
    ingest.training_loans(feed(spark, 20240101, 20240201), led, str(tmp_path / "s"))
    ingest.training_loans(feed(spark, 20240101, 20240201, 20240301), ledger(spark, 20240101, 20240201, 20240301), str(tmp_path / "s"))
    ingest.training_loans(feed(spark, 20240101, 20240201, 20240301), ledger(spark, 20240101, 20240201, 20240301), str(tmp_path / "s"))
    assert asked == [[20240101, 20240201], [20240301], []]


def test_a_snapshot_without_labels_is_committed_as_empty(spark, tmp_path):
    loans = feed(spark, 20240101, 20240201).withColumn("WORST_FUTURE_CAT", F.when(F.col("SNAPSHOT_DATE") == 20240101, F.col("WORST_FUTURE_CAT")))
    path = str(tmp_path / "s")
    assert store.store_mature(loans, ledger(spark, 20240101, 20240201), path) == [20240101]
    assert store.store_mature(loans, ledger(spark, 20240101, 20240201), path) == []
    assert store.stored_snapshots(spark, path) == [20240101]
    with pytest.raises(FileNotFoundError):
        store.read_store(spark, str(tmp_path / "nothing"))


def test_a_rebuilt_open_snapshot_replaces_the_old_one_for_new_readers(spark, tmp_path):
    path, led = str(tmp_path / "s"), ledger(spark, 20240101)
    loans = feed(spark, 20240101, 20240301)

    def built(day):
        return spark.createDataFrame([(20240301, day)], "SNAPSHOT_DATE long, END_TIME string")
    old = ingest.scoring_loans(loans, led, built("2024-03-05"), path)
    assert "WORST_FUTURE_CAT" not in old.columns and {r["SNAPSHOT_DATE"] for r in old.collect()} == {20240301}
    new = ingest.scoring_loans(loans.withColumn("DPD_DAYS", F.lit(77)), led, built("2024-03-09"), path)
    same = ingest.scoring_loans(loans.withColumn("DPD_DAYS", F.lit(1)), led, built("2024-03-09"), path)
    assert {r["DPD_DAYS"] for r in new.collect()} == {r["DPD_DAYS"] for r in same.collect()} == {77}
    assert by(old, "LOAN_ID")[2]["DPD_DAYS"] == 10                      # a reader that began before keeps its files


def test_broken_rules_are_noted_by_snapshot_and_strict_stops_before_the_commit(spark, tmp_path, caplog):
    led = ledger(spark, 20240101, 20240201, 20240301)
    loans = feed(spark, 20240101, 20240201, 20240301, bad=20240201).withColumn(
        "LABEL_HORIZON_DATE", F.when((F.col("LOAN_ID") == 1) & (F.col("SNAPSHOT_DATE") == 20240301), 1).otherwise(F.col("LABEL_HORIZON_DATE")))
    twice = loans.unionByName(loans.where("LOAN_ID = 3 and SNAPSHOT_DATE = 20240101"))
    path = str(tmp_path / "s")
    with pytest.raises(feed_checks.FeedError, match="WORST_FUTURE_CAT < LOAN_CATEGORY"):
        store.store_mature(twice, led, path, strict=True)
    assert store.stored_snapshots(spark, path) == []
    assert store.store_mature(twice, led, path) == [20240101, 20240201, 20240301]
    got = {tuple(r) for r in store.SnapshotStore(spark, path).violations().collect()}
    assert got == {("label_below_category", "WORST_FUTURE_CAT < LOAN_CATEGORY", 20240201, 1),
                   ("duplicate_key", "LOAN_ID, SNAPSHOT_DATE", 20240101, 1), ("horizon_varies", "LABEL_HORIZON_DATE", 20240301, 1)}
    assert got == {tuple(r) for r in feed_checks.feed_violations(twice, led, by_snapshot=True).collect()}
    assert "label_below_category" in caplog.text


def test_label_counts_and_required_columns_are_watched_too(spark, tmp_path):
    loans = feed(spark, 20240101, 20240201).withColumn("NATIONAL_CODE", F.when(F.col("LOAN_ID") != 1, F.col("NATIONAL_CODE")))
    path = str(tmp_path / "s")
    store.store_mature(loans, ledger(spark, 20240101, 20240201, unlabelled=3), path)
    got = {tuple(r) for r in store.SnapshotStore(spark, path).violations().collect()}
    labels = "NULL labels differ from the ledger"
    required = {("null_in_required", "NATIONAL_CODE", m, 1) for m in (20240101, 20240201)} if "NATIONAL_CODE" in feed_checks.contract.REQUIRED else set()
    assert got == {("label_nullity", labels, m, 2) for m in (20240101, 20240201)} | required


def test_a_clean_feed_is_scanned_once(spark, tmp_path):
    """Nothing is counted again where no rule broke: the watched rows are the only read of the source."""
    loans = on_disk(spark, feed(spark, 20240101, 20240201).where("LOAN_ID < 4"), tmp_path / "source")
    watch = feed_checks.Watch(loans, [20240101, 20240201], ledger(spark, 20240101, 20240201, unlabelled=0))
    watch.watched().write.format("noop").mode("overwrite").save()
    rows = {20240101: 3, 20240201: 3}
    assert watch.suspects(rows) == {} and watch.without_label() == {20240101: 0, 20240201: 0}
    plan = watch.violations(rows)._jdf.queryExecution().executedPlan().toString()
    assert "source" not in plan and watch.violations(rows).count() == 0


def test_what_a_row_is_watched_for_does_not_grow_with_the_snapshots(spark):
    months = [20200101 + 100 * k for k in range(90)]
    loans = feed(spark, *months[1:80], 20300101, bad=months[5]).unionByName(feed(spark, months[5], months[79]).where("LOAN_ID = 4")).repartition(7)
    watches = [feed_checks.Watch(loans, some, ledger(spark, *some)) for some in (months[:80], months[:3])]
    frames = [w.watched() for w in watches]
    plans = [x._jdf.queryExecution().optimizedPlan().toString() for x in frames]
    assert len({p.count("bitmap_construct_agg") + p.count("bit_or") + p.count("count") + p.count("histogram_numeric") for p in plans}) == 1
    watch = watches[0]
    frames[0].write.format("noop").mode("overwrite").save()
    assert watch.without_label() == {m: 0 if m == months[0] else 2 if m in (months[5], months[79]) else 1 for m in months[:80]}
    found = watch.suspects({m: 4 for m in months[1:80]})
    assert {m for m, rules in found.items() if "label_below_category" in rules} == {months[5]}
    assert {m for m, rules in found.items() if "label_nullity" in rules} == {months[0], months[5], months[79]}


def test_all_rules_take_one_scan(spark, tmp_path):
    loans = on_disk(spark, feed(spark, 20240101, 20240201, bad=20240201), tmp_path / "source")
    found = feed_checks.feed_violations(loans, ledger(spark, 20240101, 20240201))
    assert found._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 1
    assert {r["rule"] for r in found.collect()} == {"label_below_category"}
    with pytest.raises(feed_checks.FeedError):
        ingest.checked(loans, ledger(spark, 20240101, 20240201), strict=True)
    assert ingest.checked(loans, ledger(spark, 20240101, 20240201)) is loans


def test_the_command_line_takes_its_rows_from_the_store(spark, tmp_path, monkeypatch):
    from loanwatch import __main__ as cli
    months = (20240101, 20240201, 20240301)
    feed(spark, *months).write.partitionBy("SNAPSHOT_DATE").parquet(str(tmp_path / "loans"))
    ledger(spark, *months[:2]).write.parquet(str(tmp_path / "ledger"))
    job = spark.createDataFrame([("LOAD", 20240301, "SUCCESS", "2024-03-05")], "JOB_NAME string, RUN_MONTH long, STATUS string, END_TIME string")
    job.write.parquet(str(tmp_path / "job"))
    seen = {}
    monkeypatch.setattr(cli, "drop_pins", lambda spark: None)
    monkeypatch.setattr(cli, "_keep", lambda *a: None)
    monkeypatch.setattr(cli.train, "static_split", lambda loans, ledger, final: loans)
    monkeypatch.setattr(cli.train, "train_fold", lambda rows, *a, **k: seen.update(train=rows))
    monkeypatch.setattr(cli.score, "run_scoring", lambda spark, rows, params: seen.update(predict=rows, calibration=params.calibration_rows))
    common = ["--loans", str(tmp_path / "loans"), "--ledger", str(tmp_path / "ledger"), "--out", str(tmp_path / "out"), "--store", str(tmp_path / "s")]
    cli.main(["train", *common])
    assert sorted((r["SNAPSHOT_DATE"], r["LOAN_ID"]) for r in seen["train"].collect()) == [(m, i) for m in months[:2] for i in (1, 2, 3)]
    cli.main(["predict", *common, "--model", "m", "--as-of", "2024-03-10", "--job-control", str(tmp_path / "job"), "--job", "LOAD"])
    assert {r["SNAPSHOT_DATE"] for r in seen["predict"].collect()} == {20240301} and "WORST_FUTURE_CAT" not in seen["predict"].columns
    assert {r["SNAPSHOT_DATE"] for r in seen["calibration"].collect()} == {20240201}
    plans = [seen[k]._jdf.queryExecution().executedPlan().toString() for k in ("train", "predict", "calibration")]
    assert all(f"{tmp_path}/s/" in p and f"{tmp_path}/loans" not in p for p in plans)
    with pytest.raises(SystemExit):
        cli.main(["predict", *common, "--model", "m", "--as-of", "2024-03-10"])
