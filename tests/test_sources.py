"""CSV folders by header, artifacts with their manifest, rank-based measures and samples."""

import csv
import random

import pytest
from pyspark.sql import functions as F

from wardline.ml import isolation
from wardline.operators import behavior, features
from wardline.sources import files


def write_csv(path, header, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    with open(path, "w", newline="") as f:
        csv.writer(f).writerows([header, *rows])


def jobs_of(spark, work):
    """How many Spark jobs some work runs."""
    context, group = spark.sparkContext, "counted"
    context.setJobGroup(group, group)
    try:
        work()
        return len(context.statusTracker().getJobIdsForGroup(group))
    finally:
        context.setJobGroup("", "")


def test_headers_are_matched_by_file(spark, tmp_path):
    write_csv(tmp_path / "x" / "a.csv", ["Source IP", " Label "], [["1.1.1.1", "BENIGN"], ["2.2.2.2", 'DoS, "Hulk"']])
    write_csv(tmp_path / "x" / "y" / "b.csv", ["label", "Flow/Rate", "Source IP", "label"], [["BENIGN", "7", "", "second"], ["PortScan", "8"]])
    write_csv(tmp_path / "x" / "only_header.csv", ["other"], [])
    (tmp_path / "x" / "empty.csv").write_text("")
    (tmp_path / "x" / "blank.csv").write_text("\n\nlabel\nodd\n\n")
    (tmp_path / "x" / "note.txt").write_text("label\nnone\n")
    found = files.read_csv_folder(spark, str(tmp_path / "x"))
    assert set(found.columns) == {"source_ip", "label", "flow_rate", "other"}
    got = {(r.source_ip, r.label, r.flow_rate, r.other) for r in found.collect()}
    assert got == {("1.1.1.1", "BENIGN", None, None), ("2.2.2.2", 'DoS, "Hulk"', None, None), (None, "BENIGN", "7", None), (None, "PortScan", "8", None), (None, "odd", None, None)}
    assert files.read_csv_folder(spark, str(tmp_path / "x"), pattern="*.none") is None


def test_jobs_do_not_grow_with_the_files(spark, tmp_path):
    counts = []
    for n in (60, 200):
        for i in range(n):
            write_csv(tmp_path / str(n) / f"{i}.csv", [f"c{i % 5}", "label"], [[str(i), "BENIGN"]] * 3)
        counts.append(jobs_of(spark, lambda n=n: files.read_csv_folder(spark, str(tmp_path / str(n))).count()))
        assert files.read_csv_folder(spark, str(tmp_path / str(n))).count() == 3 * n
    assert counts[0] == counts[1]


def test_artifacts_count_while_they_are_written(spark, tmp_path):
    network, auth = spark.range(1000).repartition(7), spark.range(20)
    files.write_artifacts(str(tmp_path / "a"), network=network, auth=auth, profiles=spark.range(3))
    assert {tuple(r) for r in files.read_manifest(spark, str(tmp_path / "a")).collect()} == {("network_features", 1000, "1.0"), ("auth_features", 20, "1.0"), ("ueba_profiles", 3, "1.0")}
    assert spark.read.parquet(str(tmp_path / "a" / "network_features.parquet")).count() == 1000
    files.write_artifacts(str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()


def test_auc_of_crowded_scores(spark):
    """All scores within a hair of each other, where equal cells would hold them all."""
    rng = random.Random(3)
    rows = [(rng.randrange(2), 0.5 + rng.randrange(300) * 1e-9) for _ in range(2000)]
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    plain = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
    df = spark.createDataFrame(rows, "label int, score double")
    assert features.exact_auc(df, "label", "score").first().auc == pytest.approx(plain, abs=1e-12)
    assert features.exact_auc(df.filter("label = 1"), "label", "score").first().auc is None


@pytest.mark.parametrize(("rows", "trees", "sample"), [(20_000, 40, 64), (3000, 40, 64), (50, 10, 64)])
def test_trees_draw_their_samples(spark, rows, trees, sample):
    """With many rows no row is in two trees; with few, arcs overlap; every tree has its number of rows."""
    df = spark.range(rows).select(F.col("id").alias("key"), F.col("id").cast("double").alias("x"))
    picked = isolation.sample_trees(df, ["x"], "key", trees, sample, 1).select("tree", F.col("values")[0].alias("x"))
    sizes = {r.tree: r["count"] for r in picked.groupBy("tree").count().collect()}
    assert sizes == dict.fromkeys(range(trees), min(rows, sample))
    assert picked.distinct().count() == picked.count()
    if rows == 20_000:
        assert picked.select("x").distinct().count() == picked.count()


def test_related_types_of_dense_rows(spark):
    rng = random.Random(8)
    kinds = ["login_failure", "process_create", "network_connection", "a", "b", None]
    rows = [("h", "u", rng.randrange(3000) * 1_000_000, i, rng.choices(kinds, [1, 1, 1, 30, 3, 2])[0]) for i in range(700)]
    df = spark.createDataFrame(rows, "host string, user_name string, at bigint, seq bigint, event_type string")
    found = {r.seq: r for r in behavior.suspicious_chain(df, span=400, rows=60, with_types=True).collect()}
    ordered = sorted(rows, key=lambda r: (r[2], r[3]))
    for n, (*_, at, seq, _) in enumerate(ordered):
        recent = [r for r in ordered[max(n - 59, 0) : n + 1] if r[2] >= at - 400 * 1_000_000]
        types = sorted({r[4] for r in recent if r[4] is not None})
        assert found[seq].related_types == types and found[seq].related_event_count == len(recent)
        assert found[seq].suspicious_chain == {"login_failure", "process_create", "network_connection"}.issubset(types)


def test_headers_are_found_without_sorting_lines(spark, tmp_path, monkeypatch):
    """A task keeps a line per file while it looks for headers; the first filled line counts."""
    plans = []

    def kept(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return settle(df)

    settle = files.settle
    monkeypatch.setattr(files, "settle", kept)
    write_csv(tmp_path / "a.csv", ["x", "label"], [["1", "BENIGN"], ["0", "a"]])
    (tmp_path / "b.csv").write_text("\n  \nlabel,x\nz,5\n")
    found = files.read_csv_folder(spark, str(tmp_path))
    assert sorted((r.x, r.label) for r in found.collect()) == [("0", "a"), ("1", "BENIGN"), ("5", "z")]
    assert plans and all("ObjectHashAggregate" in plan and "SortAggregate" not in plan for plan in plans)
