import json
import os

import pytest
from pyspark.sql import functions as F

from trailweave.__main__ import main
from trailweave.functions.keys import java_hash, uniform
from trailweave.operators import walks
from trailweave.plans.programs import PROGRAMS
from trailweave.sinks import clusters as sinks
from trailweave.sources.clusters import (
    NO_CLUSTERS, NO_COLON, NO_MEMBERS, NO_TEXT, member_edges, read_cluster_edges, read_clusters, result_sets,
)
from trailweave.sources.logs import read_log


@pytest.fixture(scope="module")
def csv_log(tmp_path_factory):
    path = tmp_path_factory.mktemp("log") / "log.csv"
    lines = ["time:timestamp,Activity,extra,concept:name,case:concept:name"]
    for i in range(120):
        activity = ["go_to start", "wash/rinse", "sit", "eat", "sleep"][i * i % 7 % 5]
        lines.append(f"2024-03-{1 + i // 40:02d} {i % 24:02d}:{i % 60:02d}:00+01:00,{activity},x,{activity},case{i // 30}")
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_read_log_keeps_file_order_and_shifts_to_utc(spark, csv_log):
    log = read_log(spark, csv_log)
    assert dict(log.dtypes) == {"event_id": "bigint", "case_id": "string", "ts": "timestamp_ntz", "activity": "string", "cluster": "string"}
    first = log.orderBy("event_id").first()
    assert (first.activity, first.cluster, str(first.ts)) == ("go_to start", "case0", "2024-02-29 23:00:00")
    assert log.count() == 120


def test_read_log_with_the_default_pattern_and_bad_times(spark, tmp_path):
    path = tmp_path / "log.csv"
    path.write_text("Activity,concept:name,case:concept:name,time:timestamp\na,a,p,2024-01-01 10:00:00\nb,b,p,never\n")
    rows = {r.activity: r.ts for r in read_log(spark, str(path), timestamp_format=None).collect()}
    assert str(rows["a"]) == "2024-01-01 10:00:00" and rows["b"] is None


def test_clusters_are_trimmed_and_keep_line_order(spark, tmp_path, as_rows):
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "one.txt").write_text("-20:eat, go_to start, sit\n7:alone\nno clusters here\n")
    (tmp_path / "r" / "two.txt").write_text("eat:b,a\n")
    members = as_rows(read_clusters(spark, str(tmp_path / "r")).select("name", "cluster_id", "position", "activity"))
    assert members == [
        ("one.txt", "-20", 0, "eat"), ("one.txt", "-20", 1, "go_to start"), ("one.txt", "-20", 2, "sit"),
        ("one.txt", "7", 0, "alone"), ("two.txt", "eat", 0, "b"), ("two.txt", "eat", 1, "a"),
    ]
    edges = as_rows(read_cluster_edges(spark, str(tmp_path / "r")).select("name", "src", "dst", "cluster_id"))
    assert edges == [("one.txt", "eat", "go_to start", "-20"), ("one.txt", "go_to start", "sit", "-20"), ("two.txt", "b", "a", "eat")]


def test_result_sets_are_named_by_path_and_bad_ones_are_listed(spark, tmp_path, as_rows):
    root = tmp_path / "all results+1"
    clusters = spark.createDataFrame([("k", "b"), ("k", "a"), ("m", "c")], "cluster_id string, activity string")
    sinks.write_lines(clusters, f"{root}/runs/one")
    sinks.write_lines(clusters.where("cluster_id = 'm'"), f"{root}/runs/two")
    sinks.write_communities_json(clusters, f"{root}/three")
    sinks.write_members_json(clusters, f"{root}/t=0.05")
    clusters.write.parquet(f"{root}/table")
    (root / "A1.txt").write_text("0:x,y\nno colon\n\n1:z")
    (root / "spoiled.txt").write_text("nothing here\n")
    (root / "empty.txt").write_text("")
    (root / "bad.json").write_text('{"members": 7}\n{"other": []}\n')
    sets = result_sets(spark, str(root))
    assert as_rows(sets.names) == [("A1.txt",), ("runs/one",), ("runs/two",), ("t=0.05",), ("three",)]
    edges = as_rows(member_edges(sets.clusters).select("name", "src", "dst", "cluster_id"))
    assert [e[:3] for e in edges] == [("A1.txt", "x", "y"), ("runs/one", "a", "b"), ("t=0.05", "a", "b"), ("three", "a", "b")]
    assert (edges[0][3], edges[1][3], edges[3][3]) == ("0", "k", "k")
    got = {tuple(r) for r in sets.rejected.select("name", "reason", "value").collect()}
    assert got == {
        ("A1.txt", NO_COLON, "no colon"), ("A1.txt", NO_COLON, ""), ("spoiled.txt", NO_COLON, "nothing here"),
        ("spoiled.txt", NO_CLUSTERS, None), ("table", NO_TEXT, None),
        ("bad.json", NO_MEMBERS, '{"members": 7}'), ("bad.json", NO_MEMBERS, '{"other": []}'), ("bad.json", NO_CLUSTERS, None),
    }
    # A folder or a file given directly has its own name.
    assert as_rows(result_sets(spark, f"{root}/runs/one").names) == [("one",)]
    assert as_rows(result_sets(spark, f"{root}/A1.txt").names) == [("A1.txt",)]


def test_positions_follow_files_of_unequal_size(spark, tmp_path):
    """The larger file is read first by Spark; ids follow the names all the same, and blocks within a file."""
    head = "Activity,concept:name,case:concept:name,time:timestamp\n"
    row = "{0},{0},p,2024-01-01 10:00:00+00:00\n"
    (tmp_path / "1.csv").write_text(head + row.format("a0"))
    (tmp_path / "2.csv").write_text(head + "".join(row.format(f"b{i:05d}") for i in range(4000)))
    (tmp_path / "3.csv").write_text(head + "".join(row.format(f"c{i}") for i in range(5)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        found = read_log(spark, str(tmp_path)).select("event_id", "activity").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len({r.event_id for r in found}) == 4006 and min(r.event_id for r in found) >= 0
    names = [r.activity for r in sorted(found, key=lambda r: r.event_id)]
    assert names == ["a0", *(f"b{i:05d}" for i in range(4000)), *(f"c{i}" for i in range(5))]


def test_the_last_label_of_an_edge_is_that_of_the_last_file(spark, tmp_path):
    folder = tmp_path / "set"
    folder.mkdir()
    (folder / "part-00000.txt").write_text("first:a,b\n")
    (folder / "part-00001.txt").write_text("".join(f"{i}:x{i},y{i}\n" for i in range(500)) + "last:a,b\n")
    edges = read_cluster_edges(spark, str(folder)).where("src = 'a'")
    assert edges.agg(F.max_by("cluster_id", "seq")).first()[0] == "last"


def test_sinks_round_trip(spark, tmp_path, as_rows):
    clusters = spark.createDataFrame([("k", "b"), ("k", "a"), ("m", "c")], "cluster_id string, activity string")
    out = str(tmp_path)
    sinks.write_lines(clusters, f"{out}/lines")
    assert as_rows(spark.read.text(f"{out}/lines")) == [("k:a,b",), ("m:c",)]
    sinks.write_members_json(clusters, f"{out}/members")
    assert as_rows(spark.read.text(f"{out}/members")) == [('{"members":["a","b"]}',), ('{"members":["c"]}',)]
    sinks.write_communities_json(clusters, f"{out}/communities")
    assert as_rows(spark.read.text(f"{out}/communities"))[0] == ('{"community":"k","members":["a","b"]}',)
    sinks.write_csv(clusters, f"{out}/csv")
    assert as_rows(spark.read.option("header", True).csv(f"{out}/csv").select("ClusterID", "Activity")) == [("k", "a"), ("k", "b"), ("m", "c")]
    assert as_rows(sinks.numbered(clusters)) == [(0, "a"), (0, "b"), (1, "c")]


def test_java_hash_matches_the_string_hash(spark):
    def want(text):
        data = text.encode("utf-16-be")
        h = 0
        for i in range(0, len(data), 2):
            h = (31 * h + int.from_bytes(data[i : i + 2], "big")) % 2**32
        return h - 2**32 if h >= 2**31 else h

    names = ["eat_cold_meal", "", "ä€", "😀x", "go_to start"]
    df = spark.createDataFrame([(n,) for n in names], "t string")
    got = {r.t: r.h for r in df.select("t", java_hash(F.col("t")).alias("h")).collect()}
    assert got == {n: want(n) for n in names}
    assert got["eat_cold_meal"] == -2060451817


def test_uniform_depends_on_keys_only(spark):
    df = spark.range(1000).select("id", uniform(3, F.col("id")).alias("u"))
    first = dict(df.collect())
    assert dict(df.repartition(7).collect()) == first
    assert all(0 <= u < 1 for u in first.values()) and 0.45 < sum(first.values()) / 1000 < 0.55


def records(folder):
    return [json.loads(line) for f in sorted(os.listdir(folder)) if f.startswith("part-") for line in open(f"{folder}/{f}")]


def test_all_programs_write_results_that_are_scored(csv_log, tmp_path, monkeypatch):
    """Every program below one folder; the scores name each clustering, and what is none is listed."""
    assert len(PROGRAMS) == 20
    monkeypatch.setattr(walks, "LONG_WALKS", 20)
    for program in PROGRAMS:
        main([program, "--log", csv_log, "--out", str(tmp_path / "results" / program)])
        assert [f for _, _, files in os.walk(tmp_path / "results" / program) for f in files if f.startswith("part-")], program
    (tmp_path / "results" / "odd.txt").write_text("no cluster\n")
    main(["score", "--log", csv_log, "--results", str(tmp_path / "results"), "--out", str(tmp_path / "out")])
    ranked = records(tmp_path / "out" / "slim_sorted")
    names = {r["name"] for r in ranked}
    assert [r["custom_found"] for r in ranked] == sorted((r["custom_found"] for r in ranked), reverse=True)
    lines = {
        "successor-merge", "neighbourhood-merge", "frequent-components", "window-votes", "case-votes", "case-strong-components",
        "global-votes", "min-label", "min-label-communities", "consensus-clusters/lines", "consensus-clusters/json", "overlapping",
        "aggregated", "walk-clusters", "walk-min-label", "daily-votes",
    }
    assert {n for n in names if "threshold" not in n} <= lines and len(names & lines) >= 12
    assert any(n.startswith("label-thresholds/threshold=") for n in names)
    bad = {(r["name"], r["reason"]) for r in records(tmp_path / "out" / "rejected")}
    assert {("odd.txt", NO_COLON), ("odd.txt", NO_CLUSTERS), ("transitions", NO_TEXT), ("flow-groups", NO_MEMBERS)} <= bad


def test_score_ranks_result_files(csv_log, tmp_path):
    results = tmp_path / "results"
    results.mkdir()
    (results / "good.txt").write_text("0:go_to start,wash/rinse,eat\n1:sit,sleep\n")
    (results / "none.txt").write_text("0:go_to start\n1:sit\n")
    out = str(tmp_path / "out")
    main(["score", "--log", csv_log, "--results", str(results), "--out", out])
    ranked = []
    for f in sorted(os.listdir(f"{out}/slim_sorted")):
        if f.startswith("part-"):
            ranked += [json.loads(line) for line in open(f"{out}/slim_sorted/{f}")]
    assert [r["name"] for r in ranked] == ["good.txt", "none.txt"]
    assert set(ranked[0]) == {"name", "found_relationships", "ratio_found", "nmi", "ari", "f1", "accuracy", "custom_found"}
    assert ranked[1]["found_relationships"] == 0 and ranked[1]["custom_found"] == 0
