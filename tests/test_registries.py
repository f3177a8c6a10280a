"""Registry files: broken records stay as rows with reasons, and every fault of a split or binding is named."""

import json

from padlens.sources import registries as S


def triples(df):
    return sorted(tuple(r) for r in df.collect())


def test_broken_records_stay_as_rows(spark, tmp_path):
    lines = ['{"a": 1, "u": [1, 2]}', '{"a": 1, "u": [1', '{"a": "x", "u": []}', '{"u": [3]}', "", '{"a": 2, "u": null}']
    (tmp_path / "r.jsonl").write_text("\n".join(lines))
    rows = S.json_rows(spark, str(tmp_path), "a long, u array<long>", ["a", "u"]).collect()
    assert sorted((r["reason"] or "", r["record"] or "") for r in rows) == sorted([("", ""), ("not_json", lines[1]), ("not_json", lines[2]), ("missing:a", ""), ("missing:u", "")])
    assert all(r["file"].endswith("r.jsonl") for r in rows)
    (tmp_path / "whole").mkdir()
    (tmp_path / "whole" / "s.json").write_text(json.dumps({"a": 1, "u": [5]}, indent=2))
    assert [(r["a"], r["u"], r["reason"]) for r in S.json_rows(spark, str(tmp_path / "whole"), "a long, u array<long>", ["a"], True).collect()] == [(1, [5], None)]


def test_split_faults(spark):
    schema = "s string, train_users array<long>, val_users array<long>, test_users array<long>"
    good, bad = ("x", [1, 2, 3], [4], [5]), ("y", [1, 2, 2], [1, 9], [])
    known = spark.createDataFrame([(s, u) for s in "xy" for u in range(1, 6)], "s string, user_id long")
    sizes = {"train": 3, "val": 1, "test": 1}
    of = lambda rows: S.split_faults(S.split_users(spark.createDataFrame(rows, schema), ["s"]), ["s"], sizes, known.filter("s = '%s'" % rows[0][0]))
    assert triples(of([good])) == []
    assert triples(of([bad])) == sorted([
        ("y", "user_twice_in_pool", "train/2"), ("y", "user_in_several_pools", "train+val/1"), ("y", "unknown_user", "9"),
        *(("y", "user_in_no_pool", u) for u in "345"), ("y", "pool_size", "train/2"), ("y", "pool_size", "val/2"), ("y", "pool_size", "test/0"),
    ])


def test_overlaps_and_bindings(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    assert triples(S.overlaps({"refs": ids(1, 2, 2), "eval": ids(2, 3), "train": ids(2, 9, 3)}, "id")) == [(2, "eval+refs+train"), (3, "eval+train")]
    bound = spark.createDataFrame([(1, "a"), (2, "b"), (2, "a"), (3, "zz")], "id long, target string")
    registry = spark.createDataFrame([("a",), ("b",), ("c",)], "target string")
    assert triples(S.binding_faults(bound, registry, "id", "target")) == [("bound_to_nothing", "3"), ("bound_twice", "2"), ("never_bound", "c")]


def test_cells_round_trip_and_reasons(spark, tmp_path):
    cells = spark.createDataFrame([("m", "tap", "imu", "d1", 0.25, 0.5), ("m", "tap", "imu", "d0", None, 1.0), ("m", None, "imu", "d2", 0.5, 0.5), ("m", "x", "imu", "d3", 1.5, 0.5)], S.CELLS)
    S.write_cells(cells, str(tmp_path / "out"))
    got = {r["detector"]: (r["far_at_frr5"], r["eer_test"], r["reason"]) for r in S.read_cells(spark, str(tmp_path / "out")).collect()}
    assert got == {"d1": (0.25, 0.5, None), "d0": (None, 1.0, None), "d2": (0.5, 0.5, "unnamed_cell"), "d3": (1.5, 0.5, "bad:far_at_frr5")}
    (tmp_path / "odd.csv").write_text("method,action,modality,detector,far_at_frr5,eer_test\nm,tap,imu,d,abc,0.1\nm,tap,imu,e,NaN,0.1\n")
    assert {(r["detector"], r["far_at_frr5"], r["reason"]) for r in S.read_cells(spark, str(tmp_path / "odd.csv")).collect() if r["detector"] == "d"} == {("d", None, "bad:far_at_frr5")}
