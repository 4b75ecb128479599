"""Raw documents and snapshots."""

import datetime as dt
import gzip
import json

import pytest

from panelloom.sources import raw


def test_raw_documents(spark, tmp_path):
    (tmp_path / "e.json").write_text(json.dumps({"name": None, "tvl": [{"date": 86399, "totalLiquidityUSD": 2.5}, {"date": None, "totalLiquidityUSD": 1.0}, {"date": 5, "totalLiquidityUSD": None}]}))
    with gzip.open(tmp_path / "s.json.gz", "wt") as f:
        json.dump([{"date": 86400, "totalCirculatingUSD": {"peggedUSD": 7.0}}, {"date": 1, "totalCirculatingUSD": None}], f)
    got = raw.entity_history(raw.read_json(spark, raw.raw_path(str(tmp_path), "e"), raw.HISTORY), "e", "Entity", "c").collect()
    assert [(r.period, r.name, r.value) for r in got] == [(dt.date(1970, 1, 1), "Entity", 2.5)]
    got = raw.aggregate_series(raw.read_json(spark, raw.raw_path(str(tmp_path), "s"), raw.SERIES)).collect()
    assert [(r.period, r.value) for r in got] == [(dt.date(1970, 1, 2), 7.0)]
    with pytest.raises(FileNotFoundError):
        raw.raw_path(str(tmp_path), "none")


def test_factor_manifest(spark, tmp_path):
    day = 86400
    chunk = {"coins": {"x": {"symbol": "X", "confidence": 0.9, "prices": [{"timestamp": day - 4, "price": 1.0}, {"timestamp": day + 9, "price": 2.0}, {"timestamp": 9 * day, "price": 5.0}]}}}
    (tmp_path / "c.json").write_text(json.dumps(chunk))
    (tmp_path / "g.json").write_text(json.dumps({"coins": {"x": {"symbol": "X", "price": 3.0, "timestamp": 2 * day - 1}}}))
    (tmp_path / "m.json").write_text(json.dumps({"coin_identifier": "x", "raw_files": ["raw/c.json"], "gap_files": ["g.json"], "sample_cutoff": "1970-01-05"}))
    got = raw.factor_from_manifest(spark, str(tmp_path), "m.json").orderBy("period").collect()
    assert [(r.period, r.level) for r in got] == [(dt.date(1970, 1, 2), 2.0), (dt.date(1970, 1, 3), 3.0)]
    with pytest.raises(ValueError):
        raw.factor_prices(raw.read_json(spark, str(tmp_path / "c.json"), raw.FACTOR), None, "y")


def test_snapshots(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1)], "k string, n int")
    path, counts = raw.write_snapshot(df, str(tmp_path), ["k", "n"], "s1")
    assert counts == {"raw_rows": 3, "staged_rows": 2, "duplicates_removed": 1} and spark.read.parquet(path).count() == 3
    with pytest.raises(Exception, match="(?i)exists"):
        raw.write_snapshot(df, str(tmp_path), ["k", "n"], "s1")
    raw.write_csv(df, str(tmp_path / "csv"))
    assert raw.read_csv(spark, str(tmp_path / "csv"), "k string, n int").count() == 3
    raw.write_summary({"b": 1, "a": dt.date(2024, 1, 1)}, str(tmp_path / "x.json"))
    assert json.loads((tmp_path / "x.json").read_text()) == {"a": "2024-01-01", "b": 1}


def test_landed_snapshots(spark, tmp_path):
    from panelloom.sources import landed

    docs = spark.createDataFrame([("raw", "a", '{"x": 1}'), ("raw", "b", '{"x": 2}'), ("gap", "c", '{"x": 3}')], "kind string, stem string, document string").repartition(3)
    for s in ("s1", "s2"):
        landed.land(docs, str(tmp_path), s, {"note": s})
    df = landed.read_landed(spark, str(tmp_path))
    assert df.rdd.getNumPartitions() == 6 and df.count() == 6
    own = landed.read_landed(spark, str(tmp_path), "s2", "raw")
    assert own.rdd.getNumPartitions() == 2  # files of other snapshots and kinds are not even planned
    assert sorted((r.file, r.document) for r in own.collect()) == [("a.json.gz", '{"x": 1}'), ("b.json.gz", '{"x": 2}')]
    assert df.where("kind = 'gap'").unionByName(df.where("kind = 'raw'")).count() == 6 and landed.read_landed(spark, str(tmp_path), "none").count() == 0
    at = tmp_path / "snapshot_id=s1"
    (at / "a.json").write_text('{"x": "plain"}')
    assert df.where("file = 'a.json'").count() == 0  # the compressed one comes first
    (at / "a.json.gz").unlink()
    assert [r.document for r in df.where("file = 'a.json'").collect()] == ['{"x": "plain"}']
    (at / "a.json").write_text(" \n")
    with pytest.raises(Exception, match="is empty"):
        df.collect()
    (at / "a.json").unlink()
    with pytest.raises(Exception, match="no .*a.json.gz or"):
        df.collect()
    assert landed.read_landed(spark, str(tmp_path), "s2").count() == 3  # the broken snapshot is left alone


def test_refresh_is_one(spark, tmp_path):
    at = str(tmp_path)
    raw.full_refresh({"a": spark.range(3), "b": spark.range(4)}, at)
    broken = spark.range(2).selectExpr("raise_error('no luck') AS id")
    with pytest.raises(Exception, match="no luck"):
        raw.full_refresh({"a": spark.range(9), "b": broken}, at)
    assert {k: df.count() for k, df in raw.current(spark, at).items()} == {"a": 3, "b": 4}
    paths = raw.full_refresh({"a": spark.range(9), "b": spark.range(1)}, at)
    assert {k: df.count() for k, df in raw.current(spark, at).items()} == {"a": 9, "b": 1} and spark.read.parquet(paths["a"]).count() == 9
    with pytest.raises(FileNotFoundError):
        raw.current(spark, str(tmp_path / "none"))
