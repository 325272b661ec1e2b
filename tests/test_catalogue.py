"""Every registered query of the library against its DuckDB text, as the driver compares them."""

from __future__ import annotations

import os

import duckdb
import pytest

from bitloom.plans import catalogue


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


def shown(value) -> str:
    return f"{value + 0.0:.5f}" if isinstance(value, float) else str(value)


def rows(frame) -> list[tuple]:
    return sorted(tuple(map(shown, r)) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_against_sql(spark, sf_dir, duck, name):
    got, want = catalogue.QUERIES[name](spark, sf_dir).toPandas(), duck.execute(catalogue.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", ["encode_roundtrip_recursive", "encode_roundtrip_concatenated", "encode_roundtrip_auto", "codec_roundtrip", "flag_bench"])
def test_roundtrips(spark, sf_dir, name):
    got = catalogue.QUERIES[name](spark, sf_dir).toPandas()
    assert len(got) and got["ok"].all()


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
