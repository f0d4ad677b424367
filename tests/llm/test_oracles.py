"""The corpus queries against their SQL in DuckDB."""

from pathlib import Path

import duckdb
import pytest

from quillgrid.llm import queries


@pytest.mark.parametrize(("name", "sf"), [("op1_near_duplicates", "sf0.001"), ("op2_decontamination", "sf0.01"), ("op8_substring_dedup", "sf0.01"), ("op10_quality", "sf0.1")])
def test_query_matches_its_oracle(spark, data, name, sf):
    """op10 on the table that has labels enough to certify cutoffs."""
    folder = data.replace("sf0.001", sf)
    con = duckdb.connect()
    for path in Path(folder).glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    got, expected = queries.QUERIES[name](spark, folder).toPandas(), con.execute(queries.ORACLES[name]).df()
    order = lambda d: d[sorted(d.columns)].astype(str).sort_values(sorted(d.columns)).reset_index(drop=True)
    assert order(got).equals(order(expected))
    if name == "op10_quality":
        assert (~got.kept & ~got.base_failed).any()
