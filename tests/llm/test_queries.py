"""The registered queries: with SQL against SQL, all others by their columns."""

import pytest

from checks.compare import compare
from framelark.llm.queries import ORACLES, QUERIES
from tests.conftest import SF


def test_all_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, con, name):
    assert compare(spark, con, QUERIES[name], ORACLES[name], SF) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_one_row_per_document(spark, con, name):
    table, key = ("embeddings", "vec_id") if "lattice" in name or "vector" in name else ("documents", "doc_id")
    got = QUERIES[name](spark, SF)
    ids = {r[0] for r in got.select(key).collect()}
    assert ids == {r[0] for r in con.execute(f"SELECT {key} FROM {table}").fetchall()}
