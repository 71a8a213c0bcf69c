import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from loomspark.plans.queries import ORACLE, QUERIES
from tests.oracle import both, connection

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connection(SF)


#: Findings that the tables need not hold.
MAY_BE_EMPTY = {"corpus_sanity", "figures"}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, con, name):
    got, want = both(spark, con, QUERIES[name], ORACLE[name], SF)
    assert len(got) == len(want) and (want or name in MAY_BE_EMPTY)
    wrong = [(a, b) for a, b in zip(got, want, strict=True) if a != b]
    assert not wrong, wrong[:3]


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


def test_tied_readings_come_in_the_order_of_the_table(spark, tmp_path):
    """Equal in wall, line number and life (nothing is left), different in rate: the first in the file governs."""
    lines = {"l_orderkey": [1, 6, 1, 6], "l_linenumber": [7, 7, 7, 7], "l_quantity": [4.0, 2.0, 2.0, 4.0], "l_tax": [0.05, 0.04, 0.04, 0.05]}
    pq.write_table(pa.table({**lines, "l_linenumber": pa.array(lines["l_linenumber"], pa.int32())}), f"{tmp_path}/lineitem.parquet")
    got, want = both(spark, connection(str(tmp_path)), QUERIES["governing_min_by"], ORACLE["governing_min_by"], str(tmp_path))
    assert got == want
    rate = {r.doc_id: r.rate for r in QUERIES["governing_min_by"](spark, str(tmp_path)).collect()}
    assert rate == {1: 0.2, 6: 0.16}
