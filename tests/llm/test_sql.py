"""Every training-data query with SQL gives the rows that DuckDB gives."""

import pytest
import xxhash

from heatloom.llm.queries import ORACLE_SQL, QUERIES, xxh64_sql


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(matches_sql, name):
    matches_sql(QUERIES[name], ORACLE_SQL[name])


def test_xxh64_of_any_length():
    duckdb = pytest.importorskip("duckdb")
    texts = ["é漢" + "abcdefghij"[: n % 10] * (n // 3) for n in range(80)] + [""]
    con = duckdb.connect()
    got = con.execute(f"WITH s AS (SELECT unnest($1) AS t), {xxh64_sql('s', 't', 7)} SELECT * FROM hashed", [texts]).fetchall()
    assert dict(got) == {t: xxhash.xxh64_intdigest(t.encode(), 7) for t in texts}
