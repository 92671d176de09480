"""Every registered query with SQL gives the rows of DuckDB on small tables; streams equal their batch forms."""

import math
import os
from decimal import Decimal
from pathlib import Path

import pytest

from brindle import plans

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return round(float(v), 9) if isinstance(v, Decimal) else v


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = plans.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    cur = duck.execute(plans.oracle_sql()[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    want = sorted((tuple(norm(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=repr)
    assert got == want


def test_cache_stream_equals_batch_fold(spark):
    rows = plans.queries()["st4_cached_identities"](spark, SF).collect()
    e = spark.read.parquet(f"{SF}/events.parquet").selectExpr("user_id", "event_id", "cast(ts as timestamp) ts", "event_type <> 'error' ok").collect()
    by = {}
    for r in sorted(e, key=lambda r: (r.ts, r.event_id)):
        at, out = by.setdefault(r.user_id, [None, {}])
        hit = at is not None and (r.ts - at).total_seconds() < 18_000
        if not hit and r.ok:
            by[r.user_id][0] = r.ts
        out["HIT" if hit else "MISS"] = out.get("HIT" if hit else "MISS", 0) + 1
    assert {(r.subject, r.cache): r.n for r in rows} == {(u, c): n for u, (_, o) in by.items() for c, n in o.items()}


def test_deadlines_are_late_starts_only(spark):
    rows = plans.queries()["st3_deadlines"](spark, SF).collect()
    assert rows and all(r.span_id % 4 < 2 and r.error_code == "POLICY_DEADLINE_EXCEEDED" for r in rows)
