"""Register of queries: name -> (function of a session and a folder of tables, DuckDB SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

#: Hits and misses of a cache of five hours for each user: each write is the first success at least that long after the one before.
CACHE_SQL = """WITH RECURSIVE ok AS (SELECT user_id, ts, event_id FROM events WHERE event_type <> 'error'),
w AS (SELECT user_id, min(struct_pack(t := ts, e := event_id)) AS x FROM ok GROUP BY 1
 UNION ALL SELECT w.user_id, min(struct_pack(t := ok.ts, e := ok.event_id)) FROM w JOIN ok ON ok.user_id = w.user_id AND ok.ts >= w.x.t + INTERVAL 5 HOUR GROUP BY w.user_id, w.x),
h AS (SELECT e.user_id, e.event_id, coalesce(bool_or(w.x.t + INTERVAL 5 HOUR > e.ts AND (w.x.t, w.x.e) < (e.ts, e.event_id)), false) AS hit FROM events e LEFT JOIN w ON w.user_id = e.user_id GROUP BY 1, 2)
SELECT user_id AS subject, CASE WHEN hit THEN 'HIT' ELSE 'MISS' END AS cache, count(*) AS n FROM h GROUP BY 1, 2"""

_FIVE_HOURS = 5 * 3600 * 1_000_000
#: What caches of four entries do, one for every ten users: requests and landings of lookups in the order of time, folded.
BOUNDED_CACHE_SQL = f"""WITH ev AS (SELECT user_id // 10 AS owner, user_id AS s, event_id AS e, event_type <> 'error' AS ok, epoch_us(ts) AS t,
 epoch_us(ts) + (event_id % 89 + 1) * 60000000 AS d FROM events WHERE user_id IS NOT NULL),
steps AS (SELECT owner, t, 1 AS k, e, s, ok FROM ev UNION ALL SELECT owner, d, 0, e, s, ok FROM ev),
lists AS (SELECT owner, list({{'t': t, 'k': k, 'e': e, 's': s, 'ok': ok, 'en': []::STRUCT(s BIGINT, w BIGINT)[], 'fl': []::STRUCT(s BIGINT, e BIGINT)[],
  'hit': 0::BIGINT, 'miss': 0::BIGINT, 'coal': 0::BIGINT, 'expired': 0::BIGINT, 'size': 0::BIGINT}} ORDER BY t, k, e) AS xs FROM steps GROUP BY 1),
folded AS (SELECT owner, list_reduce(list_prepend({{'t': -1::BIGINT, 'k': 2, 'e': -1::BIGINT, 's': -1::BIGINT, 'ok': false, 'en': []::STRUCT(s BIGINT, w BIGINT)[],
  'fl': []::STRUCT(s BIGINT, e BIGINT)[], 'hit': 0::BIGINT, 'miss': 0::BIGINT, 'coal': 0::BIGINT, 'expired': 0::BIGINT, 'size': 0::BIGINT}}, xs), lambda a, x:
  list_transform([list_filter(a.en, lambda y: y.w + {_FIVE_HOURS} > x.t)], lambda live: list_transform([{{
    'owns': x.k = 0 AND list_contains(list_transform(a.fl, lambda y: y.e), x.e),
    'has': x.k = 1 AND list_contains(list_transform(live, lambda y: y.s), x.s),
    'flies': x.k = 1 AND list_contains(list_transform(a.fl, lambda y: y.s), x.s)}}], lambda q: {{'t': x.t, 'k': x.k, 'e': x.e, 's': x.s, 'ok': x.ok,
    'en': CASE WHEN q.owns AND x.ok THEN CASE WHEN len(live) >= 4 THEN live[2:] ELSE live END || [{{'s': x.s, 'w': x.t}}] ELSE live END,
    'fl': CASE WHEN q.owns THEN list_filter(a.fl, lambda y: y.e <> x.e) WHEN x.k = 1 AND NOT q.has AND NOT q.flies THEN a.fl || [{{'s': x.s, 'e': x.e}}] ELSE a.fl END,
    'hit': a.hit + CASE WHEN q.has THEN 1 ELSE 0 END, 'miss': a.miss + CASE WHEN x.k = 1 AND NOT q.has THEN 1 ELSE 0 END,
    'coal': a.coal + CASE WHEN q.flies AND NOT q.has THEN 1 ELSE 0 END, 'expired': a.expired + len(a.en) - len(live),
    'size': a.size + CASE WHEN q.owns AND x.ok AND len(live) >= 4 THEN 1 ELSE 0 END}})[1])[1]) AS r FROM lists)
SELECT owner, cache, n FROM (SELECT owner, unnest(['HIT', 'MISS', 'COALESCED', 'EXPIRED', 'SIZE']) AS cache,
  unnest([r.hit, r.miss, r.coal, r.expired + len(r.en), r.size]) AS n FROM folded) WHERE n > 0"""

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def cache_log(events):
    """Events as requests to the caches of ten users each; a lookup takes up to ninety minutes, errors fail."""
    end = F.timestamp_micros(F.unix_micros("ts") + (F.col("event_id") % 89 + 1) * 60_000_000)
    owner = F.floor(F.col("user_id") / 10).cast("bigint")
    return events.select(owner.alias("owner"), F.col("user_id").alias("subject"), "event_id", "ts", end.alias("end_ts"), (F.col("event_type") != "error").alias("ok"))


def load(spark, sf_dir: str, name: str, *columns: str):
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df
