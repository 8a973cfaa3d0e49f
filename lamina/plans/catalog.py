"""The queries of the core, by name, and the SQL that says the same."""

from __future__ import annotations

from lamina.operators import history
from lamina.plans import graphs, indicators, issuers, loading, textual
from lamina.sources.tables import table


def p2_found(spark, folder):
    return history.versions_with_late_updates(table(spark, folder, "entity_snapshots"))


P2_SQL = r"""
WITH raw AS (
  SELECT stable_id, snap_id, recorded_at, properties,
         lower(trim(regexp_replace(properties['valid_from'], '\s+', ' ', 'g'))) AS vf,
         lower(trim(regexp_replace(properties['valid_to'], '\s+', ' ', 'g'))) AS vt
  FROM entity_snapshots WHERE stable_id IS NOT NULL),
dated AS (
  SELECT stable_id, snap_id, recorded_at, properties,
         coalesce(CASE WHEN regexp_full_match(vf, '\d{4}') THEN vf || '-01-01' WHEN regexp_full_match(vf, '\d{4}-\d{2}-\d{2}') THEN vf END,
                  strftime(recorded_at, '%Y-%m-%d')) AS on_day,
         CASE WHEN regexp_full_match(vt, '\d{4}') THEN vt || '-01-01' WHEN regexp_full_match(vt, '\d{4}-\d{2}-\d{2}') THEN vt END AS stop
  FROM raw),
attrs AS (
  SELECT stable_id, on_day, recorded_at, snap_id, lower(e.key) AS attr, lower(trim(regexp_replace(e.value, '\s+', ' ', 'g'))) AS v
  FROM dated, unnest(map_entries(properties)) AS u(e) WHERE e.key NOT IN ('valid_from', 'valid_to', 'is_current')),
last_of_day AS (
  SELECT stable_id, on_day, attr, arg_max(v, (recorded_at, snap_id)) AS v FROM attrs
  WHERE v IS NOT NULL AND v NOT IN ('', 'none', 'null') GROUP BY ALL),
steps AS (
  SELECT *, v IS DISTINCT FROM lag(v) OVER (PARTITION BY stable_id, attr ORDER BY on_day) AS d FROM last_of_day),
changed AS (SELECT stable_id, on_day, bool_or(d) AS d FROM steps GROUP BY ALL),
days AS (SELECT stable_id, on_day, last(stop ORDER BY recorded_at, snap_id) AS stop FROM dated GROUP BY ALL),
a AS (SELECT stable_id, on_day, coalesce(d, false) AS d, stop, lead(on_day) OVER (PARTITION BY stable_id ORDER BY on_day) AS nxt
      FROM days LEFT JOIN changed USING (stable_id, on_day)),
b AS (SELECT *, CASE WHEN stop > on_day AND (nxt IS NULL OR nxt >= stop) THEN stop END AS fin,
             bool_or(d) OVER (PARTITION BY stable_id ORDER BY on_day) AS known FROM a),
c AS (SELECT *, known AND (d OR lag(fin) OVER (PARTITION BY stable_id ORDER BY on_day) IS NOT NULL) AS starts FROM b),
e AS (SELECT *, sum(starts::INT) OVER (PARTITION BY stable_id ORDER BY on_day) AS n FROM c),
f AS (SELECT stable_id, n, min(on_day) AS valid_from, max(fin) AS fin FROM e WHERE n > 0 GROUP BY ALL)
SELECT stable_id, valid_from,
       coalesce(fin, lead(valid_from) OVER (PARTITION BY stable_id ORDER BY valid_from), '9999-12-31') AS valid_to FROM f
"""


QUERIES = {"p2_found": (p2_found, P2_SQL)} | graphs.QUERIES | textual.QUERIES | issuers.QUERIES | loading.QUERIES | indicators.queries_with(P2_SQL)


def queries():
    return {k: f for k, (f, _) in QUERIES.items()}


def oracle_sql():
    return {k: sql for k, (_, sql) in QUERIES.items() if sql}
