"""Queries of the general problems (1 and 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lapidar.operators import hierarchy, nested
from lapidar.runtime import spread, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.flatten_records(spread(table(spark, sf_dir, "zenon_records")))


def p1_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.part_table(spread(table(spark, sf_dir, "zenon_records")))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.Hierarchy(table(spark, sf_dir, "epochs").select("id", "parent_ids")).paths()


def p5_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.Hierarchy(table(spark, sf_dir, "epochs").select("id", "parent_ids")).descendants()


QUERIES = {"p1_found": p1_found, "p1_parts": p1_parts, "p5_found": p5_found, "p5_descendants": p5_descendants}

# -- SQL

_SQL_RECORDS = r"""with recursive raw as (
  select delivery_id, record_id, harvested_at, loaded_at, substring(payload, instr(payload, '{')) as t from zenon_records where instr(payload, '{') > 0 and record_id is not null),
ends as (select *, list_filter(range(1, length(t) + 1), lambda i: t[i] = '}' and json_valid(t[1:i])) as e from raw),
readable as (select record_id, harvested_at, loaded_at, delivery_id, t[1:e[1]] as body from ends where len(e) > 0),
records as (select record_id, cast(body as json) as body from (
  select *, row_number() over (partition by record_id order by harvested_at desc nulls last, loaded_at desc nulls last, delivery_id desc) as k from readable) where k = 1),
nodes as (
  select record_id, '' as path, body from records
  union all
  select record_id, case when path = '' then '' else path || '.' end || i, part from (
    select record_id, path, i, case when kind = 'ARRAY' then json_extract(parts, '$[' || i || ']') else parts end as part
    from (select record_id, path, parts, kind, unnest(range(cast(case when kind = 'ARRAY' then json_array_length(parts) else 1 end as bigint))) as i
      from (select record_id, path, json_extract(body, '$.parts') as parts, json_type(body, '$.parts') as kind from nodes) where parts is not null))
  where json_type(part) = 'OBJECT')"""

_SQL_P1_FOUND = _SQL_RECORDS + r""",
fields as (
  select record_id, path, f as field, json_extract(body, '$.' || f) as v, 'list' as how, case f when 'urls' then 'url' when 'publicationDates' then 'date' else 'name' end as key
  from nodes, unnest(['urls', 'publicationDates', 'authors.primary', 'authors.secondary', 'authors.corporate']) as x(f)),
typed as (select *, json_type(v) as kind from fields where v is not null and json_type(v) <> 'NULL'),
-- authors as an object: its name, or else its keys
keyed as (select record_id, path, field, generate_subscripts(k, 1) - 1 as pos, unnest(k) as value from (
  select record_id, path, field, json_keys(v) as k from typed where kind = 'OBJECT' and key = 'name' and json_extract_string(v, '$.name') is null)),
entries as (select record_id, path, field, key, i as pos, case when kind = 'ARRAY' then json_extract(v, '$[' || i || ']') else v end as e
  from (select *, unnest(range(cast(case when kind = 'ARRAY' then json_array_length(v) else 1 end as bigint))) as i from typed where not (kind = 'OBJECT' and key = 'name' and json_extract_string(v, '$.name') is null))),
found as (select record_id, path, field, pos, case when json_type(e) = 'OBJECT' then json_extract_string(e, '$.' || key) else json_extract_string(e, '$') end as value from entries union all select * from keyed)
select record_id, path as part_path, field, cast(pos as bigint) as pos, value from found where value is not null"""

_SQL_P1_PARTS = _SQL_RECORDS + r"""
select record_id, path as part_path, case when path <> '' then regexp_replace(path, '\.?[0-9]+$', '') end as parent_path,
  case when path = '' then 0 else length(path) - length(replace(path, '.', '')) + 1 end as level, json_extract_string(body, '$.title') as title from nodes"""

_SQL_EDGES = r"""with recursive nodes as (select distinct id from epochs where id is not null),
edges as (select distinct id, parent from (select id, regexp_replace(unnest(parent_ids), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') as parent from epochs where id is not null) where parent in (select id from nodes)),
reach(id, descendant) as (select parent, id from edges union select r.id, e.id from reach r join edges e on e.parent = r.descendant)"""

_SQL_P5_FOUND = _SQL_EDGES + """,
cyclic as (select id from reach where id = descendant),
below as (select distinct descendant as id from reach where id in (select id from cyclic) and descendant not in (select id from cyclic)),
ways(id, root_id, depth, path) as (
  select id, id, cast(0 as bigint), id from nodes where id not in (select id from edges)
  union all
  select e.id, w.root_id, w.depth + 1, w.path || '/' || e.id from ways w join edges e on e.parent = w.id where e.id not in (select id from cyclic) and e.id not in (select id from below))
select id, 'path' as state, root_id, depth, path from ways
union all select id, 'cycle', '', -1, '' from cyclic
union all select id, 'below', '', -1, '' from below"""

ORACLES = {"p1_found": _SQL_P1_FOUND, "p1_parts": _SQL_P1_PARTS, "p5_found": _SQL_P5_FOUND, "p5_descendants": _SQL_EDGES + "\nselect id, descendant from reach"}
