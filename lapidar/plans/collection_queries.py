"""Queries of record selection, period names and translations, with the SQL they are checked against.

Nested url lists are built from orders, by customer; bibliographic records themselves are problem 1's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapidar.functions import text as T
from lapidar.operators import gazetteer as G
from lapidar.operators import records as R
from lapidar.operators import translate as X
from lapidar.runtime import table

_SQL_URL = "case o_orderkey % 4 when 0 then 'http://www' || (o_orderkey % 3) || '.host' || (o_orderkey % 17) || '.org/item/' || (o_orderkey % 40) when 1 then 'host' || (o_orderkey % 17) || '.org/pdf/' || (o_orderkey % 40) when 2 then 'https://books.site' || (o_orderkey % 5) || '.net/' || (o_orderkey % 40) else null end"
_SQL_DESC = "case o_orderkey % 5 when 0 then 'Online' when 1 then 'Volltext' when 2 then null else 'Contents' end"
SQL_RECORDS = f"rec as (select o_custkey as id, list(struct_pack(url := url, \"desc\" := d) order by o_orderkey) as urls from (select o_custkey, o_orderkey, {_SQL_URL} as url, {_SQL_DESC} as d from orders) group by 1)"


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = lambda x: x.cast("string")
    k = F.col("o_orderkey")
    url = (
        F.when(k % 4 == 0, F.concat(F.lit("http://www"), s(k % 3), F.lit(".host"), s(k % 17), F.lit(".org/item/"), s(k % 40)))
        .when(k % 4 == 1, F.concat(F.lit("host"), s(k % 17), F.lit(".org/pdf/"), s(k % 40)))
        .when(k % 4 == 2, F.concat(F.lit("https://books.site"), s(k % 5), F.lit(".net/"), s(k % 40)))
    )
    desc = F.when(k % 5 == 0, "Online").when(k % 5 == 1, "Volltext").when(k % 5 == 2, F.lit(None).cast("string")).otherwise("Contents")
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.struct(k.alias("k"), url.alias("url"), desc.alias("desc")).alias("u"))
    return o.groupBy("id").agg(F.array_sort(F.collect_list("u")).alias("u")).select("id", F.transform("u", lambda x: F.struct(x["url"].alias("url"), x["desc"].alias("desc"))).alias("urls"))


def _sizes(df: DataFrame) -> DataFrame:
    return df.select("id", F.size("urls").cast("bigint").alias("n_urls"))


def desc_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sizes(R.without_descriptions(_records(spark, sf_dir), ["Online", "Contents"]))


def url_pattern_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sizes(R.matching(_records(spark, sf_dir), "host1[0-9]?\\.org"))


PATTERNS = ["host1[0-9]?\\.org", "books\\.site[0-2]", "/pdf/"]


def url_pattern_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.matching_any(_records(spark, sf_dir), PATTERNS).select("id", "pattern", F.size("urls").cast("bigint").alias("n_urls"))


def hosts_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.host_counts(_records(spark, sf_dir))


def hosts_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.common_hosts(_records(spark, sf_dir), 20)


def pattern_cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.cooccurrence(_records(spark, sf_dir), PATTERNS[0], PATTERNS[1])


def record_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.reshaped(_records(spark, sf_dir))


def sample_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.sample(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), 25)


def earliest_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years, some spelt in ways that are no number, of each customer's orders."""
    y, k = F.year("o_orderdate").cast("string"), F.col("o_orderkey")
    raw = F.when(k % 6 == 0, F.concat(F.lit("["), y, F.lit("]"))).when(k % 6 == 1, F.concat(F.lit(" "), y, F.lit(" "))).when(k % 6 == 2, F.lit("0")).when(k % 6 == 3, F.lit("s.a.")).otherwise(y)
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.collect_list(raw).alias("dates"))
    return o.select("id", T.earliest_year(F.col("dates")).alias("year"))


def clean_period_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.epoch_names(table(spark, sf_dir, "epochs")).groupBy("lang", "name").agg(F.count("*").alias("n_epochs"))


def format_year_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "epochs").select("id", "begin_border", "end_border").distinct()
    return e.select("id", G.range_text().alias("range"), G.years_covered().cast("bigint").alias("years"), G.usable().alias("usable"))


def usable_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "epochs")
    u = e.where(G.usable()).select("id", F.explode(F.map_keys("names")).alias("lang")).distinct()
    return u.groupBy("lang").agg(F.count("*").alias("n"))


def representative_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.representative(G.latest(table(spark, sf_dir, "epochs")))


def norm_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = G.latest(table(spark, sf_dir, "epochs")).where(G.usable())
    n = G.epoch_names(e).join(e, "id")
    return n.select("lang", "name", G.norm_line(F.col("name"), G.link(F.col("id"), "http://example.org/period/")).alias("line")).distinct()


def temponym_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns and normalisations of rows voted usable in German; votes come from part keys."""
    k = F.col("p_partkey")
    t = table(spark, sf_dir, "part").select(
        F.col("p_name").alias("de_name"),
        F.when(k % 5 == 0, "U").when(k % 5 == 1, "no").when(k % 5 == 2, "").when(k % 5 == 3, F.lit(None).cast("string")).otherwise("Usable").alias("de_vote"),
        F.when(k % 2 == 0, "Uncertain").otherwise("x").alias("vote_general"),
        (k.cast("int") % 900 - 450).alias("b1"),
        k.cast("int").alias("key"),
    )
    v = G.voted(t, "de")
    return v.select(F.col("de_name").alias("pattern"), F.format_string("[%+05d, %+05d, %+05d, %+05d],['%s']", F.col("b1"), F.col("b1") + 5, F.col("b1") + 50, F.col("b1") + 60, F.col("key")).alias("norm"))


def merge_translations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts' names as originals; two candidate lists by line, of which the first is preferred."""
    k = F.col("p_partkey")
    pair = lambda lang, term: F.struct(F.lit(lang).alias("lang"), term.alias("term"))
    part = table(spark, sf_dir, "part").select(k.alias("line_no"), F.col("p_name").alias("original"))
    first = part.where("line_no % 3 <> 0").select("line_no", F.array(pair("de", F.concat(F.lit("d-"), "original")), pair("fr", F.col("original")), pair("de", F.lit("zwei"))).alias("pairs"))
    second = part.where("line_no % 2 = 0").select("line_no", F.array(pair("de", F.when(F.col("line_no") % 4 == 0, F.col("original")).otherwise(F.lit("anders")))).alias("pairs"))
    m = X.merged(part, {"vocab": first, "web": second}, "de")
    return m.select("line_no", "vocab", "web", X.preferred(["vocab", "web"]).alias("translation"))


def similar_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    left = p.select(F.col("p_partkey").alias("key"), F.col("p_name").alias("a"))
    right = p.select(F.col("p_partkey").alias("key"), F.when(F.col("p_partkey") % 3 == 0, F.reverse("p_name")).otherwise(F.concat(F.expr("substr(p_name, 1, length(p_name) - 2)"), F.lit("x"))).alias("b"))
    return X.similar(left, right, "key", "a", "b").select("key", "b", F.col("distance").cast("bigint").alias("distance"))


def term_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From suppliers over nations to regions, two steps at most."""
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("src"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("dst"))
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("src"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("dst"))
    back = n.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return X.walk(s.unionByName(n).unionByName(back), s.select(F.col("src").alias("start")), 2).withColumn("depth", F.col("depth").cast("bigint"))


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Epochs' names as labelled subjects."""
    e = table(spark, sf_dir, "epochs").select("id", F.explode("names").alias("lang", "l"))
    return e.select(F.col("id").alias("subject"), "lang", F.explode("l").alias("label")).where("label is not null").distinct()


def triple_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All labels of the subjects that carry an English name, for every English name, however frequent."""
    return X.labels_of(_labelled(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        desc_exclusion, url_pattern_select, url_pattern_union, hosts_urls, hosts_common, pattern_cooccurrence, record_projection, sample_records, earliest_year, clean_period_name,
        format_year_range, usable_by_language, representative_epoch, norm_lines, temponym_vote, merge_translations, similar_term, term_walk, triple_labels,
    )
}

_HOST = r"regexp_replace(regexp_extract(case when contains(url, '://') then url else 'http://' || url end, '^[a-z]+://([^/]+)', 1), '^www[0-9]*\.', '')"
_HOSTS = f"(select {_HOST} as host, count(distinct url) as n from (select unnest(urls).url as url from rec) where url is not null group by 1)"
_hit = lambda p: f"len(list_filter(urls, lambda u: coalesce(regexp_matches(u.url, '{p}'), false)))"
_NAME = lambda x: rf"trim(regexp_replace(regexp_replace({x}, ' \(.*\)', ''), ', .*$', ''))"
_NAMES = f"(select distinct lang, name, id from (select id, lang, {_NAME('raw')} as name from (select id, lang, unnest(l) as raw from (select id, unnest(map_keys(names)) as lang, unnest(map_values(names)) as l from epochs))) where name <> '')"
_Y = lambda b, f: f"case when {b}.{f} is null then 'None' else printf('%+05d', {b}.{f}) end"
_RANGE = "'[' || " + " || ', ' || ".join(f"case when {b} is null then 'None' else {_Y(b, 'earliest')} || ', ' || {_Y(b, 'latest')} end" for b in ("begin_border", "end_border")) + " || ']'"
_USABLE = "coalesce(begin_border.earliest is not null and begin_border.latest is not null and end_border.earliest is not null and end_border.latest is not null, false)"
_LATEST = "(select * exclude k from (select *, row_number() over (partition by id order by coalesce(epoch(modified_at)::bigint, 0) desc, coalesce(epoch(loaded_at)::bigint, 0) desc) as k from epochs where id is not null) where k = 1)"
ORACLES = {
    "desc_exclusion": f"with {SQL_RECORDS} select id, n as n_urls from (select id, len(list_filter(urls, lambda u: coalesce(u.\"desc\" not in ('Online', 'Contents'), true))) as n from rec) where n > 0",
    "url_pattern_select": f"with {SQL_RECORDS} select id, n as n_urls from (select id, {_hit(PATTERNS[0])} as n from rec) where n > 0",
    "url_pattern_union": f"with {SQL_RECORDS} " + " union all ".join(f"select id, '{p}' as pattern, n as n_urls from (select id, {_hit(p)} as n from rec) where n > 0" for p in PATTERNS),
    "hosts_urls": f"with {SQL_RECORDS} select host, n from {_HOSTS}",
    "hosts_common": f"with {SQL_RECORDS} select host, n from {_HOSTS} where n > 20",
    "pattern_cooccurrence": f"with {SQL_RECORDS} select count(*) filter (a) as n_first, count(*) filter (b) as n_second, count(*) filter (a and b) as n_both from (select {_hit(PATTERNS[0])} > 0 as a, {_hit(PATTERNS[1])} > 0 as b from rec)",
    "record_projection": f"with {SQL_RECORDS} select id, urls[1].url as first_url, array_to_string(list_transform(urls, lambda u: coalesce(u.url, '') || ' (' || coalesce(u.\"desc\", '') || ')'), '|') as links from rec",
    "sample_records": "select c_custkey as id, c_name as name from customer order by (c_custkey::bigint * 48271) % 2147483647, c_custkey limit 25",
    "earliest_year": """select o_custkey as id, case when bool_or(coalesce(y <> 0, false)) then min(y)::varchar else '' end as year from (select o_custkey, try_cast(trim(case o_orderkey % 6 when 0 then '[' || year(o_orderdate) || ']' when 1 then ' ' || year(o_orderdate) || ' '
        when 2 then '0' when 3 then 's.a.' else year(o_orderdate)::varchar end) as int) as y from orders) group by 1""",
    "clean_period_name": f"select lang, name, count(*) as n_epochs from {_NAMES} group by 1, 2",
    "format_year_range": f"select id, {_RANGE} as range, coalesce(end_border.latest - begin_border.earliest, 0)::bigint as years, {_USABLE} as usable from (select distinct id, begin_border, end_border from epochs)",
    "usable_by_language": f"select lang, count(*) as n from (select distinct id, unnest(map_keys(names)) as lang from epochs where {_USABLE}) group by 1",
    "norm_lines": rf"""with e as {_LATEST} select distinct lang, name, '"' || name || '","' || {_RANGE} || ',[' || chr(39) || 'http://example.org/period/' || id || chr(39) || ']"' as line
        from (select id, lang, {_NAME('raw')} as name from (select id, lang, unnest(l) as raw from (select id, unnest(map_keys(names)) as lang, unnest(map_values(names)) as l from e))) n join e using (id) where name <> '' and {_USABLE}""",
    "representative_epoch": rf"""with recursive e as {_LATEST},
        n as (select distinct lang, name, id from (select id, lang, {_NAME('raw')} as name from (select id, lang, unnest(l) as raw from (select id, unnest(map_keys(names)) as lang, unnest(map_values(names)) as l from e))) where name <> ''),
        p as (select id, list_transform(list_filter(coalesce(parent_ids, []), lambda x: x is not null), lambda x: regexp_replace(x, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')) as ps from e),
        w as (select lang, name, list_sort(list(id)) as ids, list_sort(list(id)) as stay, 1::bigint as k from n group by 1, 2
          union all select lang, name, ids, case when list_has_any(ps, list_filter(stay, lambda x: x <> ids[k])) then list_filter(stay, lambda x: x <> ids[k]) else stay end, k + 1 from w join p on p.id = w.ids[k])
        select lang, name, arg_min(id, (-coalesce(end_border.latest - begin_border.earliest, 0), id)) as id from (select lang, name, unnest(stay) as id from w where k > len(ids)) join e using (id) group by 1, 2""",
    "temponym_vote": """select de_name as pattern, printf('[%+05d, %+05d, %+05d, %+05d],[''%s'']', b1, b1 + 5, b1 + 50, b1 + 60, key::varchar) as norm from (
        select p_name as de_name, case p_partkey % 5 when 0 then 'U' when 1 then 'no' when 2 then '' when 3 then null else 'Usable' end as de_vote, case when p_partkey % 2 = 0 then 'Uncertain' else 'x' end as vote_general,
        (p_partkey % 900 - 450)::int as b1, p_partkey as key from part) where substr(de_vote, 1, 1) = 'U' or ((substr(de_vote, 1, 1) = '' or de_vote is null) and substr(vote_general, 1, 1) = 'U')""",
    "merge_translations": """select line_no, vocab, web, case when vocab <> '' then string_split(vocab, '||')[1] when web <> '' then web else original end as translation from (
        select p_partkey as line_no, p_name as original, case when p_partkey % 3 <> 0 then 'd-' || p_name || '||zwei' else '' end as vocab, case when p_partkey % 4 = 2 then 'anders' else '' end as web from part)""",
    "similar_term": """select key, b, levenshtein(a, b) as distance from (select p_partkey as key, p_name as a, case when p_partkey % 3 = 0 then reverse(p_name) else substr(p_name, 1, length(p_name) - 2) || 'x' end as b from part) where levenshtein(a, b) <= 3""",
    "term_walk": """with recursive e as (select 'n' || n_nationkey as src, 'r' || n_regionkey as dst from nation union all select 'r' || n_regionkey, 'n' || n_nationkey from nation union all select 's' || s_suppkey, 'n' || s_nationkey from supplier),
        w as (select 's' || s_suppkey as start, 's' || s_suppkey as node, 0 as depth from supplier union select start, dst, depth + 1 from w join e on node = src where depth < 2) select start, node, min(depth)::bigint as depth from w group by 1, 2""",
    "triple_labels": """with e as (select distinct subject, lang, label from (select id as subject, lang, unnest(l) as label from (select id, unnest(map_keys(names)) as lang, unnest(map_values(names)) as l from epochs)) where label is not null),
        r as (select distinct label as term from e where lang = 'en')
        select term, array_to_string(list_sort(list(distinct l)), '|') as labels from (select term, x.lang || ':' || x.label as l from r join e on e.label = term and e.lang = 'en' join e x on x.subject = e.subject) group by 1""",
}
