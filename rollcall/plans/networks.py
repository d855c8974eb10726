"""Graphs, statistics, audits, sources, sinks and windows over events."""

from __future__ import annotations

import sqlite3
import uuid

import pandas as pd
from pyspark.sql import functions as F

from rollcall import sources
from rollcall.functions.json_schema import failures
from rollcall.operators import graph, quality, stats
from rollcall.plans.data import SESSIONS, TAKING_PART, A, B
from rollcall.plans.registry import registry
from rollcall.session import shared_folder, small_batches
from rollcall.sources import sinks
from rollcall.sources.formats import register_formats
from rollcall.store import Store
from rollcall.streaming import events as ev
from rollcall.streaming import ingest

QUERIES, SQL, query = registry()

#: Suppliers met in the same order.
PAIRS = """m as (select distinct l_orderkey as g, l_suppkey as person from lineitem),
edges as (select a.person as a, b.person as b, count(distinct a.g) as weight from m a join m b on a.g = b.g and a.person < b.person group by 1, 2)"""


def _pairs(d):
    return graph.co_presence(d.lineitem.selectExpr("l_orderkey as g", "l_suppkey as person"), "g", "person")


SPINE = "spine as (select o_orderkey, o_custkey, c_nationkey, n_regionkey, o_orderpriority as series, cast(year(o_orderdate) as integer) as year from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey)"


def _spine(d):
    rows = d.orders.join(d.customer, F.col("o_custkey") == F.col("c_custkey")).join(d.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select("o_orderkey", "o_custkey", "c_nationkey", "n_regionkey", F.col("o_orderpriority").alias("series"), F.year("o_orderdate").alias("year"))


@query(f"""with {SPINE} select 'person' as kind, cast(o_custkey as varchar) as id, count(*) as weight from spine group by 2 union all select 'org', cast(c_nationkey as varchar), count(*) from spine group by 2
union all select 'theme', series, count(*) from spine group by 2""")
def g01_typed_nodes(d):
    return graph.typed_nodes(_spine(d), {"person": "o_custkey", "org": "c_nationkey", "theme": "series"})


@query(f"""with {SPINE}, e as (select 'person_theme' as edge_type, cast(o_custkey as varchar) as source, series as target, year from spine union all select 'org_theme', cast(c_nationkey as varchar), series, year from spine
union all select 'person_org', cast(o_custkey as varchar), cast(c_nationkey as varchar), year from spine) select *, count(*) as weight from e group by all""")
def g02_typed_edges(d):
    return graph.typed_edges(_spine(d), {"person_theme": ("o_custkey", "series"), "org_theme": ("c_nationkey", "series"), "person_org": ("o_custkey", "c_nationkey")}, ["year"])


@query(f"with {PAIRS} select * from edges")
def g03_clique_edges(d):
    return _pairs(d)


@query(f"""with {SESSIONS}, p as (select distinct session, person, year from sessions) select a.person as a, b.person as b, count(distinct a.session) as weight, string_agg(distinct cast(a.year as varchar), ',' order by cast(a.year as varchar)) as periods
from p a join p b on a.session = b.session and a.person < b.person group by 1, 2""")
def g04_session_links(d):
    return graph.co_presence(d.sessions.withColumn("year", F.col("year").cast("string")), "session", "person", "year")


@query(f"with {PAIRS} select * from edges where (select count(*) from edges where weight >= 2) < 50 or weight >= 2")
def g05_pruned(d):
    return graph.pruned(_pairs(d), 2, 50)


@query(f"""with {PAIRS}, e as (select a as node, weight from edges union all select b, weight from edges), t as (select node from e group by node order by sum(weight) desc, node limit 40) select * from edges where a in (select node from t) and b in (select node from t)""")
def g06_top_subgraph(d):
    return graph.top_subgraph(_pairs(d), 40)


@query("""with m as (select distinct user_id as person, cast(ts as date) as g, event_type from events where event_type = 'purchase') select a.person as a, b.person as b, count(distinct a.g) as weight from m a join m b on a.g = b.g and a.person < b.person group by 1, 2""")
def g07_projection(d):
    rows = d.events.where("event_type = 'purchase'").select(F.to_date("ts").alias("g"), F.col("user_id").alias("person"))
    return graph.co_presence(rows, "g", "person")


@query()
def g08_betweenness(d):
    return graph.betweenness(_pairs(d))


@query(f"with {PAIRS}, e as (select a as node, b as other, weight from edges union all select b, a, weight from edges) select node, count(distinct other) as degree, cast(sum(weight) as bigint) as strength from e group by 1")
def g09_degrees(d):
    return graph.degrees(_pairs(d))


@query(f"""with {TAKING_PART} select person, count(case when series = '{A}' then 1 end) as n_a, count(case when series = '{B}' then 1 end) as n_b,
round((count(case when series = '{A}' then 1 end) - count(case when series = '{B}' then 1 end)) / (count(case when series = '{A}' then 1 end) + count(case when series = '{B}' then 1 end)), 4) as balance
from taking_part where series in ('{A}', '{B}') group by person""")
def g09_balance(d):
    return graph.balance(d.taking_part, "person", "series", A, B)


@query(f"""with {PAIRS}, b as (select s_suppkey as p, case when s_suppkey % 6 <> 0 then cast(1930 + s_suppkey % 60 as integer) end as y from supplier), x as (select a, b, weight, p.y as ya, q.y as yb from edges left join b p on a = p.p left join b q on edges.b = q.p)
select case when ya is not null and yb is not null and yb < ya then b else a end as elder, case when ya is not null and yb is not null and yb < ya then a else b end as younger, weight,
case when ya is not null and yb is not null then 'age_gap' else 'joint_work' end as basis from x where case when ya is not null and yb is not null then abs(ya - yb) >= 15 and weight >= 2 else weight >= 3 end""")
def g10_lineage(d):
    people = d.supplier.select("s_suppkey", F.when(F.col("s_suppkey") % 6 != 0, (1930 + F.col("s_suppkey") % 60).cast("int")).alias("born"))
    return graph.lineage(_pairs(d), people, "s_suppkey", "born")


TEACHERS = "t as (select s_suppkey as teacher, case when s_suppkey % 17 = 0 then s_suppkey else s_suppkey % 9 + 1 end as pupil, case when s_suppkey % 5 = 0 then 'guess' else 'advisor' end as kind, cast(case when s_suppkey % 7 = 0 then 1650 else 1900 + s_suppkey % 90 end as integer) as year from supplier)"


def _teachers(d):
    return d.supplier.selectExpr("s_suppkey as teacher", "if(s_suppkey % 17 = 0, s_suppkey, s_suppkey % 9 + 1) as pupil", "if(s_suppkey % 5 = 0, 'guess', 'advisor') as kind", "cast(if(s_suppkey % 7 = 0, 1650, 1900 + s_suppkey % 90) as int) as year")


@query(f"""with {TEACHERS} select *, array_to_string(list_filter([case when teacher = pupil then 'self_loop' end, case when kind not in ('advisor', 'student') then 'unknown_kind' end, case when year not between 1700 and 2100 then 'bad_year' end], lambda x: x is not null), ',') as problems from t""")
def g11_checked_edges(d):
    return graph.checked_edges(_teachers(d), "teacher", "pupil", "kind", ["advisor", "student"], "year")


@query(f"with {TEACHERS} select pupil, string_agg(distinct cast(teacher as varchar), ',' order by cast(teacher as varchar)) as targets, count(distinct teacher) as n from t group by 1")
def g11_adjacency(d):
    return graph.adjacency(_teachers(d), "pupil", "teacher")


@query("""select 'customer/' || c_custkey as s, p, o, kind from customer, lateral (select unnest(['foaf:name', 'org:memberOf', 'ex:segment']) as p, unnest([c_name, 'nation/' || c_nationkey, case when c_custkey % 3 > 0 then c_mktsegment end]) as o, unnest(['string', 'iri', 'lang:en']) as kind) where o is not null""")
def g12_triples(d):
    props = {"foaf:name": (F.col("c_name"), "string"), "org:memberOf": (F.concat(F.lit("nation/"), "c_nationkey"), "iri"), "ex:segment": (F.when(F.col("c_custkey") % 3 > 0, F.col("c_mktsegment")), "lang:en")}
    return graph.triples(d.customer, F.concat(F.lit("customer/"), "c_custkey"), props)


@query("select s_suppkey as source, coalesce(lower(n_name), 'unknown') as slug, case when s_suppkey % 4 = 0 then 1.0 else s_acctbal end as weight from supplier left join nation on s_nationkey = n_nationkey and n_nationkey % 2 = 0")
def g13_graph_lookup(d):
    n = d.nation.where("n_nationkey % 2 = 0")
    rows = d.supplier.join(n, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    weight = F.coalesce(F.when(F.col("s_suppkey") % 4 != 0, F.col("s_acctbal").cast("string")).otherwise("").try_cast("double"), F.lit(1.0))
    return rows.select(F.col("s_suppkey").alias("source"), F.coalesce(F.lower("n_name"), F.lit("unknown")).alias("slug"), weight.alias("weight"))


@query("""select s.n_name as origin, c.n_name as destination, count(*) as n from lineitem join orders on l_orderkey = o_orderkey join supplier on l_suppkey = s_suppkey join customer on o_custkey = c_custkey join nation s on s_nationkey = s.n_nationkey join nation c on c_nationkey = c.n_nationkey where s.n_nationkey <> c.n_nationkey group by 1, 2""")
def g14_flows(d):
    s = d.supplier.join(d.nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("origin"))
    c = d.customer.join(d.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("destination"))
    rows = d.lineitem.join(d.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    return rows.where("origin <> destination").groupBy("origin", "destination").agg(F.count("*").alias("n"))


CHI = """c as (select o_orderpriority as r, o_orderstatus as k, count(*) as o from orders group by 1, 2), r as (select r, sum(o) as tr from c group by 1), k as (select k, sum(o) as tk from c group by 1), n as (select sum(o) as n from c),
x as (select sum(pow(coalesce(o, 0) - tr * tk / n, 2) / (tr * tk / n)) as x, any_value(n) as n from r cross join k cross join n left join c using (r, k))"""


@query(f"with {CHI} select round(x, 4) as chi2, cast(8 as integer) as dof, cast(n as bigint) as n, round(sqrt(x / (n * 2)), 4) as cramers_v from x")
def x01_chi_square(d):
    return stats.chi_square(d.orders, "o_orderpriority", "o_orderstatus").drop("p")


@query()
def x01_chi_square_p(d):
    return stats.chi_square(d.labels, "quality", "toxic")


@query("""with n as (select count(case when quality = 1 and toxic = 1 then 1 end) as a, count(case when quality = 1 and toxic = 0 then 1 end) as b, count(case when quality = 0 and toxic = 1 then 1 end) as c, count(case when quality = 0 and toxic = 0 then 1 end) as d from labels),
k as (select unnest(range(greatest(0, a + b + a + c - (a + b + c + d)), least(a + b, a + c) + 1)) as k, a + b as r, a + c as l, a + b + c + d as n from n),
w as (select k, lgamma(r + 1.0) - lgamma(k + 1.0) - lgamma(r - k + 1.0) + lgamma(n - r + 1.0) - lgamma(l - k + 1.0) - lgamma(n - r - l + k + 1.0) - lgamma(n + 1.0) + lgamma(l + 1.0) + lgamma(n - l + 1.0) as x from k)
select a, b, c, d, round(least(1.0, (select sum(exp(x)) from w where x <= (select x from w where k = a) + 1e-7)), 6) as p from n""")
def x02_fisher(d):
    rows = d.labels.select((F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    return stats.fisher(rows, "good", "toxic").withColumn("p", F.round("p", 6))


@query("""with v as (select c_acctbal as x, c_nationkey as y from customer), r as (select rank() over (order by x) + (count(*) over (partition by x) - 1) / 2.0 as rx, rank() over (order by y) + (count(*) over (partition by y) - 1) / 2.0 as ry from v) select count(*) as n, round(corr(rx, ry), 6) as rho from r""")
def x03_spearman(d):
    return stats.spearman(d.customer, "c_acctbal", "c_nationkey")


@query("""with r as (select p_brand as g, rank() over (order by p_size) + (count(*) over (partition by p_size) - 1) / 2.0 as r from part), s as (select g, sum(r) as s, count(*) as k from r group by 1), n as (select cast(count(*) as double) as n from part),
t as (select sum(pow(t, 3) - t) as t from (select count(*) as t from part group by p_size)), q as (select sum(s * s / k) as q, count(*) as groups from s)
select round((12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - t / (n * n * n - n)), 4) as h, groups, cast(n as bigint) as n from q, n, t""")
def x04_kruskal(d):
    return stats.kruskal(d.part, "p_brand", "p_size").drop("p")


@query()
def x05_permutation(d):
    return stats.overlap_permutation(d.taking_part, "person", "series", A, B)


@query()
def x06_bootstrap(d):
    return stats.bootstrap_mean(d.orders, "o_orderpriority", "o_totalprice")


@query()
def x06_bootstrap_difference(d):
    return stats.bootstrap_difference(d.orders, "o_orderpriority", "o_totalprice", A, B)


KM = """t as (select c_mktsegment as grp, max(year(o_orderdate)) - min(year(o_orderdate)) as t, max(o_orderdate) < timestamp '2001-01-01' as e from orders join customer on o_custkey = c_custkey group by o_custkey, c_mktsegment)"""


def _lives(d):
    rows = d.orders.join(d.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy("o_custkey", F.col("c_mktsegment").alias("grp"))
    return rows.agg((F.max(F.year("o_orderdate")) - F.min(F.year("o_orderdate"))).alias("t"), (F.max("o_orderdate") < F.lit("2001-01-01").cast("timestamp")).alias("e"))


@query(f"""with {KM}, c as (select grp, t, count(*) as k, sum(case when e then 1 else 0 end) as d from t group by 1, 2), r as (select *, sum(k) over (partition by grp order by t desc) as n from c),
s as (select *, list(1.0 - d / n) over (partition by grp order by t) as f, sum(case when n > d then d / (n * (n - d)) else 0.0 end) over (partition by grp order by t) as v from r)
select grp, cast(t as integer) as t, cast(n as bigint) as at_risk, cast(d as bigint) as events, round(list_product(f), 6) as survival, round(list_product(f) * sqrt(v), 6) as se from s where d > 0""")
def x07_kaplan_meier(d):
    return stats.kaplan_meier(_lives(d), "grp", "t", "e").drop("_survival")


@query(f"""with {KM}, c as (select grp, t, count(*) as k, sum(case when e then 1 else 0 end) as d from t group by 1, 2), r as (select *, sum(k) over (partition by grp order by t desc) as n from c),
s as (select *, list_product(list(1.0 - d / n) over (partition by grp order by t)) as s from r) select grp, cast(min(case when s <= 0.5 + 1e-12 and d > 0 then t end) as integer) as median_time from s group by grp having bool_or(d > 0)""")
def x07_median_survival(d):
    return stats.median_survival(stats.kaplan_meier(_lives(d), "grp", "t", "e"), "grp", "t")


@query(f"""with {KM}, c as (select t, count(case when grp = 'BUILDING' then 1 end) as ka, count(*) as k, sum(case when e and grp = 'BUILDING' then 1 else 0 end) as da, sum(case when e then 1 else 0 end) as d from t group by 1),
r as (select *, sum(k) over (order by t desc) as n, sum(ka) over (order by t desc) as na from c), s as (select sum(da) as o, sum(d * na / n) as e, sum(case when n > 1 then d * na / n * (1 - na / n) * (n - d) / (n - 1) else 0 end) as v from r where d > 0)
select cast(o as bigint) as observed, round(e, 4) as expected, round((o - e) * (o - e) / v, 4) as chi2 from s""")
def x08_logrank(d):
    return stats.logrank(_lives(d), "grp", "BUILDING", "t", "e").drop("p")


@query("""with t as (select year(o_orderdate) as y, cast(count(case when o_orderpriority = '1-URGENT' and o_totalprice > 150000 then 1 end) as double) as a, count(case when o_orderpriority = '1-URGENT' and o_totalprice <= 150000 then 1 end) as b,
count(case when o_orderpriority <> '1-URGENT' and o_totalprice > 150000 then 1 end) as c, count(case when o_orderpriority <> '1-URGENT' and o_totalprice <= 150000 then 1 end) as d from orders group by 1), n as (select *, a + b + c + d as n from t),
s as (select count(*) as strata, sum(a - (a + b) * (a + c) / n) as g, sum((a + b) * (c + d) * (a + c) * (b + d) / (n * n * (n - 1))) as v, sum(a * d / n) as r, sum(b * c / n) as q from n where n > 1)
select strata, round(pow(greatest(0, abs(g) - 0.5), 2) / v, 4) as chi2, round(r / q, 4) as odds_ratio from s""")
def x09_mantel_haenszel(d):
    rows = d.orders.select(F.year("o_orderdate").alias("y"), (F.col("o_orderpriority") == "1-URGENT").alias("urgent"), (F.col("o_totalprice") > 150000).alias("large"))
    return stats.mantel_haenszel(rows, "y", "urgent", "large").drop("p")


@query("select o_orderstatus, count(*) as n, round(median(o_totalprice), 2) as median, round(avg(o_totalprice), 2) as mean from orders group by 1")
def x10_medians(d):
    return d.orders.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.median("o_totalprice"), 2).alias("median"), F.round(F.avg("o_totalprice"), 2).alias("mean"))


@query("""select 'orders' as id, (select count(distinct l_orderkey) from lineitem) as expected, (select count(*) from orders) as actual, case when (select count(distinct l_orderkey) from lineitem) = (select count(*) from orders) then 'pass' else 'fail' end as status
union all select 'nations', (select count(*) from nation), 25, case when (select count(*) from nation) = 25 then 'pass' else 'fail' end""")
def q01_reconcile(d):
    return quality.reconcile([("orders", d.lineitem.select("l_orderkey").distinct(), d.orders), ("nations", d.nation, d.spark.range(25))])


@query("select 'lineitem' as child, count(*) as n from lineitem where l_orderkey not in (select o_orderkey from orders) union all select 'labels', count(*) from labels where doc_id not in (select doc_id from documents)")
def q02_dangling(d):
    from rollcall.operators.joins import unmatched

    a = unmatched(d.lineitem, d.orders, "l_orderkey", "o_orderkey").agg(F.count("*").alias("n")).select(F.lit("lineitem").alias("child"), "n")
    return a.unionByName(unmatched(d.labels, d.documents, "doc_id", "doc_id").agg(F.count("*").alias("n")).select(F.lit("labels").alias("child"), "n"))


@query("select substr(c_name, 1, 17) as ext, count(distinct c_custkey) as n from customer group by 1 having count(distinct c_custkey) > 1")
def q03_duplicate_ids(d):
    return quality.duplicated(d.customer.select("c_custkey", F.substring("c_name", 1, 17).alias("ext")), ["ext"], "c_custkey")


@query("select o_orderpriority as value, count(*) as n from orders where o_orderpriority not in ('1-URGENT', '2-HIGH', '5-LOW') group by 1")
def q04_domain(d):
    return quality.outside(d.orders, "o_orderpriority", ["1-URGENT", "2-HIGH", "5-LOW"])


@query("""select page_id, 'url' as rule, url as value from pages where not regexp_matches(url, '^https?://[a-z0-9.-]+/[0-9a-f]*1') union all select page_id, 'html', html from pages where not regexp_matches(html, '^<')""")
def q05_rules(d):
    return quality.rule_failures(d.pages, "page_id", {"url": ("url", "^https?://[a-z0-9.-]+/[0-9a-f]*1"), "html": ("html", "^<")})


#: What a turn of a conversation has to look like, once it is a document.
TURN = {
    "type": "object", "required": ["conv_id", "message"], "additionalProperties": False,
    "properties": {"conv_id": {"type": "integer", "minimum": 2}, "turn": {"$ref": "#/definitions/turn"}, "message": {
        "type": "object", "patternProperties": {"^role$": {"enum": ["user", "assistant"]}, "^t(ext|ags)$": {"anyOf": [{"type": "string", "maxLength": 400}, {"type": "array", "items": {"pattern": "^[A-Za-z]+$"}}]}}}},
    "definitions": {"turn": {"type": "integer", "maximum": 5}}}


@query("""with t as (select conv_id, turn, role, text, string_split(text, ' ')[1:3] as tags from conversations)
select conv_id, turn, '/conv_id' as path, 'minimum' as rule from t where conv_id < 2
union all select conv_id, turn, '/turn', 'maximum' from t where turn > 5
union all select conv_id, turn, '/message/role', 'enum' from t where role not in ('user', 'assistant')
union all select conv_id, turn, '/message/text', 'anyOf' from t where length(text) > 400
union all select conv_id, turn, '/message/tags', 'anyOf' from t where len(list_filter(tags, lambda x: not regexp_matches(x, '^[A-Za-z]+$'))) > 0
union all select conv_id, turn, '/start', 'additionalProperties' from t where turn = 0""")
def q05_json_schema(d):
    message = F.struct("role", "text", F.slice(F.split("text", " "), 1, 3).alias("tags"))
    document = F.to_json(F.struct("conv_id", "turn", message.alias("message"), F.when(F.col("turn") == 0, True).alias("start")))
    return d.conversations.select("conv_id", "turn", F.explode(failures(TURN, document)).alias("x")).select("conv_id", "turn", "x.path", "x.rule")


@query("""with c as (select 'empty_text' as id, 'error' as severity, (select count(*) from documents where trim(text) = '') as count union all select 'copies', 'warning', (select count(*) from (select text from documents group by 1 having count(*) > 1)) union all select 'unlabelled', 'info', (select count(*) from documents where doc_id not in (select doc_id from labels)))
select *, case when count = 0 then 'pass' else 'fail' end as status from c""")
def q06_report(d):
    from rollcall.operators.joins import unmatched

    return quality.report([quality.check("empty_text", "error", d.documents.where("trim(text) = ''")), quality.check("copies", "warning", quality.duplicated(d.documents, ["text"])),
                           quality.check("unlabelled", "info", unmatched(d.documents, d.labels, "doc_id", "doc_id"))])


@query("""with b as (select c_custkey as k, c_mktsegment as s from customer where c_custkey % 7 <> 0), a as (select c_custkey as k, case when c_custkey % 11 = 0 then 'MOVED' else c_mktsegment end as s from customer where c_custkey % 5 <> 0)
select case when b.k is null then 'added' when a.k is null then 'removed' when b.s <> a.s then 'changed' else 'same' end as status, count(*) as n from b full outer join a on a.k = b.k group by 1""")
def q07_manifest_counts(d):
    from rollcall.operators.joins import snapshot_diff

    b = d.customer.where("c_custkey % 7 <> 0").selectExpr("c_custkey as k", "c_mktsegment as s")
    a = d.customer.where("c_custkey % 5 <> 0").selectExpr("c_custkey as k", "if(c_custkey % 11 = 0, 'MOVED', c_mktsegment) as s")
    return snapshot_diff(b, a, "k", ["s"]).groupBy("status").agg(F.count("*").alias("n"))


@query("""with r as (select doc_id, array_to_string(list_filter([case when length(text) > 5000 then 'long' end, case when contains(text, '###') then 'junk' end, case when regexp_matches(text, '[0-9]{12}') then 'number' end], lambda x: x is not null), ',') as reasons from documents) select * from r where reasons <> ''""")
def q08_anomalies(d):
    t = F.col("text")
    return quality.anomalies(d.documents, "doc_id", {"long": F.char_length(t) > 5000, "junk": t.contains("###"), "number": t.rlike("[0-9]{12}")})


@query("""with b as (select o_custkey, o_orderpriority, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderpriority desc) as n from orders) select c_custkey, o_orderpriority as candidate from customer left join b on o_custkey = c_custkey and n = 1 where c_acctbal < 0""")
def q09_gaps(d):
    return quality.gaps(d.customer.where("c_acctbal < 0").select("c_custkey"), "c_custkey", d.orders, "o_custkey", "o_orderpriority", "o_totalprice")


@query("""with t as (select p_brand, round(avg(p_size), 1) as expected, count(*) as n from part group by 1), x as (select p_brand, expected, 'mean ' || (case when n % 2 = 0 then expected else expected + 1 end) || ' of ' || n as text from t)
select p_brand, expected, len(regexp_extract_all(text, '[0-9]+(?:\\.[0-9]+)?')) as numbers, len(list_filter(list_transform(regexp_extract_all(text, '[0-9]+(?:\\.[0-9]+)?'), lambda y: cast(y as double)), lambda z: abs(z - expected) <= 0.05)) > 0 as agrees from x""")
def q10_drift(d):
    t = d.part.groupBy("p_brand").agg(F.round(F.avg("p_size"), 1).alias("expected"), F.count("*").alias("n"))
    text = F.concat(F.lit("mean "), F.when(F.col("n") % 2 == 0, F.col("expected")).otherwise(F.col("expected") + 1), F.lit(" of "), F.col("n"))
    return quality.drift(t.withColumn("text", text), "p_brand", "text", "expected")


@query("select case when grouping(lang) = 1 then 'ALL' else lang end as lang, count(*) as n, count(quality) as matched, count(*) - count(quality) as unmatched, round(100.0 * count(quality) / count(*), 1) as matched_pct from documents left join labels using (doc_id) group by rollup (lang)")
def q11_match_rates(d):
    return quality.match_rates(d.documents.join(d.labels, "doc_id", "left"), "lang", F.col("quality").isNotNull())


@query("""select 'customer' as entity_type, cast(c_custkey as varchar) as entity_id, attribute, value, confidence from customer, lateral (select unnest(['c_name', 'c_mktsegment']) as attribute, unnest([c_name, c_mktsegment]) as value, unnest([0.9, 0.5]::double[]) as confidence)""")
def q12_assertions(d):
    return quality.assertions(d.customer, "customer", "c_custkey", {"c_name": 0.9, "c_mktsegment": 0.5})


@query("select 'customer' as entity_type, cast(c_custkey as varchar) as entity_id, c_name, c_mktsegment from customer")
def q12_widened(d):
    return quality.widened(q12_facts(d), ["c_name", "c_mktsegment"])


def q12_facts(d):
    return quality.assertions(d.customer, "customer", "c_custkey", {"c_name": 0.9, "c_mktsegment": 0.5})


@query("""with o as (select c_custkey as k, c_name as name, c_mktsegment as seg from customer where c_custkey % 6 <> 0), n as (select c_custkey as k, case when c_custkey % 4 = 0 then '' else c_name end as name, case when c_custkey % 8 = 0 then 'NEW' when c_custkey % 3 = 0 then null else c_mktsegment end as seg from customer where c_custkey % 2 = 0)
select coalesce(o.k, n.k) as k, coalesce(nullif(trim(n.name), ''), o.name) as name, coalesce(n.seg, o.seg) as seg, case when o.k is null then 'added' when n.k is null then 'kept' when (trim(n.name) <> '' and n.name is distinct from o.name) or (n.seg is not null and n.seg is distinct from o.seg) then 'updated' else 'same' end as action from o full outer join n on o.k = n.k""")
def q13_patched(d):
    o = d.customer.where("c_custkey % 6 <> 0").selectExpr("c_custkey as k", "c_name as name", "c_mktsegment as seg")
    n = d.customer.where("c_custkey % 2 = 0").selectExpr("c_custkey as k", "if(c_custkey % 4 = 0, '', c_name) as name", "case when c_custkey % 8 = 0 then 'NEW' when c_custkey % 3 = 0 then null else c_mktsegment end as seg")
    return quality.patched(o, n, "k", ["name", "seg"])


BLOCKED = "regexp_replace(regexp_replace(html, '(?i)</?(br|div|h1|h2|h3|h4|h5|h6|li|ol|p|td|tr|ul)([ \\t\\r\\n][^>]*)?/?>', chr(1), 'g'), '<[^>]*>', '', 'g')"
UNESCAPED = f"replace(replace(replace(replace(replace(replace({BLOCKED}, '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#39;', chr(39)), '&nbsp;', chr(160)), '&amp;', '&')"
PAGE_TEXT = f"select page_id, regexp_replace(regexp_replace(regexp_replace({UNESCAPED}, '^' || chr(1) || '+', ''), chr(10) || chr(1) || '+', chr(10), 'g'), chr(1) || '+', chr(10), 'g') as text from pages"


@query()
def s02_html_text(d):
    small_batches(d.spark)
    return d.pages.select("page_id", sources.html_text("html").alias("text"))


@query(PAGE_TEXT)
def s02_html_text_native(d):
    return d.pages.select("page_id", sources.html_text_plain(F.col("html")).alias("text"))


@query("select doc_id, case when doc_id % 3 = 0 then 'html' when doc_id % 3 = 1 then 'pdf' end as text, case when doc_id % 3 = 0 then 0 when doc_id % 3 = 1 then 1 end as source from documents")
def s04_source_precedence(d):
    a = d.documents.select("doc_id", F.when(F.col("doc_id") % 3 == 0, "html").otherwise(" ").alias("text"))
    b = d.documents.where("doc_id % 3 <= 1").select("doc_id", F.lit("pdf").alias("text"))
    return sources.preferred("doc_id", a, b)


@query("select page_id, '2021-05-' || lpad(cast(1 + page_id % 28 as varchar), 2, '0') as updated from pages")
def s05_updated_on(d):
    return d.pages.select("page_id", sources.updated_on(F.concat(F.lit("Page (Last updated: "), 1 + F.col("page_id") % 28, F.lit(".5.2021)"))).cast("string").alias("updated"))


def _folder(d, name: str) -> str:
    """A new folder where all machines can write and read."""
    return f"{shared_folder(d.spark)}/{name}-{uuid.uuid4().hex}"


def _read(d, name: str, schema: str, path: str, **options: str):
    register_formats(d.spark)
    return d.spark.read.format(name).schema(schema).options(**options).load(path)


def _written(d, texts, name: str) -> str:
    """The folder to which one text column is written, over several files."""
    path = _folder(d, name)
    texts.repartition(6).write.text(path)
    return path


def _lines(of, order: str, line):
    """A group's lines in one text. Groups are some twenty rows by construction."""
    return of.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))), lambda x: x["l"]), "\n").alias("lines"))


@query("select c_custkey, c_name, c_acctbal from customer")
def s01_markdown_csv(d):
    """Seed tables inside Markdown pages, twenty rows a page, another table beside them."""
    line = F.concat_ws(",", F.col("c_acctbal").cast("string"), F.concat(F.lit('"'), "c_name", F.lit('"')), F.col("c_custkey").cast("string"))
    pages = _lines(d.customer.groupBy(F.floor(F.col("c_custkey") / 20).alias("page")), "c_custkey", line)
    text = F.concat(F.lit("# Seeds\n\n### people\nBy name.\n\n```csv\nc_acctbal,c_name,c_custkey\n"), "lines", F.lit("\n```\n\n### venues\n```csv\nid\n7\n```\n"))
    return _read(d, "markdown_csv", "c_custkey long, c_name string, c_acctbal double", _written(d, pages.select(text.alias("value")), "markdown"), block="people")


@query("select page_id, url from pages")
def s08_wrapped_json(d):
    """Arrays that scripts assign to names, several in a file; the pages' HTML is not asked for."""
    each = _lines(d.pages.groupBy(F.floor(F.col("page_id") / 20).alias("part")), "page_id", F.to_json(F.struct("page_id", "url", "html")))
    text = F.concat(F.lit("const PART_"), F.col("part").cast("string"), F.lit(" = ["), F.replace("lines", F.lit("\n"), F.lit(",")), F.lit("];"))
    return _read(d, "wrapped_json", "page_id long, url string", _written(d, each.select(text.alias("value")), "scripts"))


@query("""select conv_id, turn, role, null as bad from conversations union all select null, null, null, '{bad ' || conv_id from conversations where turn = 0""")
def s09_fenced_jsonl(d):
    """Records in fenced blocks, with remarks and lines that are no JSON."""
    good = F.to_json(F.struct("role", "conv_id", "turn", "text"))
    line = F.when(F.col("turn") == 0, F.concat(good, F.lit("\n{bad "), F.col("conv_id").cast("string"))).otherwise(F.concat(F.lit("// note\n"), good))
    each = _lines(d.conversations.groupBy(F.floor(F.col("conv_id") / 20).alias("part"), "turn"), "conv_id", line)
    text = F.concat(F.lit("intro {\n```jsonl\n"), "lines", F.lit("\n\n```\nend"))
    return _read(d, "fenced_jsonl", "conv_id long, turn long, role string, _bad string", _written(d, each.select(text.alias("value")), "notes")).withColumnRenamed("_bad", "bad")


@query("select c_custkey as id, c_name as name from customer where c_nationkey > 3")
def s11_sqlite(d):
    """Databases of a hundred rows, written by tasks and read by tasks; one column is not asked for."""

    def packed(part: pd.DataFrame) -> pd.DataFrame:
        db = sqlite3.connect(":memory:")
        db.execute("create table people (id integer, balance real, name text)")
        db.executemany("insert into people values (?, ?, ?)", list(zip(part["c_custkey"].tolist(), part["c_acctbal"].tolist(), part["c_name"])))
        db.commit()
        return pd.DataFrame({"name": [f"{part['part'].iloc[0]}.db"], "content": [db.serialize()]})

    rows = d.customer.where("c_nationkey > 3").withColumn("part", F.floor(F.col("c_custkey") / 100))
    path = _folder(d, "databases")
    sinks.write_files(rows.groupBy("part").applyInPandas(packed, "name string, content binary"), path)
    return _read(d, "sqlite", "id long, name string", path, table="people")


@query("select s.lang, s.name, count(doc_id) as n from (values ('en', 'English'), ('fr', 'French'), ('la', 'Latin')) s(lang, name) left join documents using (lang) group by 1, 2")
def s14_seed_rows(d):
    """Seed rows that name what a table has, or lacks."""
    seeds = sources.values(d.spark, [("en", "English"), ("fr", "French"), ("la", "Latin")], "lang string, name string")
    return seeds.join(d.documents.groupBy("lang").agg(F.count("doc_id").alias("n")), "lang", "left").select("lang", "name", F.coalesce("n", F.lit(0)).alias("n"))


@query("select doc_id, case when doc_id % 10 = 0 then upper(lang) else lang end as lang, n_chars from documents")
def k03_stream_upsert(d):
    """All documents arrive as a stream, some again with a correction; a replayed run adds nothing."""
    root, store = _folder(d, "ingest"), Store(d.spark, _folder(d, "tables"))
    docs = d.documents.select("doc_id", "lang", "n_chars")
    docs.repartition(3).write.parquet(f"{root}/a")
    docs.where("doc_id % 10 = 0").withColumn("lang", F.upper("lang")).write.parquet(f"{root}/b")
    table = ingest.Ledger(store, "documents", ["doc_id"])
    for source in ("a", "b", "b"):
        stream = d.spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 2).parquet(f"{root}/{source}")
        table.upsert(stream, source, f"{root}/checkpoint-{source}").awaitTermination()
    return table.current()


@query("select c_custkey, c_name, c_acctbal from customer")
def k01_sorted_csv(d):
    """Written in order with a header, and read again by schema."""
    path = _folder(d, "csv")
    sinks.sorted_csv(d.customer.select("c_custkey", "c_name", "c_acctbal"), path, ["c_custkey"])
    return sources.csv(d.spark, path, "c_custkey long, c_name string, c_acctbal double")


@query("select c_custkey, case when c_custkey % 3 > 0 then c_name end as c_name from customer where c_custkey % 4 > 0")
def s07_commented_csv(d):
    """Comment lines are left out, short rows are filled, a byte-order mark is no part of the header."""
    path = _folder(d, "notes")
    k = F.col("c_custkey")
    line = F.when(k % 4 == 0, F.concat(F.lit("# "), "c_name")).when(k % 3 == 0, k.cast("string")).otherwise(F.concat_ws(",", k, "c_name"))
    head = d.spark.createDataFrame([("\ufeffc_custkey,c_name",)], "value string")
    head.coalesce(1).write.text(f"{path}/part=0")
    d.customer.select(F.concat_ws("\n", F.lit("c_custkey,c_name"), line).alias("value")).write.text(f"{path}/part=1")
    return sources.csv(d.spark, path, "c_custkey long, c_name string", "#").where("c_custkey is not null").select("c_custkey", "c_name")


@query("select n_nationkey as id, n_name as name from nation where n_nationkey % 3 > 0")
def s10_json_import(d):
    """Arrays of a folder, an element twice, some known already."""
    path = _folder(d, "json")
    each = F.to_json(F.array(*[F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))] * 2))
    d.nation.select("n_nationkey", each.alias("value")).write.partitionBy("n_nationkey").text(path)
    known = d.nation.where("n_nationkey % 3 = 0").selectExpr("n_nationkey as id")
    return sources.json_new(d.spark, path, "id int, name string", "id", known).select("id", "name")


@query("select p_partkey, unnest(list_filter([case when contains(p_type, 'STEEL') or contains(p_type, 'TIN') then 'metal' end, case when contains(p_type, 'SMALL') then 'small' end, case when regexp_matches(p_brand, '1$') then 'first' end], lambda x: x is not null)) as label from part")
def s15_rule_table(d):
    """Rules as rows: label and pattern."""
    from rollcall.operators.joins import match_rules

    rules = [tuple(r) for r in sources.values(d.spark, [("metal", "STEEL"), ("metal", "TIN"), ("small", "SMALL"), ("first", "1 x$")], "label string, pattern string").collect()]  # the rule table
    return match_rules(d.part.withColumn("_text", F.concat("p_type", F.lit(" "), "p_brand", F.lit(" x"))), "_text", rules).select("p_partkey", "label")


@query("select o_orderkey, o_custkey, cast(year(o_orderdate) as integer) as year from orders where year(o_orderdate) in (1996, 1999)")
def k02_split_by_year(d):
    """A folder a year; two of them read again equal their slice of the whole."""
    path = _folder(d, "years")
    sinks.split_json(d.orders.select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("year")), path, "year")
    return d.spark.read.schema("o_orderkey long, o_custkey long, year int").json(path).where("year in (1996, 1999)")


@query("""with r as (select n_nationkey, coalesce(n_name, '') as n, count(c_custkey) as k from nation left join customer on c_nationkey = n_nationkey group by 1, 2)
select 0::bigint as place, '| name | customers |' as line union all select 1, '| --- | --- |' union all select 1 + row_number() over (order by n), '| ' || n || ' | ' || k || ' |' from r""")
def k04_markdown(d):
    n = d.nation.join(d.customer, F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy(F.col("n_name").alias("name")).agg(F.count("c_custkey").alias("customers"))
    return sinks.markdown_lines(n, ["name"])


@query("""with t as (select n_regionkey, string_agg(n_name || chr(10), '' order by n_name) as t from nation group by 1) select cast(length(t) as bigint) as size, sha256(t) as sha256 from t""")
def k10_manifest(d):
    """A text file a region; size and digest of each."""
    path = _folder(d, "files")
    lines = d.nation.groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_name")), "\n").alias("value"))
    lines.write.partitionBy("n_regionkey").text(path)
    return sinks.manifest(d.spark, path).where("size > 0").select("size", "sha256")


@query("""select o_custkey, string_agg(o_orderkey || ':' || o_orderstatus, ',' order by o_orderdate, o_orderkey) as items from orders group by 1""")
def k02_nested(d):
    n = sinks.nested(d.orders, "o_custkey", "items", ["o_orderkey", "o_orderstatus"], ["o_orderdate", "o_orderkey"])
    return n.select("o_custkey", F.array_join(F.transform("items", lambda x: F.concat_ws(":", x["o_orderkey"], x["o_orderstatus"])), ",").alias("items"))


@query("select c_custkey as k, case when c_custkey % 2 = 0 then 'new' else c_mktsegment end as v from customer where c_custkey % 3 > 0 or c_custkey % 2 = 0")
def k03_upsert(d):
    old = d.customer.where("c_custkey % 3 > 0").selectExpr("c_custkey as k", "c_mktsegment as v")
    return sinks.upsert(old, d.customer.where("c_custkey % 2 = 0").selectExpr("c_custkey as k", "'new' as v"), ["k"])


@query("select c_custkey as k, case when c_custkey % 2 = 0 then 'new' else c_mktsegment end as v from customer where c_custkey % 3 > 0 or c_custkey % 2 = 0 union all select c_custkey, 'more' from customer where c_custkey % 2 = 0")
def k03_delete_insert(d):
    old = d.customer.where("c_custkey % 3 > 0").selectExpr("c_custkey as k", "c_mktsegment as v")
    new = d.customer.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.explode(F.array(F.lit("new"), F.lit("more"))).alias("v"))
    return sinks.replaced(old, new, ["k"])


@query("select c_custkey as k, c_name as n, case when c_custkey % 5 = 0 then null when c_custkey % 2 = 0 then 'new' else c_mktsegment end as v from customer where c_custkey % 3 > 0")
def k03_update(d):
    old = d.customer.where("c_custkey % 3 > 0").selectExpr("c_custkey as k", "c_name as n", "c_mktsegment as v")
    changes = d.customer.where("c_custkey % 2 = 0 or c_custkey % 5 = 0").selectExpr("c_custkey as k", "if(c_custkey % 5 = 0, null, 'new') as v")
    return sinks.updated(old, changes, ["k"], ["v"])


@query("select '<c' || c_custkey || '> foaf:name \"' || c_name || '\" .' as line from customer")
def k05_turtle(d):
    t = graph.triples(d.customer, F.concat(F.lit("c"), "c_custkey"), {"foaf:name": (F.col("c_name"), "string")})
    return t.select(sinks.turtle(t).alias("line"))


@query("select o_orderkey, cast(year(o_orderdate) as integer) as year from orders order by year(o_orderdate) desc, o_orderkey limit 100")
def k07_feed(d):
    return sinks.feed(d.orders.select("o_orderkey", F.year("o_orderdate").alias("year")), [F.col("year").desc(), F.col("o_orderkey")])


@query("""select cast(time_bucket(interval '1 day', ts) as varchar) as window_start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2""")
def stream_tumbling(d):
    out = ev.windowed(d.events, "ts", ["event_type"], "value", "1 day")
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n", "total")


@query("""with e as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval '6 hours' then 0 else 1 end as new from events), s as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as k from e)
select user_id, cast(min(ts) as varchar) as session_start, count(*) as n from s group by user_id, k""")
def stream_sessions(d):
    out = ev.sessions(d.events, "ts", "user_id", "6 hours")
    return out.select("user_id", F.col("session_start").cast("string").alias("session_start"), "n")
