"""Predicates, joins, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rollcall.operators import joins, select, similarity
from rollcall.operators.aggregates import listed
from rollcall.plans.data import SESSIONS, TAKING_PART, A, B
from rollcall.plans.registry import registry

QUERIES, SQL, query = registry()


@query("select c_custkey as customer, c_name as name, c_mktsegment as segment from customer")
def p01_projection(d):
    return d.customer.select(F.col("c_custkey").alias("customer"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))


@query("select o_orderkey, o_totalprice from orders where o_orderstatus = 'F' and o_custkey is not null and o_totalprice > 100000 and o_orderdate >= timestamp '1996-01-01' and o_orderdate < timestamp '1998-01-01'")
def p02_filters(d):
    return d.orders.where("o_orderstatus = 'F' and o_custkey is not null and o_totalprice > 100000 and o_orderdate >= timestamp '1996-01-01' and o_orderdate < timestamp '1998-01-01'").select("o_orderkey", "o_totalprice")


@query("select doc_id, length(text) as n from documents where coalesce(trim(text) <> '', false)")
def p03_present(d):
    return d.documents.where(select.present("text")).select("doc_id", F.char_length("text").cast("long").alias("n"))


@query("select p_partkey, p_name from part where p_name like '%1%' and p_brand like 'Brand#1%'")
def p04_like(d):
    return d.part.where("p_name like '%1%' and p_brand like 'Brand#1%'").select("p_partkey", "p_name")


@query("select c_custkey, c_mktsegment from customer where c_mktsegment in ('BUILDING', 'MACHINERY')")
def p05_in_list(d):
    return d.customer.where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select("c_custkey", "c_mktsegment")


@query("select doc_id from documents where contains(text, 'token') or contains(text, 'license') or contains(text, 'Copyright')")
def p06_any_pattern(d):
    return d.documents.where(select.any_pattern(F.col("text"), ["token", "license", "Copyright"])).select("doc_id")


@query("select doc_id from documents where contains(lower(text), 'the') and contains(lower(text), 'tion') and contains(lower(text), 'her')")
def p07_all_tokens(d):
    return d.documents.where(select.all_tokens(F.col("text"), "The TION her")).select("doc_id")


@query(f"""with {TAKING_PART}, m as (select person, sum(case when series = '{A}' then 1 else 0 end) as a, sum(case when series = '{B}' then 1 else 0 end) as b,
  max(case when price > 300000 then 1 else 0 end) as big from taking_part group by person)
select c_custkey, c_name from customer join m on c_custkey = person where (contains(c_mktsegment, 'BUILD') or contains(c_name, '7') or big = 1) and a > 0 and b = 0""")
def p08_facets(d):
    m = d.taking_part.groupBy("person").agg(F.count(F.when(F.col("series") == A, 1)).alias("a"), F.count(F.when(F.col("series") == B, 1)).alias("b"), F.collect_set(F.col("price") > 300000).alias("big"))
    any_field = F.col("c_mktsegment").contains("BUILD") | F.col("c_name").contains("7") | F.exists("big", lambda x: x)
    return d.customer.join(m, F.col("c_custkey") == F.col("person")).where(any_field & (select.membership(F.col("a"), F.col("b")) == "only_a")).select("c_custkey", "c_name")


@query(f"""with {TAKING_PART} select person, case when a > 0 and b > 0 then 'both' when a > 0 then 'only_a' when b > 0 then 'only_b' else 'none' end as member from
(select person, count(case when series = '{A}' then 1 end) as a, count(case when series = '{B}' then 1 end) as b from taking_part group by person)""")
def p09_membership_label(d):
    m = d.taking_part.groupBy("person").agg(F.count(F.when(F.col("series") == A, 1)).alias("a"), F.count(F.when(F.col("series") == B, 1)).alias("b"))
    return m.select("person", select.membership(F.col("a"), F.col("b")).alias("member"))


@query("""select p_partkey, case when p_size < 10 then 'small' when p_size <= 20 then 'middle' when p_size <= 35 then 'large' else 'huge' end as bin from part where p_size is not null""")
def p10_age_bins(d):
    return d.part.where("p_size is not null").select("p_partkey", select.ladder(F.col("p_size"), [(9, "small"), (20, "middle"), (35, "large")], "huge").alias("bin"))


@query("""select p_partkey, label from part left join (values (null, 9, 'first'), (10, 24, 'second'), (25, 44, 'third'), (45, null, 'last')) r(lo, hi, label)
on p_size between coalesce(lo, p_size) and coalesce(hi, p_size)""")
def p11_range_table(d):
    ranges = d.spark.createDataFrame([(None, 9, "first"), (10, 24, "second"), (25, 44, "third"), (45, None, "last")], "lo int, hi int, label string")
    return select.by_ranges(d.part, "p_size", ranges).select("p_partkey", "label")


@query(f"with {TAKING_PART} select item, case when year between 1995 and 1996 then 'early' when year between 1997 and 1999 then 'middle' else 'other' end as period from taking_part")
def p12_periods(d):
    y = F.col("year")
    return d.taking_part.select("item", F.when(y.between(1995, 1996), "early").when(y.between(1997, 1999), "middle").otherwise("other").alias("period"))


@query(f"with {TAKING_PART} select cast(year - year % 10 as integer) as decade, count(*) as n from taking_part group by 1")
def p13_decades(d):
    return d.taking_part.groupBy((F.floor(F.col("year") / 10) * 10).cast("int").alias("decade")).agg(F.count("*").alias("n"))


@query(f"with {TAKING_PART} select k, count(*) as persons from (select person, least(5, count(*)) as k from taking_part group by person) group by k")
def p14_capped(d):
    return d.taking_part.groupBy("person").agg(F.least(F.lit(5).cast("long"), F.count("*")).alias("k")).groupBy("k").agg(F.count("*").alias("persons"))


@query(f"""with {TAKING_PART} select b, count(*) as persons from (select case when count(*) = 1 then '1' when count(*) = 2 then '2' when count(*) <= 4 then '3-4' else '5+' end as b
from taking_part group by person) group by b""")
def p15_buckets(d):
    n = d.taking_part.groupBy("person").agg(F.count("*").alias("n"))
    return n.groupBy(select.ladder(F.col("n"), [(1, "1"), (2, "2"), (4, "3-4")], "5+").alias("b")).agg(F.count("*").alias("persons"))


@query("select l_orderkey, l_linenumber, case when l_linenumber = 1 then 'speaker' else 'coauthor' end as role from lineitem")
def p16_roles(d):
    return d.lineitem.select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") == 1, "speaker").otherwise("coauthor").alias("role"))


@query("""with b as (select c_custkey, 1900 + c_custkey % 100 as born from customer), y as (select unnest(range(2026, 2046)) as mark_year)
select c_custkey, cast(mark_year as integer) as mark_year, cast(mark_year - born as integer) as mark from b, y where mark_year - born in (50, 75, 100, 125)""")
def p17_anniversaries(d):
    born = d.customer.select("c_custkey", (F.lit(1900) + F.pmod("c_custkey", F.lit(100))).cast("int").alias("born"))
    return select.anniversaries(born, "born", 2026, 2045, [50, 75, 100, 125]).select("c_custkey", "mark_year", "mark")


@query("""select r_name, n_name, cast(year(o_orderdate) as integer) as year, count(*) as lines, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue
from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1, 2, 3""")
def j01_spine(d):
    s = joins.spine(d.lineitem, [(d.orders, "l_orderkey", "o_orderkey", "inner"), (d.customer, "o_custkey", "c_custkey", "inner"), (d.nation, "c_nationkey", "n_nationkey", "inner"), (d.region, "n_regionkey", "r_regionkey", "inner")])
    return s.groupBy("r_name", "n_name", F.year("o_orderdate").alias("year")).agg(F.count("*").alias("lines"), F.round(F.sum(F.expr("l_extendedprice * (1 - l_discount)")), 2).alias("revenue"))


@query("select lang, count(*) as n, count(case when toxic = 1 then 1 end) as toxic from documents join labels using (doc_id) group by lang")
def j02_using(d):
    return d.documents.join(d.labels, "doc_id").groupBy("lang").agg(F.count("*").alias("n"), F.count(F.when(F.col("toxic") == 1, 1)).alias("toxic"))


@query("select c_custkey, count(o_orderkey) as n from customer left join orders on c_custkey = o_custkey group by c_custkey")
def j03_left_group(d):
    return joins.spine(d.customer, [(d.orders, "c_custkey", "o_custkey", "left")]).groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))


@query("select o_orderkey from orders left join lineitem on o_orderkey = l_orderkey where l_orderkey is null")
def j04_dangling(d):
    return joins.unmatched(d.orders, d.lineitem, "o_orderkey", "l_orderkey").select("o_orderkey")


@query("select doc_id from documents where doc_id not in (select doc_id from labels)")
def j05_not_in(d):
    return joins.unmatched(d.documents, d.labels, "doc_id", "doc_id").select("doc_id")


@query("select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 250000)")
def j06_semi(d):
    return joins.matched(d.customer, d.orders.where("o_totalprice > 250000"), "c_custkey", "o_custkey").select("c_custkey")


@query(f"""with {SESSIONS}, p as (select distinct session, person, talk, year from sessions)
select a.person as a, b.person as b, count(distinct a.session) as weight from p a join p b on a.session = b.session and a.person < b.person and a.talk <> b.talk group by 1, 2 having count(distinct a.session) > 1""")
def j07_self_join(d):
    from rollcall.operators.graph import co_presence

    return co_presence(d.sessions, "session", "person", item="talk").where("weight > 1").select("a", "b", "weight")


SPANS = """spans as (select c_custkey as person, 'home' || c_nationkey as org, 1996 as s, case when c_custkey % 3 = 0 then null else 1998 end as e, 1 as o from customer
  union all select c_custkey, 'away' || c_nationkey, 1997, 1999, 2 from customer where c_custkey % 2 = 0)"""


def _spans(d):
    first = d.customer.selectExpr("c_custkey as person", "concat('home', c_nationkey) as org", "1996 as start", "if(c_custkey % 3 = 0, null, 1998) as end", "1 as o")
    return first.unionByName(d.customer.where("c_custkey % 2 = 0").selectExpr("c_custkey as person", "concat('away', c_nationkey) as org", "1997 as start", "1999 as end", "2 as o"))


@query(f"""with {TAKING_PART}, {SPANS}, m as (select item, year, case when item % 5 = 0 then 'given' end as observed, org, s, e, row_number() over (partition by item order by o) as n
  from taking_part t left join spans p on t.person = p.person and year >= s and year <= coalesce(e, year))
select item, case when observed is not null then observed when org is not null and e is null and year > s then org || ' (?)' else org end as value,
  case when observed is not null then 'programme' when org is not null and e is null and year > s then 'inferred_continuation' when org is not null then 'verified' end as basis from m where n = 1""")
def j08_interval(d):
    rows = d.taking_part.withColumn("observed", F.when(F.col("item") % 5 == 0, "given"))
    at = joins.valid_at(rows, _spans(d), "person", "year", "org", "o")
    return joins.public_value(at, "observed", "org", "span_start", "span_end", "year").select("item", "value", "basis")


@query("""with s as (select c_custkey as name, date '1995-01-01' + cast(c_custkey * 7 % 2500 as integer) as s, case when c_custkey % 5 > 0 then date '1995-01-01' + cast(c_custkey * 7 % 2500 + c_custkey % 90 as integer) end as e, c_custkey % 101 as o from customer),
w as (select distinct cast(o_orderdate as date) as day from orders), f as (select day, arg_min(name, o * 1000000000 + name) as name from w join s on s <= day and day <= coalesce(e, day) group by 1)
select o_orderkey, name from orders left join f on cast(o_orderdate as date) = day""")
def j08_interval_without_key(d):
    span = d.customer.selectExpr("c_custkey as name", "date_add(date'1995-01-01', cast(c_custkey * 7 % 2500 as int)) as start",
                                 "if(c_custkey % 5 > 0, date_add(date'1995-01-01', cast(c_custkey * 7 % 2500 + c_custkey % 90 as int)), null) as end", "c_custkey % 101 as o")
    return joins.valid_at(d.orders.withColumn("day", F.to_date("o_orderdate")), span, None, "day", "name", "o").select("o_orderkey", "name")


RULES = [("en_like", "[ .]the "), ("en_like", "[ .]and "), ("fr_like", "[ .]les "), ("de_like", "[ .]und "), ("marks", "[%#&]{3}")]


@query("select doc_id, label from documents join (values ('en_like', '[ .]the |[ .]and '), ('fr_like', '[ .]les '), ('de_like', '[ .]und '), ('marks', '[%#&]{3}')) r(label, p) on regexp_matches(text, p)")
def j09_rules(d):
    return joins.match_rules(d.documents, "text", RULES).select("doc_id", "label")


@query("""with o as (select doc_id, 'q' || quality as theme from labels where doc_id % 2 = 0), t as (select text, min(lang) as theme from documents where doc_id % 3 = 0 group by text)
select d.doc_id, coalesce(o.theme, t.theme, 'unspecified') as theme from documents d left join o using (doc_id) left join t on d.text = t.text""")
def j10_fallback(d):
    o = d.labels.where("doc_id % 2 = 0").selectExpr("doc_id", "concat('q', quality) as theme")
    t = d.documents.where("doc_id % 3 = 0").groupBy("text").agg(F.min("lang").alias("theme"))
    return joins.first_of(d.documents.select("doc_id", "text"), [(o, ["doc_id"], "theme"), (t, ["text"], "theme")], "theme", "unspecified").select("doc_id", "theme")


@query("""with r as (select o_orderkey, o_custkey, cast(year(o_orderdate) as integer) as y, o_orderpriority as code from orders where o_orderkey % 4 = 0),
k as (select o_custkey, y, min(code) as code from r group by 1, 2)
select o.o_orderkey, coalesce(r.code, k.code) as code from orders o left join r using (o_orderkey) left join k on o.o_custkey = k.o_custkey and year(o.o_orderdate) = k.y""")
def j11_id_or_key(d):
    o = d.orders.withColumn("y", F.year("o_orderdate"))
    r = o.where("o_orderkey % 4 = 0")
    k = r.groupBy("o_custkey", "y").agg(F.min("o_orderpriority").alias("code"))
    return joins.first_of(o, [(r, ["o_orderkey"], "o_orderpriority"), (k, ["o_custkey", "y"], "code")], "code").select("o_orderkey", "code")


@query("""with t as (select doc_id, source as block, trim(substr(regexp_extract(text, '^[^.]*'), 1, 80)) as title from documents),
g as (select doc_id, block, unnest(list_distinct(list_transform(range(1, greatest(length(title) - 2, 1) + 1), lambda i: substr(lower(title), i, 3)))) as gram from t where title <> ''),
n as (select doc_id, count(*) as n from g group by 1),
o as (select a.doc_id as a, b.doc_id as b, a.block = b.block as near, count(*) as o from g a join g b on a.gram = b.gram and a.doc_id <> b.doc_id group by 1, 2, 3),
s as (select a, b, near, 2.0::double * o / (x.n + y.n) as score from o join n x on x.doc_id = a join n y on y.doc_id = b where 2.0::double * o / (x.n + y.n) >= 0.7),
r as (select *, row_number() over (partition by a order by near desc, score desc, b) as k from s)
select a as doc_id, b as other, round(score, 6) as score, case when near then 'block' else 'all' end as stage from r where k = 1""")
def j12_fuzzy_best_match(d):
    title = F.trim(F.substring(F.regexp_extract("text", "^[^.]*", 0), 1, 80))
    left = d.documents.select("doc_id", "source", title.alias("title"))
    right = left.withColumnRenamed("doc_id", "other")
    return similarity.best_match(left, right, "doc_id", "other", "title", "title", "source", 0.7).withColumn("score", F.round("score", 6))


@query("""with a as (select c_custkey as alias, c_nationkey as block, c_mktsegment as seg, c_acctbal as bal from customer where c_custkey % 10 = 0),
t as (select c_custkey as target, c_nationkey as block, c_mktsegment as tseg, c_acctbal as tbal from customer where c_custkey % 10 <> 0),
s as (select alias, target, (case when seg = tseg then 60 else 0 end) + (case when abs(bal - tbal) < 500 then 30 else 0 end) as score from a join t using (block)),
p as (select *, row_number() over (partition by alias order by score desc, target) as rank, count(*) over (partition by alias, score) > 1 as ambiguous from s where score > 0)
select alias, target, cast(score as integer) as score, cast(rank as integer) as rank, ambiguous from p where rank <= 5""")
def j13_candidates(d):
    c = d.customer
    a = c.where("c_custkey % 10 = 0").selectExpr("c_custkey as alias", "c_nationkey as block", "c_mktsegment as seg", "c_acctbal as bal")
    t = c.where("c_custkey % 10 <> 0").selectExpr("c_custkey as target", "c_nationkey as block", "c_mktsegment as tseg", "c_acctbal as tbal")
    return joins.rule_candidates(a, t, "block", "alias", "target", {("seg", "tseg"): 60}, ("bal", "tbal", 500.0, 30)).select("alias", "target", "score", "rank", "ambiguous")


@query("""with f as (select distinct l_suppkey as item, l_partkey as feature, 1 + l_partkey % 3 as w from lineitem),
s as (select a.item, b.item as other, sum(a.w) as score from f a join f b on a.feature = b.feature and a.item <> b.item group by 1, 2),
r as (select *, row_number() over (partition by item order by score desc, other) as rank from s)
select item, other, cast(score as bigint) as score, cast(rank as integer) as rank from r where rank <= 8""")
def j14_related(d):
    f = d.lineitem.selectExpr("l_suppkey as item", "l_partkey as feature", "1 + l_partkey % 3 as w")
    return joins.related(f, "item", "feature", "w", 8).select("item", "other", "score", "rank")


@query("""with b as (select c_custkey as k, c_name as n, c_mktsegment as s from customer where c_custkey % 7 <> 0),
a as (select c_custkey as k, c_name as n, case when c_custkey % 11 = 0 then 'MOVED' else c_mktsegment end as s from customer where c_custkey % 5 <> 0)
select coalesce(b.k, a.k) as k, case when b.k is null then 'added' when a.k is null then 'removed' when b.s <> a.s then 'changed' else 'same' end as status,
case when b.s <> a.s then 's' else '' end as changed from b full outer join a on a.k = b.k""")
def j15_snapshot_diff(d):
    b = d.customer.where("c_custkey % 7 <> 0").selectExpr("c_custkey as k", "c_name as n", "c_mktsegment as s")
    a = d.customer.where("c_custkey % 5 <> 0").selectExpr("c_custkey as k", "c_name as n", "if(c_custkey % 11 = 0, 'MOVED', c_mktsegment) as s")
    return joins.snapshot_diff(b, a, "k", ["n", "s"])


@query("""with o as (select p_partkey as id, p_brand as brand, p_type as kind, p_name as name from part), n as (select p_partkey + 100000 as id, p_brand as brand, p_type as kind,
  case when p_partkey % 4 = 0 then p_name || ' new' else p_name end as name from part),
oe as (select brand, kind, name, min(id) as old from o group by 1, 2, 3 having count(*) = 1), ne as (select brand, kind, name, min(id) as new from n group by 1, 2, 3 having count(*) = 1),
one as (select old, new, 'exact' as stage from oe join ne using (brand, kind, name)),
ol as (select brand, kind, substr(lower(name), 1, 6) as p, min(id) as old from o where id not in (select old from one) group by 1, 2, 3 having count(*) = 1),
nl as (select brand, kind, substr(lower(name), 1, 6) as p, min(id) as new from n where id not in (select new from one) group by 1, 2, 3 having count(*) = 1)
select * from one union all select old, new, 'loose' from ol join nl using (brand, kind, p)""")
def j16_staged(d):
    o = d.part.selectExpr("p_partkey as id", "p_brand as brand", "p_type as kind", "p_name as name")
    n = d.part.selectExpr("p_partkey + 100000 as id", "p_brand as brand", "p_type as kind", "if(p_partkey % 4 = 0, concat(p_name, ' new'), p_name) as name")
    return joins.staged_match(o, n, "id", "id", ["brand", "kind", "name"], ["brand", "kind"], ("name", 6))


@query("select distinct o_custkey as person from orders where o_orderpriority = '1-URGENT' intersect select distinct o_custkey from orders where o_orderpriority = '5-LOW'")
def j17_set_overlap(d):
    pick = lambda s: d.taking_part.where(F.col("series") == s).select("person")
    return pick(A).intersect(pick(B))


@query("""with m as (select 'customer' as kind, c_custkey as id, c_acctbal as v from customer union all select 'supplier', s_suppkey, s_acctbal from supplier)
select c_custkey, v from customer join m on m.id = c_custkey and m.kind = 'customer'""")
def j18_polymorphic(d):
    m = d.customer.selectExpr("'customer' as kind", "c_custkey as id", "c_acctbal as v").unionByName(d.supplier.selectExpr("'supplier' as kind", "s_suppkey as id", "s_acctbal as v"))
    return d.customer.join(m.where("kind = 'customer'"), F.col("id") == F.col("c_custkey")).select("c_custkey", "v")


@query("select c_custkey, (select count(*) from orders where o_custkey = c_custkey and o_orderstatus = 'F') as n from customer")
def j19_scalar_subquery(d):
    n = d.orders.where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return d.customer.join(n, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"""with {TAKING_PART}, a as (select year, count(*) as n_a from taking_part where series = '{A}' and status = 'F' and year <> 1997 group by year),
b as (select year, count(*) as n_b from taking_part where series = '{B}' and status = 'F' and year <> 1999 group by year)
select coalesce(a.year, b.year) as year, coalesce(n_a, 0) as n_a, coalesce(n_b, 0) as n_b from a full outer join b on a.year = b.year""")
def j20_outer_years(d):
    done = d.taking_part.where("status = 'F'")
    a = done.where((F.col("series") == A) & (F.col("year") != 1997)).groupBy("year").agg(F.count("*").alias("n_a"))
    b = done.where((F.col("series") == B) & (F.col("year") != 1999)).groupBy("year").agg(F.count("*").alias("n_b"))
    return a.join(b, "year", "full_outer").na.fill(0, ["n_a", "n_b"])


@query("""select cast(row_number() over (order by coalesce(case when p_size % 7 = 0 then null else p_size end, 9999), p_retailprice desc, p_partkey) as integer) as place, p_partkey from part order by 1 limit 50""")
def o01_sort_nulls(d):
    rows = d.part.withColumn("size", F.when(F.col("p_size") % 7 != 0, F.col("p_size")))
    top = rows.orderBy(F.coalesce("size", F.lit(9999)), F.col("p_retailprice").desc(), "p_partkey").limit(50)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.coalesce("size", F.lit(9999)), F.col("p_retailprice").desc(), "p_partkey"))).select("place", "p_partkey")


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25")
def o02_top_n(d):
    return d.orders.orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(25).select("o_orderkey", "o_totalprice")


@query("select c_custkey, c_name from customer order by c_name, c_custkey limit 20 offset 40")
def o03_page(d):
    return select.page(d.customer.select("c_custkey", "c_name"), ["c_name", "c_custkey"], 3, 20)


@query()
def o04_locale_order(d):
    words = d.documents.select(F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("w")).where("w <> ''").distinct()
    return words.orderBy(F.expr("collate(w, 'fr')"), "w")


@query("select c_mktsegment as v from customer where c_custkey % 2 = 0 intersect select c_mktsegment from customer where c_custkey % 2 = 1")
def o05_intersect(d):
    return d.customer.where("c_custkey % 2 = 0").selectExpr("c_mktsegment as v").intersect(d.customer.where("c_custkey % 2 = 1").selectExpr("c_mktsegment as v"))


@query("select c_custkey as k from customer except select o_custkey from orders where o_totalprice > 200000")
def o06_difference(d):
    return d.customer.selectExpr("c_custkey as k").subtract(d.orders.where("o_totalprice > 200000").selectExpr("o_custkey as k"))


@query("select distinct c_nationkey as nation, 'customer' as side from customer union all select distinct s_nationkey, 'supplier' from supplier")
def o07_union(d):
    return d.customer.selectExpr("c_nationkey as nation", "'customer' as side").distinct().unionByName(d.supplier.selectExpr("s_nationkey as nation", "'supplier' as side").distinct())


@query("""with s as (select o_orderkey as k, 1 as p, 'large' as why from orders where o_totalprice > 300000 union all select o_orderkey, 2, 'urgent' from orders where o_orderpriority = '1-URGENT' and o_orderstatus = 'P'
union all select o_orderkey, 3, 'late' from orders where o_orderdate >= timestamp '2001-06-01')
select k, min(p) as p, string_agg(why, '; ' order by p) as why from s group by k""")
def o08_priority_union(d):
    s = [d.orders.where(c).selectExpr("o_orderkey as k", f"{p} as p", f"'{why}' as why") for c, p, why in
         (("o_totalprice > 300000", 1, "large"), ("o_orderpriority = '1-URGENT' and o_orderstatus = 'P'", 2, "urgent"), ("o_orderdate >= timestamp '2001-06-01'", 3, "late"))]
    return select.merge_reasons(s, "k", "p", "why")


@query("""select o_custkey, o_orderkey from (select *, row_number() over (partition by o_custkey order by case when o_orderstatus = 'P' then 0 else 1 end, o_totalprice desc, o_orderkey) as n from orders) where n = 1""")
def o09_keep_best(d):
    return select.keep_best(d.orders, ["o_custkey"], [F.when(F.col("o_orderstatus") == "P", 0).otherwise(1), F.col("o_totalprice").desc(), F.col("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("select l_orderkey, string_agg(cast(l_suppkey as varchar), ', ' order by l_linenumber, l_suppkey) as suppliers from lineitem group by l_orderkey")
def a18_ordered_list(d):
    return d.lineitem.withColumn("s", F.col("l_suppkey").cast("string")).groupBy("l_orderkey").agg(listed(["l_linenumber", "l_suppkey"], "s", ", ").alias("suppliers"))
