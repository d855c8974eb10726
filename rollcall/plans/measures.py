"""Aggregates, windows and cohorts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rollcall.operators import aggregates as agg
from rollcall.operators import resolve, select, temporal
from rollcall.plans.data import TAKING_PART, A, B
from rollcall.plans.registry import registry

QUERIES, SQL, query = registry()
BOTH = f"('{A}', '{B}')"
ACTIVITY = f"""activity as (select person, count(distinct item) as total_items, cast(sum(case when series = '{A}' then 1 else 0 end) as bigint) as a_rows,
  cast(sum(case when series = '{B}' then 1 else 0 end) as bigint) as b_rows, min(year) as first_year, max(year) as last_year from taking_part group by person)"""


def _activity(d):
    return agg.activity(d.taking_part, "person", "item", "series", "year", A, B)


@query(f"""with {TAKING_PART}, {ACTIVITY} select *, case when a_rows > 0 and b_rows > 0 then 'both' when a_rows > 0 then 'only_a' when b_rows > 0 then 'only_b' else 'none' end as member from activity""")
def a01_membership_summary(d):
    return _activity(d).withColumn("member", select.membership(F.col("a_rows"), F.col("b_rows")))


@query(f"with {TAKING_PART}, {ACTIVITY} select person, total_items from activity where a_rows > 0 and b_rows = 0")
def a02_only_a(d):
    return _activity(d).where("a_rows > 0 and b_rows = 0").select("person", "total_items")


@query(f"with {TAKING_PART} select count(*) as persons from (select person from taking_part where series in {BOTH} group by person having count(distinct series) = 2)")
def a03_having_overlap(d):
    both = d.taking_part.where(F.col("series").isin(A, B)).groupBy("person").agg(F.countDistinct("series").alias("k")).where("k = 2")
    return both.agg(F.count("*").alias("persons"))


@query("""with v as (select n_name as grp, c_acctbal as v from customer join nation on c_nationkey = n_nationkey),
r as (select grp, v, row_number() over (partition by grp order by v) as r, count(*) over (partition by grp) as n from v)
select grp, n, round(avg(v), 2) as mean, round(median(v), 2) as median, min(v) as lo, max(v) as hi,
round(case when n < 4 then min(v) else sum(case when r = floor((n + 1) / 4.0) then v * (1 - ((n + 1) / 4.0 - floor((n + 1) / 4.0))) when r = floor((n + 1) / 4.0) + 1 then v * ((n + 1) / 4.0 - floor((n + 1) / 4.0)) end) end, 2) as q1,
round(case when n < 4 then max(v) else sum(case when r = floor(3 * (n + 1) / 4.0) then v * (1 - (3 * (n + 1) / 4.0 - floor(3 * (n + 1) / 4.0))) when r = floor(3 * (n + 1) / 4.0) + 1 then v * (3 * (n + 1) / 4.0 - floor(3 * (n + 1) / 4.0)) end) end, 2) as q3
from r group by grp, n""")
def a04_distribution(d):
    v = d.customer.join(d.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("grp"), F.col("c_acctbal").alias("v"))
    out = agg.distribution(v, ["grp"], "v")
    return out.select("grp", "n", *[F.round(c, 2).alias(c) for c in ("mean", "median", "q1", "q3")], "lo", "hi")


@query("""with r as (select p_brand, p_size, row_number() over (partition by p_brand order by p_size) - 1 as i, count(*) over (partition by p_brand) as n from part)
select p_brand, n, max(case when i = n // 2 then p_size end) as median from r group by p_brand, n""")
def a05_upper_median(d):
    return agg.at_rank(d.part, ["p_brand"], "p_size", {"median": 0.5})


@query("""with r as (select p_type, p_retailprice as v, row_number() over (partition by p_type order by p_retailprice) - 1 as i, count(*) over (partition by p_type) as n from part)
select p_type, n, min(v) as lo, max(case when i = cast(floor(n * 0.25) as bigint) then v end) as q1, max(case when i = cast(floor(n * 0.5) as bigint) then v end) as mid,
max(case when i = cast(floor(n * 0.75) as bigint) then v end) as q3, max(v) as hi from r group by p_type, n""")
def a06_box_plot(d):
    return agg.at_rank(d.part, ["p_type"], "p_retailprice", {"lo": 0.0, "q1": 0.25, "mid": 0.5, "q3": 0.75, "hi": 1.0})


@query(f"""with {TAKING_PART}, k as (select series, person, count(distinct year) as x from taking_part group by 1, 2), r as (select *, row_number() over (partition by series order by x) as i from k)
select series, count(*) as n, round(2.0 * sum(i * x) / (count(*) * sum(x)) - (count(*) + 1.0) / count(*), 6) as gini from r group by series""")
def a07_gini(d):
    k = d.taking_part.groupBy("series", "person").agg(F.countDistinct("year").alias("x"))
    return agg.gini(k, ["series"], "x")


CLOSED = """select series, count(*) as persons, cast(sum(k) as bigint) as participations, round(100.0 * count(case when k = 1 then 1 end) / count(*), 1) as one_timer_pct,
round(100.0 * count(case when k >= 5 then 1 end) / count(*), 1) as core_pct, round(100.0 * count(case when k >= 2 then 1 end) / count(*), 1) as retained_pct, max(k) as most from k group by series"""


@query(f"with {TAKING_PART}, k as (select series, person, count(distinct year) as k from taking_part group by 1, 2) {CLOSED}")
def a08_closedness_by_year(d):
    return agg.closedness(d.taking_part, "series", "person", "year")


@query(f"with {TAKING_PART}, k as (select series, person, count(*) as k from taking_part group by 1, 2) {CLOSED}")
def a08_closedness_by_row(d):
    return agg.closedness(d.taking_part, "series", "person", "year", distinct_period=False)


@query(f"""with {TAKING_PART}, p as (select distinct series, year, person from taking_part), f as (select *, min(year) over (partition by series, person) as d from p)
select series, year, count(case when d = year then 1 end) as newcomers, count(*) as total, round(100.0 * count(case when d = year then 1 end) / count(*), 1) as newcomer_pct from f group by 1, 2""")
def a09_newcomer_rate(d):
    return temporal.newcomers(d.taking_part, "series", "year", "person")


@query(f"""with {TAKING_PART}, p as (select distinct series, year, person from taking_part), f as (select *, min(year) over (partition by series, person) as debut_year from p),
c as (select series, debut_year, cast(year - debut_year as integer) as years_since, count(*) as active_n from f group by 1, 2, 3)
select *, max(case when years_since = 0 then active_n end) over (partition by series, debut_year) as cohort_size,
round(100.0 * active_n / max(case when years_since = 0 then active_n end) over (partition by series, debut_year), 1) as survival_pct from c""")
def a10_cohort_survival(d):
    return temporal.cohort_survival(d.taking_part, "series", "year", "person")


@query(f"""with {TAKING_PART}, k as (select c_mktsegment as grp, person, count(distinct year) as k from taking_part join customer on person = c_custkey group by 1, 2)
select grp, count(*) as persons, count(case when k >= 2 then 1 end) as retained, round(100.0 * count(case when k >= 2 then 1 end) / count(*), 1) as retention_pct from k group by grp""")
def a11_retention(d):
    return temporal.retention(d.taking_part.join(d.customer, F.col("person") == F.col("c_custkey")), "person", "year", F.col("c_mktsegment"))


@query(f"""with {TAKING_PART}, k as (select count(distinct item) as k from taking_part group by person), n as (select k, count(*) as persons from k group by k)
select g.k as k, coalesce(persons, 0) as persons from (select unnest(range(1, (select max(k) + 1 from n))) as k) g left join n on n.k = g.k""")
def a12_loyalty_histogram(d):
    return agg.histogram(d.taking_part, "person", "item")


@query(f"""with {TAKING_PART} select year, count(case when series = '{A}' then 1 end) as a, count(case when series = '{B}' then 1 end) as b, count(*) as every from taking_part group by year""")
def a13_year_by_series(d):
    return d.taking_part.groupBy("year").agg(F.count(F.when(F.col("series") == A, 1)).alias("a"), F.count(F.when(F.col("series") == B, 1)).alias("b"), F.count("*").alias("every"))


@query("""select o_orderpriority, count(case when o_orderstatus = 'F' then 1 end) as n_0, count(case when o_orderstatus = 'O' then 1 end) as n_1, count(case when o_orderstatus = 'P' then 1 end) as n_2, count(*) as total,
round(100.0 * count(case when o_orderstatus = 'F' then 1 end) / count(*), 1) as pct_0, round(100.0 * count(case when o_orderstatus = 'O' then 1 end) / count(*), 1) as pct_1,
round(100.0 * count(case when o_orderstatus = 'P' then 1 end) / count(*), 1) as pct_2 from orders where o_orderstatus in ('F', 'O', 'P') group by 1""")
def a14_crosstab(d):
    return agg.crosstab(d.orders, "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


@query("select case when grouping(lang) = 1 then 'ALL' else lang end as lang, count(*) as n, count(quality) as labelled, round(100.0 * count(quality) / count(*), 1) as pct from documents left join labels using (doc_id) group by rollup (lang)")
def a15_total_row(d):
    rows = d.documents.join(d.labels, "doc_id", "left")
    return agg.with_total(rows, "lang", "ALL", n=F.count("*"), labelled=F.count("quality"), pct=F.round(100.0 * F.count("quality") / F.count("*"), 1))


@query("""select scope, count(*) as n, round(avg(n_chars), 2) as chars from (select n_chars, unnest(list_filter(['all', case when n_chars > 2000 then 'long' end, case when lang = 'en' then 'english' end], lambda x: x is not null)) as scope from documents) group by scope""")
def a16_scopes(d):
    scopes = {"all": F.lit(True), "long": F.col("n_chars") > 2000, "english": F.col("lang") == "en"}
    return agg.in_scopes(d.documents, scopes).groupBy("scope").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 2).alias("chars"))


@query("""with r as (select distinct l_orderkey as item, l_suppkey as author, s_nationkey as org from lineitem join supplier on l_suppkey = s_suppkey union select distinct l_orderkey, l_suppkey, 100 + l_suppkey % 3 from lineitem where l_suppkey % 4 = 0),
k as (select item, count(distinct author) as k from r group by item), m as (select item, author, count(*) as m from r group by 1, 2)
select org, count(distinct item) as simple_count, round(sum(1.0 / (k * m)), 4) as fractional_count from r join m using (item, author) join k using (item) group by org""")
def a17_fractional(d):
    own = d.lineitem.join(d.supplier, F.col("l_suppkey") == F.col("s_suppkey")).selectExpr("l_orderkey as item", "l_suppkey as author", "cast(s_nationkey as long) as org")
    more = d.lineitem.where("l_suppkey % 4 = 0").selectExpr("l_orderkey as item", "l_suppkey as author", "100 + l_suppkey % 3 as org")
    return agg.fractional(own.unionByName(more), "item", "author", "org")


@query("""with f as (select o_custkey, o_orderpriority as p, min(o_orderdate) as t, min(o_orderkey) as k from orders group by 1, 2), m as (select o_custkey, o_orderpriority as p, min(struct_pack(d := o_orderdate, k := o_orderkey)) as s from orders group by 1, 2)
select o_custkey, string_agg(p, ',' order by s.d, s.k) as series from m group by 1""")
def a19_first_seen(d):
    return d.orders.groupBy("o_custkey").agg(agg.first_seen(["o_orderdate", "o_orderkey"], "o_orderpriority", ",").alias("series"))


@query("""with v as (select c_nationkey as g, c_mktsegment || case when c_custkey % 3 > 0 then ' (?)' else '' end as v from customer), b as (select g, replace(v, ' (?)', '') as base, v from v)
select g, base, case when bool_or(v = base) then base else base || ' (?)' end as value from b group by 1, 2""")
def a20_variants(d):
    v = d.customer.selectExpr("c_nationkey as g", "concat(c_mktsegment, if(c_custkey % 3 > 0, ' (?)', '')) as v")
    return agg.settle_variants(v, "g", "v")


@query("""with n as (select p_type as g, list(distinct p_brand) as l from (select p_type, p_brand from part union select p_type, substr(p_brand, 1, 7) from part where p_partkey % 3 = 0) group by 1)
select g, array_to_string(list_sort(list_filter(l, lambda x: len(list_filter(l, lambda o: o <> x and starts_with(o, x))) = 0)), ',') as notes from n""")
def a21_prefixes(d):
    short = d.part.where("p_partkey % 3 = 0").selectExpr("p_type", "substring(p_brand, 1, 7) as p_brand")
    notes = d.part.select("p_type", "p_brand").unionByName(short).groupBy(F.col("p_type").alias("g")).agg(F.collect_set("p_brand").alias("l"))
    return notes.select("g", F.array_join(F.array_sort(agg.drop_prefixes(F.col("l"))), ",").alias("notes"))


@query("""with c as (select o_custkey as person, case when o_orderkey % 2 = 0 then 'unspecified' else o_orderpriority end as theme, count(*) as n from orders group by 1, 2),
r as (select *, row_number() over (partition by person order by case when theme = 'unspecified' then 1 else 0 end, n desc, theme) as i from c) select person, theme, n from r where i = 1""")
def a22_dominant(d):
    rows = d.orders.select(F.col("o_custkey").alias("person"), F.when(F.col("o_orderkey") % 2 == 0, "unspecified").otherwise(F.col("o_orderpriority")).alias("theme"))
    return agg.dominant(rows, "person", "theme", "unspecified")


@query("""select o_custkey as person, bool_or(o_orderstatus = 'P') as ever_pending, bool_or(contains(o_orderpriority, 'URG')) as ever_urgent, count(distinct o_orderpriority) > 2 as changed from orders group by 1""")
def a23_flags(d):
    return d.orders.groupBy(F.col("o_custkey").alias("person")).agg(F.bool_or(F.col("o_orderstatus") == "P").alias("ever_pending"), F.bool_or(F.col("o_orderpriority").contains("URG")).alias("ever_urgent"),
                                                                     (F.countDistinct("o_orderpriority") > 2).alias("changed"))


@query(f"""with {TAKING_PART}, g as (select * from taking_part where status <> 'P' and year < 1999), m as (select person, max(year) as as_of from g group by person)
select p.person, max(g.series) as value, m.as_of from (select distinct person from taking_part) p left join m on p.person = m.person left join g on g.person = m.person and g.year = m.as_of group by 1, 3""")
def a24_last_known(d):
    return agg.last_known(d.taking_part, "person", "year", "series", 1999, F.col("status") != "P")


@query(f"with {TAKING_PART} select person, count(*) as n from taking_part group by person having max(case when status = 'P' then 1 else 0 end) = 0")
def a25_never(d):
    return agg.never(d.taking_part, "person", F.col("status") == "P")


@query("""with c as (select r_name as g, n_name as k, count(*) as n from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1, 2), r as (select *, row_number() over (partition by g order by n desc, k) as i from c)
select g, string_agg(k || ':' || n, '; ' order by i) as top from r where i <= 3 group by g""")
def a26_top_text(d):
    rows = d.customer.join(d.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(d.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return agg.top_text(rows.select(F.col("r_name").alias("g"), F.col("n_name").alias("k")), "g", "k", 3)


@query(f"""with {TAKING_PART}, c as (select person, count(case when series = '{A}' then 1 end) as x, count(case when series = '{B}' then 1 end) as y from taking_part group by person)
select round(sum(x * y) / sqrt(cast(sum(x * x) as double) * sum(y * y)), 6) as cosine from c""")
def a27_cosine(d):
    return agg.cosine(d.taking_part, "series", "person", A, B)


@query("select n_name as org, count(*) as talks, count(distinct o_custkey) as persons from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1")
def a28_leaderboard(d):
    rows = d.orders.join(d.customer, F.col("o_custkey") == F.col("c_custkey")).join(d.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy(F.col("n_name").alias("org")).agg(F.count("*").alias("talks"), F.countDistinct("o_custkey").alias("persons"))


@query("""select lang, source, count(*) as n, count(l.doc_id) as covered, round(100.0 * count(l.doc_id) / count(*), 1) as pct from documents d left join labels l on d.doc_id = l.doc_id group by 1, 2""")
def a29_coverage(d):
    rows = d.documents.join(d.labels.select("doc_id", F.lit(1).alias("has")), "doc_id", "left")
    return rows.groupBy("lang", "source").agg(F.count("*").alias("n"), F.count("has").alias("covered"), agg.pct(F.count("has"), F.count("*")).alias("pct"))


@query(f"""with {TAKING_PART} select year, round(100.0 * avg(case when year = 1997 then 1 when status = 'P' then 1 else 0 end), 1) as online_pct from taking_part group by year""")
def a30_share_with_override(d):
    flag = F.when(F.col("year").isin(1997), 1.0).otherwise(F.when(F.col("status") == "P", 1.0).otherwise(0.0))
    return d.taking_part.groupBy("year").agg(F.round(100.0 * F.avg(flag), 1).alias("online_pct"))


@query(f"with {TAKING_PART} select person, string_agg(distinct cast(year as varchar), ',' order by cast(year as varchar)) as years from taking_part where year >= 1999 group by person having count(distinct year) >= 2")
def a31_repeaters(d):
    y = d.taking_part.where("year >= 1999").groupBy("person").agg(F.array_sort(F.collect_set("year")).alias("y"))
    return y.where(F.size("y") >= 2).select("person", F.array_join(F.col("y").cast("array<string>"), ",").alias("years"))


@query(f"""with {TAKING_PART}, c as (select series, count(distinct case when year <= 1997 then item end) as early, count(distinct case when year > 1997 then item end) as late from taking_part group by 1)
select *, round(100.0 * early / sum(early) over (), 1) as early_pct, round(100.0 * late / sum(late) over (), 1) as late_pct from c""")
def a32_eras(d):
    return temporal.eras(d.taking_part, "year", 1997, "series", "item")


@query(f"""with {TAKING_PART}, r as (select series, row_number() over (partition by person order by year, item) = 1 as f from taking_part) select series, count(case when f then 1 end) as debut, count(case when not f then 1 end) as again from r group by series""")
def a33_debut_split(d):
    return temporal.debut_split(d.taking_part, "person", ["year", "item"], "series")


@query("""with k as (select l_orderkey, count(distinct l_suppkey) as k from lineitem group by 1) select o_orderpriority as series, count(case when k > 1 then 1 end) as coauthored, count(case when k = 1 then 1 end) as single from orders join k on o_orderkey = l_orderkey group by 1""")
def a34_coauthored(d):
    k = d.lineitem.groupBy("l_orderkey").agg(F.countDistinct("l_suppkey").alias("k"))
    rows = d.orders.join(k, F.col("o_orderkey") == F.col("l_orderkey"))
    return rows.groupBy(F.col("o_orderpriority").alias("series")).agg(F.count(F.when(F.col("k") > 1, 1)).alias("coauthored"), F.count(F.when(F.col("k") == 1, 1)).alias("single"))


@query(f"""with {TAKING_PART}, r as (select series, status, count(*) over (partition by person) as k, (select 0) from taking_part) select status, count(case when k >= 12 then 1 end) as core, count(case when k < 12 then 1 end) as periphery from r group by 1""")
def a35_core_periphery(d):
    k = F.count("*").over(Window.partitionBy("person"))
    rows = d.taking_part.withColumn("k", k)
    return rows.groupBy("status").agg(F.count(F.when(F.col("k") >= 12, 1)).alias("core"), F.count(F.when(F.col("k") < 12, 1)).alias("periphery"))


@query(f"""with {TAKING_PART}, f as (select 'series:' || series as source, 'status:' || status as target, count(*) as value from taking_part group by 1, 2 union all select 'status:' || status, 'year:' || year, count(*) from taking_part group by 1, 2) select * from f where value >= 20""")
def a36_flows(d):
    return agg.flows(d.taking_part, [("series", "status"), ("status", "year")], 20)


@query("""select lang, round(avg(len(string_split_regex(trim(text), '[ \t\n\r]+'))), 3) as words, round(avg(length(text)), 3) as chars, round(avg(case when contains(text, ':') then 1 else 0 end), 4) as colons from documents group by lang""")
def a37_text_averages(d):
    t = F.col("text")
    return d.documents.groupBy("lang").agg(F.round(F.avg(F.size(F.split(F.trim(t), "[ \t\n\r]+"))), 3).alias("words"), F.round(F.avg(F.char_length(t)), 3).alias("chars"),
                                           F.round(F.avg(F.when(t.contains(":"), 1.0).otherwise(0.0)), 4).alias("colons"))


@query("select cast(floor(value / 10) as bigint) as bin, count(*) as n, count(case when event_type = 'click' then 1 end) as clicks from events where value is not null group by 1")
def a38_histogram_matrix(d):
    return d.events.where("value is not null").groupBy(F.floor(F.col("value") / 10).alias("bin")).agg(F.count("*").alias("n"), F.count(F.when(F.col("event_type") == "click", 1)).alias("clicks"))


@query(f"with {TAKING_PART}, {ACTIVITY} select count(case when a_rows > 0 and b_rows = 0 then 1 end) as only_a, count(case when b_rows > 0 and a_rows = 0 then 1 end) as only_b, count(case when a_rows > 0 and b_rows > 0 then 1 end) as both from activity")
def a39_venn(d):
    label = select.membership(F.col("a_rows"), F.col("b_rows"))
    return _activity(d).agg(*[F.count(F.when(label == k, 1)).alias(k) for k in ("only_a", "only_b", "both")])


@query("select (select count(*) from customer) as persons, (select count(*) from orders) as items, (select count(*) from lineitem) as lines, (select cast(min(year(o_orderdate)) as integer) from orders) as first_year, (select count(distinct p_brand) from part) as brands")
def a40_summary(d):
    one = d.customer.agg(F.count("*").alias("persons"))
    for part in (d.orders.agg(F.count("*").alias("items"), F.min(F.year("o_orderdate")).alias("first_year")), d.lineitem.agg(F.count("*").alias("lines")), d.part.agg(F.countDistinct("p_brand").alias("brands"))):
        one = one.crossJoin(F.broadcast(part))  # one row each
    return one


@query("select count(*) as vectors, round(cast(min(list_min(embedding)) as double), 4) as lowest, round(cast(max(list_max(embedding)) as double), 4) as highest, count(case when list_max(embedding) > 0.3 and label = 1 then 1 end) as marked from embeddings")
def a41_nested_summary(d):
    e = F.col("embedding")
    return d.embeddings.agg(F.count("*").alias("vectors"), F.round(F.min(F.array_min(e)).cast("double"), 4).alias("lowest"), F.round(F.max(F.array_max(e)).cast("double"), 4).alias("highest"),
                            F.count(F.when((F.array_max(e) > 0.3) & (F.col("label") == 1), 1)).alias("marked"))


@query("""with c as (select cast(ts as date) as day, event_type as venue, count(*) as n from events group by 1, 2), r as (select *, row_number() over (partition by venue order by n desc, day) as i from c) select venue, cast(day as varchar) as day, n from r where i = 1""")
def a42_venue_days(d):
    c = d.events.groupBy(F.to_date("ts").alias("day"), F.col("event_type").alias("venue")).agg(F.count("*").alias("n"))
    return select.top_per_group(c, ["venue"], [F.col("n").desc(), F.col("day")], 1).select("venue", F.col("day").cast("string").alias("day"), "n")


@query("select conv_id, turn, cast(row_number() over w as integer) as position, count(*) over (partition by conv_id) as total, row_number() over w = 1 as is_first, row_number() over w = count(*) over (partition by conv_id) as is_last from conversations window w as (partition by conv_id order by turn, role, text)")
def w01_positions(d):
    return temporal.positions(d.conversations, "conv_id", ["turn", "role", "text"]).select("conv_id", "turn", "position", "total", "is_first", "is_last")


@query(f"with {TAKING_PART}, r as (select *, row_number() over (partition by person order by year, series) as i from taking_part) select person, year as debut_year, series as debut_value from r where i = 1")
def w02_first_seen(d):
    return temporal.first_seen(d.taking_part, "person", "year", "series")


@query(f"""with {TAKING_PART}, b as (select person from taking_part group by person order by count(*) desc, person limit 5), g as (select person, year from b, (select distinct year from taking_part)),
n as (select person, year, count(*) as n from taking_part group by 1, 2) select g.person, g.year, coalesce(n, 0) as n, cast(sum(coalesce(n, 0)) over (partition by g.person order by g.year) as bigint) as running from g left join n using (person, year)""")
def w03_running_top5(d):
    return temporal.running_totals(d.taking_part, "person", "year", 5)


@query("""with c as (select p_brand, p_type, count(*) as n from part group by 1, 2 having count(*) >= 2), r as (select *, row_number() over (partition by p_brand order by n desc, p_type) as rank from c) select p_brand, p_type, n, cast(rank as integer) as rank from r where rank <= 12""")
def w04_top_per_group(d):
    c = d.part.groupBy("p_brand", "p_type").agg(F.count("*").alias("n")).where("n >= 2")
    return select.top_per_group(c, ["p_brand"], [F.col("n").desc(), F.col("p_type")], 12)


@query(f"with {TAKING_PART}, b as (select person from taking_part group by person order by count(*) desc, person limit 10) select person, year, count(*) as n from taking_part where person in (select person from b) group by 1, 2")
def w05_top_series(d):
    best = d.taking_part.groupBy("person").agg(F.count("*").alias("k")).orderBy(F.col("k").desc(), "person").limit(10)
    return d.taking_part.join(F.broadcast(best), "person", "left_semi").groupBy("person", "year").agg(F.count("*").alias("n"))


@query("""with m as (select o_orderpriority, o_orderstatus, o_orderkey, sha256('seed1|' || o_orderpriority || '|' || o_orderstatus || '|' || o_orderkey) as mark from orders), r as (select *, row_number() over (partition by o_orderpriority, o_orderstatus order by mark) as pick from m)
select o_orderpriority, o_orderstatus, o_orderkey, mark, cast(pick as integer) as pick from r where pick <= 6""")
def w06_stratified_sample(d):
    return resolve.stratified_sample(d.orders, ["o_orderpriority", "o_orderstatus"], "o_orderkey", "seed1", 6).select("o_orderpriority", "o_orderstatus", "o_orderkey", "mark", "pick")


@query("""with b as (select p_partkey, lower(replace(p_type, ' ', '-')) as base, lower(p_brand) as brand from part), s as (select *, case when count(*) over (partition by base) > 1 then base || '-' || brand else base end as s from b),
n as (select *, row_number() over (partition by s order by p_partkey) as n from s) select p_partkey, case when n > 1 then s || '-' || n else s end as slug from n""")
def w07_unique_slugs(d):
    rows = d.part.selectExpr("p_partkey", "lower(replace(p_type, ' ', '-')) as base", "lower(p_brand) as brand")
    return resolve.unique_slugs(rows, "base", ["p_partkey"], F.col("brand")).select("p_partkey", "slug")


@query("""with e as (select c_custkey as k, row_number() over (order by c_custkey) as public_id from customer where c_custkey % 3 = 0), n as (select c_custkey as k, row_number() over (order by c_name, c_custkey) + (select max(public_id) from e) as public_id from customer where c_custkey % 3 <> 0)
select * from e union all select * from n""")
def w08_sticky_ids(d):
    old = resolve.numbered_rows(d.customer.where("c_custkey % 3 = 0").selectExpr("c_custkey as k"), ["k"], "public_id")
    return resolve.sticky_ids(d.customer.selectExpr("c_custkey as k", "c_name"), "k", ["c_name", "k"], old)


@query("""with r as (select conv_id, turn, text, sum(case when role = 'user' then 1 else 0 end) over (partition by conv_id order by turn, role, text rows unbounded preceding) as record, role from conversations)
select conv_id, cast(record as bigint) as record, count(*) as lines, string_agg(text, ' ' order by turn, role, text) as text from r group by 1, 2""")
def w09_segments(d):
    return temporal.segments(d.conversations, "conv_id", ["turn", "role", "text"], F.col("role") == "user", "text")


@query("""select conv_id, turn, role, last_value(case when role = 'user' then turn end ignore nulls) over (partition by conv_id order by turn, role, text rows between unbounded preceding and current row) as asked from conversations""")
def w09_carried(d):
    return temporal.carried(d.conversations, "conv_id", ["turn", "role", "text"], F.when(F.col("role") == "user", F.col("turn")), "asked").select("conv_id", "turn", "role", "asked")


@query("select text, count(*) as n from documents group by text having count(*) > 1")
def w10_duplicates(d):
    from rollcall.operators.quality import duplicated

    return duplicated(d.documents, ["text"])


@query(f"""with {TAKING_PART}, k as (select person, count(*) as x from taking_part group by 1) select person, x, cast(sum(x) over (order by x, person rows unbounded preceding) as bigint) as running from k""")
def w11_cumulative(d):
    k = d.taking_part.groupBy("person").agg(F.count("*").alias("x"))
    return temporal.cumulative(k, ["x", "person"], "x")


@query("""select cast(floor((row_number() over (order by doc_id) - 1) / 50) as bigint) as batch, doc_id from documents where doc_id not in (select doc_id from labels)""")
def k09_batches(d):
    return resolve.batches(d.documents.select("doc_id"), d.labels, "doc_id", 50)


