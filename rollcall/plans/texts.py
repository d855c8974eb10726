"""Scalar text functions and text mining. Expressions keep to what Java and RE2 both read."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollcall.functions import stems
from rollcall.functions import text as tx
from rollcall.functions.tokens import bigrams, counted, tokens
from rollcall.operators import lexical, resolve, select
from rollcall.plans.registry import registry
from rollcall.session import small_batches

QUERIES, SQL, query = registry()

STOP = ("the", "and", "les", "des", "und", "que")
#: Words of a text as SQL: letters only, three or more, no Roman numerals, no stop words.
WORDS = "list_filter(regexp_extract_all(lower(text), '[a-zà-öø-ÿа-яё_]+'), lambda w: length(w) >= 3 and not regexp_matches(w, '^[ivxlcdm]+$') and w not in ('the', 'and', 'les', 'des', 'und', 'que'))"
DOCS = f"docs as (select doc_id, lang, text, {WORDS} as words from documents)"


def _docs(d):
    return d.documents.select("doc_id", "lang", "text", tokens(F.col("text"), stop=STOP).alias("words"))


@query("select doc_id, lower(trim(regexp_replace(translate(text, 'ёЁ', 'еЕ'), '[ \t\r\n]+', ' ', 'g'))) as canonical from documents")
def f01_canonical_text(d):
    return d.documents.select("doc_id", tx.canonical(F.col("text")).alias("canonical"))


@query()
def f01_nfkc(d):
    small_batches(d.spark)
    return d.documents.select("doc_id", F.sha1(tx.nfkc(F.concat(F.lit("ﬁ① "), "text")).cast("binary")).alias("digest"))


@query("select c_custkey, substr(sha1(lower(trim(c_name)) || '|' || c_nationkey || '|'), 1, 10) as h from customer")
def f02_stable_hash(d):
    return d.customer.select("c_custkey", tx.stable_hash([F.col("c_name"), F.col("c_nationkey"), F.lit(None)]).alias("h"))


@query("select c_custkey, case when c_custkey % 50 = 0 then 'PERS_override' else 'PERS_' || substr(sha1(lower(c_name)), 1, 8) end as person_id from customer")
def f03_person_id(d):
    return d.customer.select("c_custkey", F.when(F.col("c_custkey") % 50 == 0, "PERS_override").otherwise(tx.prefixed_id("PERS_", [F.col("c_name")], 8)).alias("person_id"))


#: Names in four layouts from two columns, and the two results.
NAMED = """n as (select c_custkey, c_custkey % 5 as k, c_mktsegment as sur, replace(n_name, ' ', '-') as given, chr(cast(65 + c_custkey % 26 as integer)) as i from customer join nation on c_nationkey = n_nationkey),
r as (select c_custkey, k, case k when 0 then sur || ', ' || given when 1 then given || ' ' || sur when 2 then sur || ' ' || substr(given, 1, 1) || '.' || i || '.' when 3 then sur end as name,
lower(sur) as s, lower(substr(given, 1, 1)) as g, lower(i) as i from n)"""


def _named(d):
    n = d.customer.join(d.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    sur, given, i = F.col("c_mktsegment"), F.replace("n_name", F.lit(" "), F.lit("-")), F.chr((65 + F.col("c_custkey") % 26).cast("int"))
    k = F.col("c_custkey") % 5
    name = (F.when(k == 0, F.concat(sur, F.lit(", "), given)).when(k == 1, F.concat(given, F.lit(" "), sur))
            .when(k == 2, F.concat(sur, F.lit(" "), F.substring(given, 1, 1), F.lit("."), i, F.lit("."))).when(k == 3, sur))
    return n.select("c_custkey", name.alias("name"))


@query(f"with {NAMED} select c_custkey, case k when 0 then s || ' ' || g when 1 then s || ' ' || g when 2 then s || ' ' || g || ' ' || i when 3 then s end as name_key from r")
def f04_name_key(d):
    return _named(d).select("c_custkey", tx.name_key(F.col("name")).alias("name_key"))


@query("""with k as (select c_custkey, lower(c_name) as k from customer), a as (select lower(c_name) as alias, 'group' || c_custkey % 7 as target from customer where c_custkey % 4 = 0)
select c_custkey, case when coalesce(target, k) = 'group3' then 'chosen' else coalesce(target, k) end as person_key from k left join a on alias = k""")
def f05_alias_fold(d):
    a = d.customer.where("c_custkey % 4 = 0").selectExpr("lower(c_name) as alias", "concat('group', c_custkey % 7) as target")
    o = d.spark.createDataFrame([("group3", "chosen")], "alias string, target string")
    return resolve.fold_aliases(d.customer.selectExpr("c_custkey", "lower(c_name) as k"), "k", a, o).select("c_custkey", "person_key")


@query(f"""with {NAMED} select c_custkey, upper(substr(s, 1, 1)) || substr(s, 2) || case when k in (0, 1) then ' ' || upper(g) || '.' when k = 2 then ' ' || upper(g) || '. ' || upper(i) || '.' else '' end as initials from r where k < 4
union all select c_custkey, null from r where k = 4""")
def f06_initials(d):
    return _named(d).select("c_custkey", tx.initials(F.col("name")).alias("initials"))


@query("select p_partkey, case when ends_with(lower(p_name), '1') then 'one' when ends_with(lower(p_name), '0') then 'zero' else 'other' end as label from part")
def f07_suffix_classifier(d):
    return d.part.select("p_partkey", tx.by_suffix(F.col("p_name"), [("1", "one"), ("0", "zero")], "other").alias("label"))


@query("select p_partkey, p_name as title from part")
def f08_clean_title(d):
    noisy = F.concat(F.col("p_name"), F.when(F.col("p_partkey") % 3 == 0, " (Online)").when(F.col("p_partkey") % 3 == 1, " 10:30 – 11.15").otherwise("."))
    return d.part.select("p_partkey", tx.clean_title(noisy).alias("title"))


@query("select p_partkey, 'Study of Sanskrit grammar ' || p_name as title from part")
def f09_canonical_title(d):
    broken = F.concat(F.lit("Stu- dy of SANSKRIT gram- mar "), F.col("p_name"))
    return d.part.select("p_partkey", tx.proper_case(tx.mend_hyphens(broken), ["Sanskrit"]).alias("title"))


@query("select p_partkey, trim(regexp_replace(lower(p_type || ', «' || p_name || '»!'), '[^a-zа-я0-9]+', ' ', 'g')) as norm from part")
def f10_normal_title(d):
    return d.part.select("p_partkey", tx.normal_title(F.concat("p_type", F.lit(", «"), "p_name", F.lit("»!"))).alias("norm"))


@query("select p_partkey, p_name as rest, case when p_size > 20 then p_brand end as part from part")
def f11_leading_affiliation(d):
    got = tx.leading_part(F.when(F.col("p_size") > 20, F.concat(F.lit("("), "p_brand", F.lit(") "), "p_name")).otherwise(F.col("p_name")))
    return d.part.select("p_partkey", got.alias("x")).select("p_partkey", "x.rest", "x.part")


@query("select c_custkey, case when c_mktsegment not in ('BUILDING', 'FURNITURE') then c_mktsegment end as reported from customer")
def f12_reported(d):
    return d.customer.select("c_custkey", tx.null_if_matches(F.concat(F.lit("  "), "c_mktsegment"), ["building", "furni.*", "-+"]).alias("reported"))


@query("select p_partkey, case when contains(lower(p_type), 'steel') then 'metal' when contains(lower(p_type), 'brass') then 'alloy' when contains(lower(p_type), 'a') then 'with a' else 'none' end as label from part")
def f13_first_label(d):
    return d.part.select("p_partkey", tx.first_label(F.col("p_type"), [("steel", "metal"), ("brass", "alloy"), ("a", "with a")], "none").alias("label"))


@query("""with f as (select doc_id, list_filter([case when regexp_matches(lower(text), 'token') then 'secret' end, case when regexp_matches(lower(text), '[0-9]{5}') then 'digits' end, case when regexp_matches(lower(text), 'license') then 'license' end], lambda x: x is not null) as l from documents)
select doc_id, array_to_string(case when len(l) = 0 then ['plain'] when list_contains(l, 'secret') then list_filter(l, lambda x: x <> 'digits') else l end, ',') as labels from f""")
def f14_labels(d):
    found = tx.all_labels(F.col("text"), [("token", "secret"), ("[0-9]{5}", "digits"), ("license", "license")], "plain", {"digits": "secret"})
    return d.documents.select("doc_id", F.array_join(found, ",").alias("labels"))


@query("select page_id, case when contains(lower(url), '.org') then 'org' when contains(lower(url), '.com') then 'com' else 'elsewhere' end as place from pages")
def f15_infer_place(d):
    return d.pages.select("page_id", tx.first_label(F.col("url"), [(".org", "org"), (".com", "com")], "elsewhere").alias("place"))


@query("select n_name, case when regexp_matches(lower(n_name), 'united|kingdom|states') then 'institution' when length(n_name) <= 5 then 'city' else 'unclear' end as kind from nation")
def f16_city_or_institution(d):
    n = F.lower("n_name")
    return d.nation.select("n_name", F.when(n.rlike("united|kingdom|states"), "institution").when(F.char_length("n_name") <= 5, "city").otherwise("unclear").alias("kind"))


@query("select p_partkey from part where regexp_matches(lower(p_name), '[0-9]+1$') or starts_with(p_type, 'S')")
def f17_serialised(d):
    return d.part.where(F.lower("p_name").rlike("[0-9]+1$") | F.col("p_type").startswith("S")).select("p_partkey")


@query("select p_partkey, regexp_replace(regexp_replace(replace(replace(lower('Щука ' || p_name || '/' || p_brand), 'щ', 'shch'), 'ука', 'uka'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') as slug from part")
def f18_slug(d):
    return d.part.select("p_partkey", tx.slug(F.concat(F.lit("Щука "), "p_name", F.lit("/"), "p_brand"), {"щ": "shch", "у": "u", "к": "k", "а": "a"}).alias("slug"))


@query("""with t as (select o_orderkey as k, cast(o_orderkey % 10 as varchar) as h, lpad(cast(o_orderkey % 60 as varchar), 2, '0') as m, cast(10 + o_orderkey % 14 as varchar) as z from orders)
select k, case when k % 4 = 3 then null else '0' || h || ':' || m || ' – ' || z || ':' || m end as interval from t""")
def f19_time_interval(d):
    k = F.col("o_orderkey")
    h, m, z = (k % 10).cast("string"), F.lpad((k % 60).cast("string"), 2, "0"), (10 + k % 14).cast("string")
    raw = F.when(k % 4 == 0, F.concat(h, F.lit("."), m, F.lit(" – "), z, F.lit("."), m)).when(k % 4 == 1, F.concat(F.lit(" "), h, F.lit(":"), m, F.lit("—"), z, F.lit(":"), m))
    raw = raw.when(k % 4 == 2, F.concat(F.lit("0"), h, F.lit("."), m, F.lit("-"), z, F.lit(":"), m, F.lit(" "))).otherwise(F.concat(F.lit("from "), h))
    return d.orders.select(k.alias("k"), tx.time_interval(raw).alias("interval"))


@query("select o_orderkey, case when o_orderkey % 9 = 0 then 'Not specified' else dayname(o_orderdate) end as day from orders")
def f20_weekday(d):
    raw = F.when(F.col("o_orderkey") % 9 == 0, "soon").otherwise(F.col("o_orderdate").cast("date").cast("string"))
    return d.orders.select("o_orderkey", tx.weekday(raw).alias("day"))


@query("select o_orderkey, cast(year(o_orderdate) as integer) as year, case when o_orderkey % 3 = 0 then '2000-01-01' else strftime(o_orderdate, '%Y-%m-%d') end as date, o_orderkey % 3 <> 0 as exact from orders")
def f21_dates(d):
    shown = F.when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "d.M.yyyy")).when(F.col("o_orderkey") % 3 == 2, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("unknown")
    got = tx.dated(shown, F.lit("2000-01-01").cast("date"))
    return d.orders.select("o_orderkey", tx.year_in(F.concat(F.lit("in "), F.date_format("o_orderdate", "yyyy"), F.lit("."))).alias("year"), got["date"].cast("string").alias("date"), got["exact"].alias("exact"))


@query("""select o_orderkey as k, case when o_orderkey % 3 = 0 and month(o_orderdate) not in (5, 6) then null when o_orderkey % 3 = 2 then null
else '2021-' || strftime(case when month(o_orderdate) = 2 and day(o_orderdate) = 29 then date '2021-02-28' else o_orderdate end, '%m-%d') end as day from orders""")
def f22_calendar_date(d):
    k, day = F.col("o_orderkey"), F.date_format("o_orderdate", "d")
    leap = (F.month("o_orderdate") == 2) & (F.dayofmonth("o_orderdate") == 29)
    day = F.when(leap, "28").otherwise(day)
    month = F.when(F.month("o_orderdate") == 5, "мая").when(F.month("o_orderdate") == 6, "ИЮНЯ").otherwise("другого месяца")
    line = F.when(k % 3 == 0, F.concat(day, F.lit(" "), month, F.lit(", вторник"))).when(k % 3 == 1, F.concat(day, F.date_format("o_orderdate", ".MM"), F.lit(" утро"))).otherwise("без даты")
    return d.orders.select(k.alias("k"), tx.month_day(line, F.lit(2021), {"мая": 5, "июня": 6}).cast("string").alias("day"))


@query("select p_brand, count(*) as n, case when count(*) <> 0 then round(100.0 * count(case when p_size > 25 then 1 end) / count(*), 1) else 0.0 end as pct from part group by 1")
def f23_pct(d):
    from rollcall.operators.aggregates import pct

    return d.part.groupBy("p_brand").agg(F.count("*").alias("n"), pct(F.count(F.when(F.col("p_size") > 25, 1)), F.count("*")).alias("pct"))


@query("""with t as (select doc_id, trim(regexp_replace(text, '[ \t\r\n]+', ' ', 'g')) as t from documents) select doc_id, case when length(t) <= 60 then t else regexp_replace(substr(t, 1, 60), '[ \t\n\r]+[^ \t\n\r]*$', '') || '…' end as short from t""")
def f24_shorten(d):
    return d.documents.select("doc_id", tx.shorten(F.col("text"), 60).alias("short"))


@query("""select c_custkey, '0000-0002-' || lpad(cast(c_custkey % 10000 as varchar), 4, '0') || '-' || case when c_custkey % 3 > 0 then '123X' end as orcid, case when c_custkey % 4 > 0 then 'Q' || c_custkey end as wikidata,
case when c_custkey % 5 > 0 then cast(c_custkey + 10 as varchar) end as viaf, case when c_custkey % 2 > 0 then '0' || lpad(cast(c_custkey % 1000000 as varchar), 6, 'a') || '07' end as ror from customer""")
def f25_identifiers(d):
    k = F.col("c_custkey")
    orcid = F.concat(F.when(k % 2 == 0, "https://orcid.org/").otherwise(" "), F.lit("0000-0002-"), F.lpad((k % 10000).cast("string"), 4, "0"), F.when(k % 3 > 0, "-123x").otherwise("-12"))
    wikidata = F.concat(F.when(k % 2 == 0, "https://www.wikidata.org/wiki/").otherwise(""), F.when(k % 4 > 0, "q").otherwise("Q0"), k)
    viaf = F.concat(F.lit("https://viaf.org/viaf/"), F.when(k % 5 == 0, "0").otherwise(""), (k + 10).cast("string"))
    ror = F.concat(F.lit("https://ror.org/0"), F.lpad((k % 1000000).cast("string"), 6, "a"), F.when(k % 2 > 0, "07").otherwise("7"))
    raw = {"orcid": orcid, "wikidata": wikidata, "viaf": viaf, "ror": ror}
    return d.customer.select("c_custkey", *[tx.identifier(c, kind).alias(kind) for kind, c in raw.items()])


@query("select page_id, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g')) as plain, replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') as safe from pages")
def f26_html(d):
    return d.pages.select("page_id", tx.strip_tags(F.col("html")).alias("plain"), tx.escape_html(F.col("url")).alias("safe"))


@query("select p_partkey, 'A. ' || p_type || '|B. ' || p_brand || ', jr|C. ' || p_type as names from part")
def f27_coauthors(d):
    packed = F.concat(F.lit(" A. "), "p_type", F.lit(", B. "), "p_brand", F.lit(", jr , C. "), "p_type")
    return d.part.select("p_partkey", F.array_join(tx.coauthors(packed), "|").alias("names"))


#: Surnames and titles of letters only, from numbers.
LETTERED = "case when true then chr(cast(65 + p_partkey % 26 as integer)) || 'en' || chr(cast(97 + p_size % 26 as integer)) || 'ov' end"


def _lettered():
    return F.concat(F.chr((65 + F.col("p_partkey") % 26).cast("int")), F.lit("en"), F.chr((97 + F.col("p_size") % 26).cast("int")), F.lit("ov"))


@query(f"""with s as (select p_partkey, p_partkey % 6 as k, {LETTERED} as s, lower(p_type) as t from part)
select p_partkey, case k when 0 then s || ' Ivan|Petrov Oleg' when 1 then s || ' A. B.|' || s || ' C.' when 2 then 'A. B. ' || s when 3 then s || ' Ivan Petrovich' when 4 then 'A. ' || s || '|B. ' || s else '' end as speakers,
case k when 0 then 'Riga|Kyiv' when 1 then 'Riga|Riga' when 3 then 'Riga' else '' end as places, case when k = 5 then 'opening ' || t else 'On ' || t || ' (1814–1875) of I. P. Minaev' end as title from s""")
def f28_talk_lines(d):
    k, s, title = F.col("p_partkey") % 6, _lettered(), F.concat(F.lit("On "), F.lower("p_type"), F.lit(" (1814–1875) of I. P. Minaev."))
    line = F.when(k == 0, F.concat(s, F.lit(" Ivan (Riga). Petrov Oleg (Kyiv). "), title)).when(k == 1, F.concat(s, F.lit(" A. B., "), s, F.lit(" C. (Riga). "), title))
    line = line.when(k == 2, F.concat(F.lit("Prof. A. B. "), s, F.lit(". "), title)).when(k == 3, F.concat(s, F.lit(" Ivan Petrovich  (Riga) "), title))
    line = line.when(k == 4, F.concat(F.lit("A. "), s, F.lit(", B. "), s, F.lit(". "), title)).otherwise(F.concat(F.lit("opening "), F.lower("p_type")))
    got = d.part.select("p_partkey", tx.talk_line(line).alias("x"))
    return got.select("p_partkey", F.array_join("x.speakers", "|").alias("speakers"), F.array_join("x.places", "|").alias("places"), "x.title")


@query(f"""with s as (select p_partkey, {LETTERED} as s, lower(p_type) as t, p_brand as b from part)
select p_partkey, unnest(case p_partkey % 3 when 0 then ['10:00 Smith ' || t, '11.30 Jones ' || b] when 1 then [s || ' Ivan (Riga). On ' || t || '.', s || ' Oleg Petrovich (Kyiv). On ' || b]
else ['A. B. ' || s || ' (Riga). On ' || t || ' of I. P. Minaev (MAE)', 'C. ' || s || ' (Гамбург). On ' || b] end) as line from s""")
def f29_packed_lines(d):
    k, s, t = F.col("p_partkey") % 3, _lettered(), F.lower("p_type")
    packed = F.when(k == 0, F.concat(F.lit("10:00 Smith "), t, F.lit("  11.30 Jones "), "p_brand"))
    packed = packed.when(k == 1, F.concat(s, F.lit(" Ivan (Riga). On "), t, F.lit("."), s, F.lit(" Oleg Petrovich (Kyiv). On "), "p_brand"))
    packed = packed.otherwise(F.concat(F.lit("A. B. "), s, F.lit(" (Riga). On "), t, F.lit(" of I. P. Minaev (MAE) C. "), s, F.lit(" (Гамбург). On "), "p_brand"))
    return d.part.select("p_partkey", F.explode(tx.packed_lines(packed)).alias("line"))


@query(f"""with s as (select p_partkey as k, {LETTERED} as s, lower(p_type) as t from part)
select k, unnest([1, 2, 3]) as entry, unnest([s || ' Ivan (Riga). On ' || t || ' and its history.', 'Session 2', 'A. B. ' || s || ' (Kyiv). More']) as line from s""")
def w09_wrapped_lines(d):
    from rollcall.operators.temporal import wrapped_entries

    s, t = _lettered(), F.lower("p_type")
    lines = F.array(F.concat(s, F.lit(" Ivan")), F.concat(F.lit("(Riga). On "), t), F.lit("and its history. "), F.lit(" "), F.lit("Session 2"), F.lit("A. B."), F.concat(s, F.lit(" (Kyiv). More")))
    rows = d.part.select(F.col("p_partkey").alias("k"), F.posexplode(lines).alias("n", "line"))
    return wrapped_entries(rows, "k", "n", "line", tx.STARTS, tx.HEADING).select("k", F.col("entry").cast("int").alias("entry"), "line")


@query("""select c_custkey, cast(least(1.0, (case when c_mktsegment = 'BUILDING' then 0.5 else 0.0 end) + (case when c_acctbal > 5000 then 0.4 else 0.0 end) + (case when c_nationkey < 10 then 0.3 else 0.0 end)) as double) as score,
case when c_mktsegment = 'BUILDING' and c_acctbal > 5000 then 95 when c_mktsegment = 'BUILDING' then 80 when c_acctbal > 5000 then 60 else 30 end as tier from customer""")
def f30_scores(d):
    a, b, c = F.col("c_mktsegment") == "BUILDING", F.col("c_acctbal") > 5000, F.col("c_nationkey") < 10
    return d.customer.select("c_custkey", tx.capped_score([(a, 0.5), (b, 0.4), (c, 0.3)]).alias("score"), tx.tier([(a & b, 95), (a, 80), (b, 60)], 30).alias("tier"))


@query("select c_custkey, case when 1950 + c_custkey % 90 - 25 between 1930 and 1990 then cast(1950 + c_custkey % 90 - 25 as integer) end as born from customer")
def f31_age_proxy(d):
    return d.customer.select("c_custkey", tx.age_proxy((F.lit(1950) + F.col("c_custkey") % 90).cast("int"), 25, 1930, 1990).alias("born"))


@query()
def f32_sequence_ratio(d):
    from rollcall.operators.joins import ratio

    return d.part.select("p_partkey", F.round(ratio(F.col("p_name"), F.col("p_type")), 6).alias("ratio"))


@query("select event_id, cast(json_extract_string(props, '$.k') as bigint) as k, json_extract_string(props, '$.missing') as missing from events")
def f33_json_access(d):
    return d.events.select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"), F.get_json_object("props", "$.missing").alias("missing"))


@query("select c_custkey, cast(floor(c_acctbal) as bigint) as whole, round(c_acctbal, 1) as rounded, substr(c_name, 1, 8) as head, try_cast(substr(c_name, 10) as bigint) as number from customer")
def f34_casts(d):
    return d.customer.select("c_custkey", F.floor("c_acctbal").alias("whole"), F.round("c_acctbal", 1).alias("rounded"), F.substring("c_name", 1, 8).alias("head"), F.substring("c_name", 10, 100).try_cast("long").alias("number"))


@query("select o_orderkey, case o_orderstatus when 'F' then 'final' when 'O' then 'open' else 'other' end as state from orders")
def f35_remap(d):
    return d.orders.select("o_orderkey", tx.remap(F.col("o_orderstatus"), {"F": "final", "O": "open"}, "other").alias("state"))


@query("select o_orderkey, coalesce(o_orderstatus in ('F', 'O') and o_orderpriority in ('1-URGENT', '5-LOW') and o_totalprice between 1000 and 200000, false) as valid from orders")
def f36_valid_rows(d):
    return d.orders.select("o_orderkey", tx.valid_row({"o_orderstatus": ["F", "O"], "o_orderpriority": ["1-URGENT", "5-LOW"]}, "o_totalprice", 1000, 200000).alias("valid"))


@query(f"select doc_id, array_to_string({WORDS}, ' ') as words from documents")
def t01_tokens(d):
    return d.documents.select("doc_id", F.array_join(tokens(F.col("text"), stop=STOP), " ").alias("words"))


def _stem_sql() -> str:
    """DISTINCT words of ``docs`` with their stems, as SQL."""
    found = " ".join(f"when '{k}' then regexp_extract(term, '{stems.pattern(k)}', 1)" for k in stems.ENDINGS)
    new = " ".join(f"when lang = '{k}' and ending = '{a}' then '{b}'" for k in stems.ENDINGS for a, b in stems.endings(k).items() if b)
    return f"""terms as (select distinct lang, unnest(words) as term from docs where lang is not null), ends as (select *, coalesce(case lang {found} end, '') as ending from terms),
stems as (select lang, term, substr(term, 1, length(term) - length(ending)) || case {new} else '' end as stem from ends)"""


@query(f"with {DOCS}, {_stem_sql()} select lang, term, stem from stems")
def t01_stems(d):
    return stems.stem_table(_docs(d).where("lang is not null").select("lang", F.explode("words").alias("term")), "lang", "term")


@query(f"""with {DOCS}, {_stem_sql()}, k as (select lang, doc_id, unnest(words) as term from docs), c as (select lang, stem, doc_id, count(*) as k from k join stems using (lang, term) group by 1, 2, 3),
w as (select lang, stem, count(*) as words from stems group by 1, 2) select lang, stem, cast(sum(k) as bigint) as tf, count(*) as df, any_value(words) as words from c join w using (lang, stem) group by 1, 2""")
def t03_stem_frequencies(d):
    return lexical.stem_frequencies(_docs(d), "doc_id", "lang", "words")


@query(f"""with {DOCS}, p as (select doc_id, unnest(range(1, len(words))) as i, words from docs where len(words) > 1) select doc_id, words[i] || ' ' || words[i + 1] as bigram, count(*) as n from p where words[i] <> words[i + 1] group by 1, 2""")
def t02_bigrams(d):
    pairs = lexical.per_key(_docs(d).select("doc_id", bigrams(F.col("words")).alias("pairs")), ["doc_id"], "pairs")
    return pairs.select("doc_id", F.explode(counted(F.col("pairs"))).alias("c")).select("doc_id", F.col("c.term").alias("bigram"), "c.n")


@query(f"""with {DOCS}, w as (select lang, doc_id, unnest(words) as term from docs), k as (select lang, term, doc_id, count(*) as k from w group by 1, 2, 3),
c as (select case when grouping(lang) = 1 then 'ALL' else lang end as lang, term, sum(k) as tf, count(*) as df from k group by grouping sets ((lang, term), (term))),
s as (select case when grouping(lang) = 1 then 'ALL' else lang end as lang, count(*) as nd, sum(len(words)) as nw from docs group by rollup (lang))
select lang, term, cast(tf as bigint) as tf, df, round(100.0 * df / nd, 2) as doc_pct, round(1000.0 * tf / nw, 2) as per_1000 from c join s using (lang)""")
def t03_term_frequencies(d):
    return lexical.term_frequencies(_docs(d), "doc_id", "lang", "words")


@query(f"""with {DOCS}, p as (select lang, doc_id, unnest(range(1, len(words))) as i, words from docs where len(words) > 1), b as (select lang, words[i] || ' ' || words[i + 1] as bigram, count(*) as n from p where words[i] <> words[i + 1] group by 1, 2 having count(*) >= 2),
s as (select lang, count(*) as nd from docs group by 1) select lang, bigram, n, round(100.0 * n / nd, 2) as per_100 from b join s using (lang)""")
def t04_bigram_frequencies(d):
    docs = _docs(d)
    b = docs.select("lang", F.explode(bigrams(F.col("words"))).alias("bigram")).groupBy("lang", "bigram").agg(F.count("*").alias("n")).where("n >= 2")
    return b.join(docs.groupBy("lang").agg(F.count("*").alias("nd")), "lang").select("lang", "bigram", "n", F.round(100.0 * F.col("n") / F.col("nd"), 2).alias("per_100"))


def _contrast(side: str) -> str:
    return f"""with {DOCS}, w as (select doc_id, {side} as s, unnest(words) as term from docs where {side} is not null), k as (select term, doc_id, s, count(*) as k from w group by 1, 2, 3),
n as (select term, sum(case when s then k else 0 end) as z, sum(case when not s then k else 0 end) as r, count(*) as df from k group by 1), t as (select sum(z) as nz, sum(r) as nr from n)
select term, cast(z as bigint) as z, cast(r as bigint) as r, df, round(ln((z + 0.5) / (nz - z + 0.5)) - ln((r + 0.5) / (nr - r + 0.5)), 4) as log_odds, round(sqrt(1 / (z + 0.5) + 1 / (r + 0.5)), 4) as se,
round((ln((z + 0.5) / (nz - z + 0.5)) - ln((r + 0.5) / (nr - r + 0.5))) / sqrt(1 / (z + 0.5) + 1 / (r + 0.5)), 4) as z_score from n, t where df >= 3"""


@query(_contrast("case when lang = 'en' then true when lang = 'de' then false end"))
def t05_log_odds(d):
    return lexical.log_odds(_docs(d), "doc_id", "words", F.when(F.col("lang") == "en", True).when(F.col("lang") == "de", False))


@query(_contrast("doc_id < 500"))
def t06_period_trend(d):
    return lexical.log_odds(_docs(d), "doc_id", "words", F.col("doc_id") < 500)


@query(f"""with {DOCS}, w as (select distinct doc_id, unnest(words) as term from docs), f as (select term, count(*) as df from w group by 1 having count(*) >= 3 order by 2 desc, 1 limit 120), k as (select doc_id, term, df from w join f using (term)),
p as (select a.term as a, b.term as b, a.df as da, b.df as db, count(*) as c from k a join k b on a.doc_id = b.doc_id and a.term < b.term group by 1, 2, 3, 4 having count(*) >= 3)
select a, b, c, round(ln(c * (select count(*) from docs) / (da * db)), 4) as pmi from p order by c desc, a, b limit 250""")
def t07_co_occurrence(d):
    return lexical.co_occurrence(_docs(d), "doc_id", "words")


@query(f"""with {DOCS}, w as (select lang, unnest(words) as term from docs), c as (select lang, term, count(*) as n from w group by 1, 2 having count(*) >= 2), r as (select *, row_number() over (partition by lang order by n desc, term) as rank from c) select lang, term, n, cast(rank as integer) as rank from r where rank <= 12""")
def t08_top_terms(d):
    return _top_terms(d.documents, 12)


def _top_terms(documents, n):
    c = documents.select("doc_id", "lang", "text", tokens(F.col("text"), stop=STOP).alias("words")).select("lang", F.explode("words").alias("term")).groupBy("lang", "term").agg(F.count("*").alias("n")).where("n >= 2")
    return select.top_per_group(c, ["lang"], [F.col("n").desc(), F.col("term")], n)


@query(f"""with {DOCS}, s as (select doc_id, len(list_intersect(words, ['for', 'that', 'with'])) + case when regexp_matches(lower(text), 'tion') then 2 else 0 end as x, len(list_intersect(words, ['pour', 'est', 'pas'])) + case when regexp_matches(lower(text), 'eau') then 2 else 0 end as y from docs)
select doc_id, case when x > y then 'left' when y > x then 'right' else 'even' end as side from s""")
def t09_two_sides(d):
    side = lexical.two_sides("words", "text", (["for", "that", "with"], "tion"), (["pour", "est", "pas"], "eau"), ("left", "right"), "even")
    return _docs(d).select("doc_id", side.alias("side"))


@query(f"""with {DOCS}, m as (select doc_id, unnest(list_filter([case when len(list_intersect(words, ['that', 'with'])) >= 2 or regexp_matches(lower(text), 'herea') then 'north' end, case when len(list_intersect(words, ['pour', 'dans'])) >= 2 then 'west' end, case when regexp_matches(lower(text), '[0-9]{{4}}') then 'dated' end], lambda x: x is not null)) as label from docs)
select label, count(*) as n from m group by 1""")
def t10_micro_series(d):
    w = F.col("words")
    has = lambda *m: F.size(F.array_intersect(w, F.array(*map(F.lit, m)))) >= 2
    from rollcall.operators.aggregates import in_scopes

    return in_scopes(_docs(d), {"north": has("that", "with") | F.lower("text").rlike("herea"), "west": has("pour", "dans"), "dated": F.lower("text").rlike("[0-9]{4}")}).groupBy(F.col("scope").alias("label")).agg(F.count("*").alias("n"))


@query("""with l as (select doc_id, unnest(case when regexp_matches(lower(text), 'license|token|[#%&]{3}') then list_filter([case when regexp_matches(lower(text), 'license') then 'license' end, case when regexp_matches(lower(text), 'token') then 'secret' end, case when regexp_matches(lower(text), '[#%&]{3}') then 'junk' end], lambda x: x is not null) else ['rest'] end) as label from documents)
select label, count(*) as n from l group by 1""")
def t11_contexts(d):
    found = tx.all_labels(F.col("text"), [("license", "license"), ("token", "secret"), ("[#%&]{3}", "junk")], "rest")
    return d.documents.select(F.explode(found).alias("label")).groupBy("label").agg(F.count("*").alias("n"))


CODES = [("english", ("[ .]the ", "[ .]and ", "tion")), ("french", ("[ .]les ", "eau", "ment")), ("german", ("[ .]und ", "sch", "ung"))]


def _hits(patterns):
    return " + ".join(f"case when regexp_matches(lower(text), '{p}') then 1 else 0 end" for p in patterns)


@query(f"""with h as (select doc_id, {", ".join(f"{_hits(p)} as h{i}" for i, (_, p) in enumerate(CODES))} from documents),
s as (select doc_id, list_sort([{{'n': -h0, 'i': 0, 'c': 'english'}}, {{'n': -h1, 'i': 1, 'c': 'french'}}, {{'n': -h2, 'i': 2, 'c': 'german'}}]) as r from h)
select doc_id, case when r[1].n < 0 then r[1].c end as code, cast(-r[1].n as integer) as hits, cast(case when r[1].n < 0 then round(least(1.0, 0.4 + 0.3 * -r[1].n + 0.3 * (r[2].n - r[1].n)), 2) else 0.0 end as double) as confidence,
case when r[1].n < 0 then round(least(1.0, 0.4 + 0.3 * -r[1].n + 0.3 * (r[2].n - r[1].n)), 2) else 0.0 end < 0.5 as review from s""")
def t12_rule_coding(d):
    return lexical.rule_coding(d.documents, "text", CODES).select("doc_id", "code", "hits", "confidence", "review")


@query("""select d.doc_id, case when l.doc_id is not null then 'q' || l.quality when d.lang = 'en' then 'x' else 'y' end as code, cast(case when l.doc_id is not null then 0.5 + l.toxic else 0.8 end as double) as confidence, case when l.doc_id is not null then 'b' else 'a' end as source,
(case when l.doc_id is not null then 0.5 + l.toxic else 0.8 end) < 0.6 as uncertain from documents d left join labels l on d.doc_id = l.doc_id""")
def t13_merge_codes(d):
    a = d.documents.select("doc_id", F.col("lang").alias("code"), F.lit(0.8).alias("confidence"))
    b = d.labels.selectExpr("doc_id", "concat('q', quality) as code", "0.5D + toxic as confidence")
    return lexical.merge_codes(a, b, "doc_id", "code", "confidence", tx.remap(F.col("code"), {"en": "x"}, "y"))


@query("""select doc_id, case lang when 'en' then 'germanic' when 'de' then 'germanic' else 'romance' end as public, case when n_chars < 500 then 'short' when n_chars <= 3000 then 'middle' else 'long' end as scale, (select count(*) from documents) = (select count(distinct doc_id) from documents) as complete from documents""")
def t14_axes(d):
    gate = d.documents.agg((F.count("*") == F.countDistinct("doc_id")).alias("complete"))
    return d.documents.crossJoin(F.broadcast(gate)).select("doc_id", tx.remap(F.col("lang"), {"en": "germanic", "de": "germanic"}, "romance").alias("public"),
                                                            select.ladder(F.col("n_chars"), [(499, "short"), (3000, "middle")], "long").alias("scale"), "complete")


@query("""with w as (select unnest(regexp_extract_all(lower(text), '[a-zà-öø-ÿ]{4,}')) as term from documents) select term, count(*) as n from w where term not in ('that', 'with') group by 1 order by n desc, term limit 60""")
def t15_word_cloud(d):
    w = d.documents.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-zà-öø-ÿ]{4,})"), F.lit(1))).alias("term")).where("term not in ('that', 'with')")
    return w.groupBy("term").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "term").limit(60)


TFIDF = """tf as (select doc_id, term, count(*) as tf from (select doc_id, unnest(words) as term from docs) group by 1, 2), nd as (select count(*) as n from docs),
df as (select term, count(*) as df from tf group by 1 having count(*) >= 2 and count(*) <= 0.9 * (select n from nd)), w as (select doc_id, term, tf * (ln((1.0 + n) / (1.0 + df)) + 1) as w from tf join df using (term), nd),
v as (select doc_id, term, w / sqrt(sum(w * w) over (partition by doc_id)) as weight from w)"""


@query(f"""with {DOCS}, {TFIDF}, r as (select *, row_number() over (partition by doc_id order by round(weight, 9) desc, term) as rank from v) select doc_id, term, round(weight, 5) as weight, cast(rank as integer) as rank from r where rank <= 3""")
def t16_tf_idf_top3(d):
    v = lexical.tf_idf(_docs(d), "doc_id", "words")
    return select.top_per_group(v, ["doc_id"], [F.round("weight", 9).desc(), F.col("term")], 3).withColumn("weight", F.round("weight", 5))


@query()
def t17_topics(d):
    from pyspark.ml.clustering import LDA
    from pyspark.ml.feature import HashingTF

    # words are hashed to so many features, so what the driver holds does not grow with the words
    counts = HashingTF(inputCol="words", outputCol="features", numFeatures=1 << 14).transform(_docs(d))
    model = LDA(k=6, maxIter=5, seed=42, featuresCol="features").fit(counts)
    from pyspark.ml.functions import vector_to_array

    mix = vector_to_array(F.col("topicDistribution"))
    return model.transform(counts).select("doc_id", (F.array_position(mix, F.array_max(mix)) - 1).alias("topic"), F.round(F.array_max(mix), 4).alias("share"))


@query()
def t17_nmf_topics(d):
    return lexical.document_topics(_docs(d), "doc_id", "words")


@query(f"""with {DOCS}, {TFIDF}, s as (select q.doc_id as query_id, d.doc_id as doc_id, round(sum(q.weight * d.weight), 4) as score from v q join v d using (term) where q.doc_id % 50 = 0 and d.doc_id <> q.doc_id group by 1, 2 having round(sum(q.weight * d.weight), 4) > 0),
r as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from s) select query_id, doc_id, score, cast(rank as integer) as rank from r where rank <= 3""")
def t18_query_cosine(d):
    return lexical.similar_documents(_docs(d), "doc_id", "words", lambda i: i % 50 == 0, "query_id", 3)


@query(f"""with {DOCS}, {TFIDF}, s as (select q.doc_id as query_id, d.doc_id as doc_id, round(sum(q.weight * d.weight), 4) as score from v q join v d using (term) where q.doc_id % 50 = 0 and d.doc_id <> q.doc_id group by 1, 2 having round(sum(q.weight * d.weight), 4) > 0.5),
r as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from s) select query_id, doc_id, score, cast(rank as integer) as rank from r where rank <= 3""")
def t18_close_documents(d):
    return lexical.similar_documents(_docs(d), "doc_id", "words", lambda i: i % 50 == 0, "query_id", 3, least=0.5)


@query("""with q as (select vec_id as query_id, embedding as a from embeddings where vec_id % 50 = 0), s as (select query_id, vec_id, round(list_inner_product(cast(a as double[]), cast(embedding as double[])), 5) as score from q join embeddings on vec_id <> query_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) select query_id, vec_id, score, cast(rank as integer) as rank from r where rank <= 3""")
def t18_dense_similarity(d):
    q = d.embeddings.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    return lexical.nearest_vectors(q, d.embeddings, "query_id", "vec_id", "embedding", 3)


@query()
def t19_corpus_key(d):
    from rollcall.sources.sinks import corpus_key

    return corpus_key(d.documents, ["doc_id", "text"])


@query(SQL["t08_top_terms"])
def t19_result_cache(d):
    from rollcall.store import Store

    return Store(d.spark).get("top_terms", {"documents": d.documents.select("doc_id", "lang", "text")}, _top_terms, {"n": 12})
