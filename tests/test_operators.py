"""Small cases by hand, and properties that hold for any input."""

import math
import random

import pytest
from pyspark.sql import functions as F

from rollcall import sources
from rollcall.functions import text as tx
from rollcall.operators import aggregates, graph, joins, lexical, resolve, stats, temporal
from rollcall.sources import sinks
from rollcall.streaming import events


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("x")).first().x


def test_text_functions(spark):
    assert one(spark, "  Ёлка \n Б ", tx.canonical) == "елка б"
    assert one(spark, "9.05-10.00", tx.time_interval) == "09:05 – 10:00"
    assert one(spark, "Of gram- mar (Zoom) 10:30.", lambda c: tx.mend_hyphens(tx.clean_title(c))) == "Of grammar"
    assert one(spark, None, tx.name_key) is None
    assert one(spark, "https://orcid.org/0000-0002-1825-009x", lambda c: tx.identifier(c, "orcid")) == "0000-0002-1825-009X"


def test_hash_ignores_layout(spark):
    a, b = (one(spark, v, lambda c: tx.stable_hash([c, F.lit(7)])) for v in ("A  b", " a b "))
    assert a == b and len(a) == 10


def test_quartiles_are_exclusive(spark):
    df = spark.createDataFrame([("x", float(v)) for v in (20, 30, 40, 50, 70)] + [("y", 1.0), ("y", 3.0)], "g string, v double")
    got = {r.g: (r.q1, r.median, r.q3) for r in aggregates.distribution(df, ["g"], "v").collect()}
    assert got == {"x": (25, 40, 60), "y": (1, 2, 3)}


def test_gini(spark):
    df = spark.createDataFrame([("same", 3)] * 4 + [("one", x) for x in (0, 0, 0, 9)] + [("none", 0)], "g string, v int")
    assert {r.g: r.gini for r in aggregates.gini(df, ["g"], "v").collect()} == {"same": 0.0, "one": 0.75, "none": 0.0}


def test_spans(spark):
    rows = spark.createDataFrame([("p", 2000, None), ("p", 2001, None), ("p", 2001, "Other"), ("p", 2015, None), ("q", 2000, None)], "person string, year int, seen string")
    spans = spark.createDataFrame([("p", 1999, 2001, "Uni", 1), ("p", 2010, None, "Institute", 2)], "person string, start int, end int, org string, o int")
    at = joins.valid_at(rows, spans, "person", "year", "org", "o").withColumn("s", F.when(F.col("org") == "Institute", 2010).otherwise(1999))
    got = {(r.person, r.year, r.seen): (r.value, r.basis) for r in joins.public_value(at, "seen", "org", "s", "span_end", "year").collect()}
    assert got == {("p", 2000, None): ("Uni", "verified"), ("p", 2001, None): ("Uni", "verified"), ("p", 2001, "Other"): ("Other", "programme"),
                   ("p", 2015, None): ("Institute (?)", "inferred_continuation"), ("q", 2000, None): (None, None)}


def test_ids_never_move(spark):
    old = spark.createDataFrame([("b", 1), ("c", 2)], "k string, public_id int")
    df = spark.createDataFrame([(x,) for x in "abcd"], "k string")
    assert {r.k: r.public_id for r in resolve.sticky_ids(df, "k", ["k"], old).collect()} == {"b": 1, "c": 2, "a": 3, "d": 4}


def test_numbering_across_partitions(spark):
    r = random.Random(1)
    df = spark.createDataFrame([(r.random(), i) for i in range(2000)], "x double, i int").repartition(7)
    got = [(x.x, x.number) for x in resolve.numbered_rows(df, ["x", "i"]).collect()]
    assert [n for _, n in sorted(got)] == list(range(1, 2001))


def test_survival_starts_full(spark):
    df = spark.createDataFrame([("s", y, p) for p in range(20) for y in range(2000 + p % 3, 2005)], "series string, year int, person int")
    assert all(r.survival_pct == 100 for r in temporal.cohort_survival(df, "series", "year", "person").where("years_since = 0").collect())


def test_fractions_add_up(spark):
    df = spark.createDataFrame([(1, "a", "x"), (1, "b", "x"), (1, "b", "y"), (2, "a", "y")], "item int, author string, org string")
    got = {r.org: (r.simple_count, r.fractional_count) for r in aggregates.fractional(df, "item", "author", "org").collect()}
    assert got == {"x": (1, 0.75), "y": (2, 1.25)}


def test_betweenness(spark):
    star = spark.createDataFrame([(0, i) for i in range(1, 6)], "a long, b long")
    got = {r.node: r.betweenness for r in graph.betweenness(star).collect()}
    assert got == {0: 1.0} | dict.fromkeys(range(1, 6), 0.0)


def test_betweenness_beyond_the_limit(spark):
    r = random.Random(2)
    edges = spark.createDataFrame([(r.randrange(14), r.randrange(14)) for _ in range(22)] + [(20, 21), (21, 22)], "a long, b long")
    small, large = ({x.node: x.betweenness for x in graph.betweenness(edges, limit, 5).collect()} for limit in (100, 0))
    assert small == large and max(small.values()) > 0


def test_session_pairs_have_two_modes(spark):
    df = spark.createDataFrame([("s", "a", 1), ("s", "b", 1), ("s", "c", 2)], "session string, person string, talk int")
    pairs = lambda **k: {(r.a, r.b) for r in graph.co_presence(df, "session", "person", **k).collect()}
    assert pairs() == {("a", "b"), ("a", "c"), ("b", "c")} and pairs(item="talk") == {("a", "c"), ("b", "c")}


def test_tails():
    assert math.isclose(stats.chi2_p(3.841459, 1), 0.05, rel_tol=1e-5) and math.isclose(stats.chi2_p(18.307, 10), 0.05, rel_tol=1e-4)
    assert math.isclose(stats.fisher_exact(3, 1, 1, 3), 0.4857142857, rel_tol=1e-9) and stats.fisher_exact(0, 0, 0, 0) == 1.0


def test_yates(spark):
    rows = [("a", "x")] * 10 + [("a", "y")] * 20 + [("b", "x")] * 30 + [("b", "y")] * 15
    got = stats.chi_square(spark.createDataFrame(rows, "r string, c string"), "r", "c").first()
    assert math.isclose(got.chi2, 6.7522, abs_tol=1e-4) and got.dof == 1 and 0.009 < got.p < 0.0101


def test_resampling_repeats(spark):
    df = spark.createDataFrame([(i % 40, "A" if i % 3 else "B", float(i)) for i in range(200)], "p long, s string, v double")
    a, b = (stats.overlap_permutation(df, "p", "s", "A", "B", 50).first() for _ in range(2))
    assert a == b and 0 < a.p_lower <= 1
    ci = sorted(tuple(r) for r in stats.bootstrap_mean(df, "s", "v", 100).collect())
    assert all(lo < mean < hi for _, _, mean, lo, hi in ci)
    assert ci == sorted(tuple(r) for r in stats.bootstrap_mean(df.repartition(5), "s", "v", 100).collect())


def test_permutation_against_plain_shuffles(spark):
    rows = [(p, "A" if (p + i) % 3 else "B") for p in range(30) for i in range(p % 4 + 1)]
    got = stats.overlap_permutation(spark.createDataFrame(rows, "p long, s string"), "p", "s", "A", "B", 2000).first()
    r, labels, sizes = random.Random(1), [s for _, s in rows], []
    for _ in range(2000):
        r.shuffle(labels)
        sizes.append(len({p for (p, _), s in zip(rows, labels) if s == "A"} & {p for (p, _), s in zip(rows, labels) if s == "B"}))
    mean = sum(sizes) / 2000
    sd = math.sqrt(sum((x - mean) ** 2 for x in sizes) / 1999)
    assert got.observed == len({p for p, s in rows if s == "A"} & {p for p, s in rows if s == "B"})
    assert abs(got.null_mean - mean) < 0.25 and abs(got.null_sd - sd) < 0.2
    none = stats.overlap_permutation(spark.createDataFrame([], "p long, s string"), "p", "s", "A", "B", 50).first()
    assert none.observed == 0 and none.null_mean is None


def test_bootstrap_difference(spark):
    rows = [(i, "x", 10.0 + i % 7) for i in range(200)] + [(1000 + i, "y", 12.0 + i % 5) for i in range(150)]
    df = spark.createDataFrame(rows, "k long, g string, v double")
    got = stats.bootstrap_difference(df, "g", "v", "x", "y", 500).first()
    assert got.lo < got.difference < got.hi < 0 and got.p < 0.01
    same = stats.bootstrap_difference(df.where("g = 'x'").withColumn("g", F.when(F.col("k") % 2 == 0, "x").otherwise("y")), "g", "v", "x", "y", 500).first()
    assert same.lo < 0 < same.hi and same.p > 0.05
    assert stats.bootstrap_difference(df.where("g = 'x'"), "g", "v", "x", "y", 20).first().difference is None


def test_degenerate_statistics(spark):
    df = spark.createDataFrame([("a", "x", 1.0, 5, True), ("b", "x", 1.0, 5, True)], "g string, c string, v double, t int, e boolean")
    one = stats.chi_square(df, "g", "c").first()
    assert (one.dof, one.n, one.chi2, one.cramers_v, one.p) == (0, 2, 0.0, None, None)
    assert stats.kruskal(df, "g", "v").first().h is None and stats.kruskal(df.limit(0), "g", "v").first().h is None
    late = stats.logrank(df, "g", "a", "t", "e").first()
    assert (late.observed, late.expected, late.chi2, late.p) == (1, 1.0, None, None)
    assert stats.logrank(df.limit(0), "g", "a", "t", "e").first().chi2 is None
    sided = stats.mantel_haenszel(df.withColumn("out", F.col("g") == "a"), "c", "e", "out").first()
    assert (sided.strata, sided.chi2, sided.odds_ratio, sided.p) == (1, None, None, None)
    assert stats.chi_square(df.limit(0), "g", "c").first().chi2 is None


def test_p_values_and_whole_grid(spark):
    rows = [("a", "x")] * 10 + [("a", "y")] * 20 + [("b", "x")] * 30 + [("c", "y")] * 15  # two cells are empty
    got = stats.chi_square(spark.createDataFrame(rows, "r string, c string"), "r", "c").first()
    o = {k: rows.count(k) for k in {(r, c) for r in "abc" for c in "xy"}}
    row, col = {r: o[r, "x"] + o[r, "y"] for r in "abc"}, {c: sum(o[r, c] for r in "abc") for c in "xy"}
    want = sum((o[r, c] - row[r] * col[c] / 75) ** 2 / (row[r] * col[c] / 75) for r, c in o)
    assert math.isclose(got.chi2, want, abs_tol=1e-4) and got.dof == 2
    lives = spark.createDataFrame([("a" if i % 2 else "b", i % 9 + (i % 2) * 4, i % 5 > 0) for i in range(80)], "g string, t int, e boolean")
    lr = stats.logrank(lives, "g", "a", "t", "e").first()
    assert math.isclose(lr.p, stats.chi2_p(lr.chi2, 1), rel_tol=1e-3) and 0 < lr.p < 0.05


def test_median_is_taken_before_rounding(spark):
    df = spark.createDataFrame([("g", t, True) for t in range(4)] + [("h", 1, False)], "g string, t int, e boolean")
    km = stats.kaplan_meier(df, "g", "t", "e")
    assert [r.survival for r in km.orderBy("t").collect()] == [0.75, 0.5, 0.25, 0.0]
    assert [(r.g, r.median_time) for r in stats.median_survival(km, "g", "t").collect()] == [("g", 1)]


def test_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(3, "c", 2001), (1, "a", 2000), (2, None, 2000)], "id int, name string, year int")
    sinks.sorted_csv(df, str(tmp_path / "csv"), ["id"], single=True)
    back = sources.csv(spark, str(tmp_path / "csv"), "id int, name string, year int")
    assert [r.id for r in back.collect()] == [1, 2, 3]
    (tmp_path / "notes.csv").write_text("id,name\n# note\n\n1\n2,b\n")
    assert [tuple(r) for r in sources.csv(spark, str(tmp_path / "notes.csv"), "id int, name string", "#").collect()] == [(1, None), (2, "b")]
    sinks.split_json(df, str(tmp_path / "json"), "year")
    assert spark.read.json(str(tmp_path / "json")).where("year = 2000").count() == 2
    (tmp_path / "new").mkdir()
    (tmp_path / "new" / "a.json").write_text('[{"id": 1}, {"id": 5}, {"id": 5}]')
    assert [r.id for r in sources.json_new(spark, str(tmp_path / "new"), "id int", "id", df.select("id")).collect()] == [5]
    assert sinks.manifest(spark, str(tmp_path / "new")).first().sha256 is not None
    table = sinks.markdown_table(df, ["id"]).split("\n")
    assert table == ["| id | name | year |", "| --- | --- | --- |", "| 1 | a | 2000 |", "| 2 |  | 2000 |", "| 3 | c | 2001 |"]
    with pytest.raises(ValueError):
        sinks.markdown_table(df, ["id"], limit=2)
    sinks.write_turtle(graph.triples(df, F.concat(F.lit("x"), "id"), {"p:name": (F.col("name"), "string")}), str(tmp_path / "ttl"))
    assert spark.read.text(str(tmp_path / "ttl")).count() == 2


def test_html(spark):
    page = "<html><title>T &amp; x</title><body><p>One  <b>two</b></p>\n<ul><li>a<li>b</ul></body></html>"
    assert one(spark, page, sources.html_text) == one(spark, page, sources.html_text_plain) == "T & x\nOne  two\n\na\nb\n"
    assert one(spark, "<p></p>", sources.html_text) == one(spark, "<p></p>", sources.html_text_plain) == ""
    assert one(spark, None, sources.html_text) is None and one(spark, None, sources.html_text_plain) is None
    assert sources.optional(spark.range(1), "missing") is not None


def talk(spark, line):
    r = one(spark, line, tx.talk_line)
    return r.speakers, r.places, r.title


def test_programme_lines(spark):
    assert talk(spark, "Anna Berg (Riga). On verbs.") == (["Anna Berg"], ["Riga"], "On verbs")
    assert talk(spark, "K. L. Berg (Riga), M. Stone (Oslo). On verbs (1814–1875) of I. P. Minaev") == (["K. L. Berg", "M. Stone"], ["Riga", "Oslo"], "On verbs (1814–1875) of I. P. Minaev")
    assert talk(spark, "K. L. Berg, D. A. Stone. Sword and sign") == (["K. L. Berg", "D. A. Stone"], [None, None], "Sword and sign")
    assert talk(spark, "Berg Anna, Stone Mark (Oslo) Joint work") == (["Berg Anna", "Stone Mark"], ["Oslo", "Oslo"], "Joint work")
    assert talk(spark, "Проф. А. Б. Иванов. О глаголах") == (["А. Б. Иванов"], [None], "О глаголах")
    assert talk(spark, "Anna Berg: Two texts") == (["Anna Berg"], [None], "Two texts")
    assert talk(spark, "opening remarks") == ([], [], "opening remarks") and talk(spark, None) == (None, None, None)


def test_packed_lines(spark):
    split = lambda line: one(spark, line, tx.packed_lines)
    assert split("Anna Berg (Riga). On verbs.Mark Stone Lee (Oslo). On nouns") == ["Anna Berg (Riga). On verbs.", "Mark Stone Lee (Oslo). On nouns"]
    assert split("A. B. Berg (Riga). Papers of I. P. Minaev (MAE): a catalogue") == ["A. B. Berg (Riga). Papers of I. P. Minaev (MAE): a catalogue"]
    assert split("А. Берг (Рига). О глаголах К. Стоун (Гамбург). О тайном") == ["А. Берг (Рига). О глаголах", "К. Стоун (Гамбург). О тайном"]
    assert split("А. Берг (Рига), К. Стоун (Гамбург). О тайном") == ["А. Берг (Рига), К. Стоун (Гамбург). О тайном"]
    assert split("Anna Berg (Riga). Mark Stone (Oslo). Joint. Work.") == ["Anna Berg (Riga). Mark Stone (Oslo). Joint. Work."]
    assert split("9:30 One 10.45 Two") == ["9:30 One", "10.45 Two"] and split(None) is None


def test_wrapped_lines(spark):
    lines = ["Berg Anna (Riga). Stone Mark Lee", "(Oslo). The archive of Paul Klein (1814–1875), his", "library.", "Afternoon session, 14:30", "K.L.", "Wood (Oslo). Texts", " "]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "doc int, n int, line string")
    got = [r.line for r in temporal.wrapped_entries(df, "doc", "n", "line", tx.STARTS, tx.HEADING).orderBy("entry").collect()]
    assert got == ["Berg Anna (Riga). Stone Mark Lee (Oslo). The archive of Paul Klein (1814–1875), his library.", "Afternoon session, 14:30", "K.L. Wood (Oslo). Texts"]


def test_compatibility_forms_do_not_change_ids(spark):
    a, b = (one(spark, v, lambda c: tx.stable_hash([c])) for v in ("ﬁeld\u00a0Ⅳ", "field iv"))
    assert a == b


def test_nearest_vectors_in_blocks(spark):
    r = random.Random(3)
    rows = [(i, [float(r.randrange(-3, 4)) for _ in range(4)]) for i in range(90)] + [(200, None)]
    df = spark.createDataFrame(rows, "v long, x array<double>")
    got = {}
    for x in lexical.nearest_vectors(df.where("v % 9 = 0").withColumnRenamed("v", "q"), df, "q", "v", "x", 3, block=4, chunk=16).collect():
        got.setdefault(x.q, []).append((x["rank"], -x.score, x.v))
    for q, a in rows[:90:9]:
        want = sorted((-sum(p * s for p, s in zip(a, b)), v) for v, b in rows if b and v != q)[:3]
        assert [x[1:] for x in sorted(got[q])] == want
    assert len(got) == 10


def test_topics_factorise(spark):
    docs = [(i, ["a", "b", "c"] if i % 2 else ["x", "y", "z"]) for i in range(20)]
    cells = spark.createDataFrame([(i, t, 1.0 + (t in "ax")) for i, ts in docs for t in ts], "doc int, term string, weight double")
    got = {}
    for r in lexical.nmf_topics(cells, "doc", rank=2, top=3, iterations=12).collect():
        got.setdefault(r.topic, []).append((r["rank"], r.term))
    assert sorted("".join(t for _, t in sorted(v)) for v in got.values()) == ["abc", "xyz"]
    assert lexical.nmf_topics(cells.limit(0), "doc", rank=2, iterations=1).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.range(200).selectExpr("id", "id % 3 as k", "timestamp_seconds(1704067200 + id * 60) as ts", "double(id) as value")
    rows.write.parquet(str(tmp_path / "in"))
    stream = events.read_events(spark, str(tmp_path / "in"), "id long, k long, ts timestamp, value double")
    q = events.windowed(stream, "ts", ["k"], "value", "1 hour").writeStream.outputMode("append").format("memory").queryName("windows").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {tuple(r) for r in spark.table("windows").collect()}
    want = {tuple(r) for r in events.windowed(rows, "ts", ["k"], "value", "1 hour").collect()}
    assert got and got <= want


def test_repeated_events_go(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k int, v string").withColumn("ts", F.current_timestamp())
    assert events.deduplicated(rows, "ts", "k").count() == 2


def test_pdf_is_optional(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"no pdf")
    files = spark.read.format("binaryFile").load(str(tmp_path))
    assert [r.text for r in sources.pdf_text(files).collect()] == [None]


def test_fractions_of_an_item_need_one_shuffle(spark):
    """Authors, their organisations and the item are counted where its rows are; nulls and repeats as by joins."""
    rows = [(1, "a", "x"), (1, "a", "x"), (1, "b", "y"), (1, "b", None), (2, "c", "x"), (None, "c", "x"), (3, None, "x")]
    out = aggregates.fractional(spark.createDataFrame(rows, "item int, author string, org string"), "item", "author", "org")
    assert {(r.org, r.simple_count, r.fractional_count) for r in out.collect()} == {("x", 2, 1.5), ("y", 1, 0.25), (None, 1, 0.25)}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
