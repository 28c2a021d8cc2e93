"""Goldens worked out by hand for the rules that are easy to get wrong."""

from pyspark.sql import functions as F

from matchloom.functions import dates, scores as sc, text as tx
from matchloom.operators import sections as se, tenure as tn

AS_OF = 2024 * 12 + 1


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_terms(spark):
    rows = [("  .NET / C++ (Core) ",), ("B.E.",), ("ReactJS",), (None,), ("a  b",)]
    got = values(spark, rows, "t string", tx.skill("t"), tx.canonical("t"), tx.squash("t"))
    assert got == [
        ("net / c++ core", "net / c++ core", ".NET / C++ (Core)"), ("b.e", "b.e", "B.E."), ("reactjs", "react", "ReactJS"),
        ("", "", ""), ("a b", "a b", "a b"),
    ]


def test_lists_keep_first_occurrence_and_limits(spark):
    text = "Python, python; SQL / experience | a b c d e f g\nKafka"
    got = values(spark, [(text,)], "t string", tx.split_tokens("t"), tx.phrases("t", 2, 6), tx.score_phrases("t", 9, 4))[0]
    assert got == (["python", "sql", "experience", "a b c d e f g", "kafka"], ["python", "sql"], ["python", "sql", "kafka"])


def test_sanitise_and_sentences(spark):
    got = values(
        spark, [(["Fullstack dev", "fresher", "full stack dev", "Project"], ["One", "one", "Two"])], "a array<string>, b array<string>",
        tx.sanitise_terms(F.col("a")), tx.sentence_join(F.col("b"), 3), tx.sentence_join(F.col("b"), 1), tx.sentence_join(tx.strings([])))[0]
    assert got == (["full stack dev"], "One; and Two", "One", "")


def test_half_even(spark):
    assert values(spark, [(5 * 0.5,), (7 * 0.5,)], "x double", sc.points(F.col("x"))) == [(2,), (4,)]


def test_dates(spark):
    rows = [("Jan 2018",), ("2018-3-07",), ("03/2019",), ("Now",), ("2020",), ("spring",), ("",), ("Sept 2011",), ("13/2019",)]
    got = [r[0] for r in values(spark, rows, "t string", dates.parse_date("t"))]
    assert got == ["2018-01", "2018-03", "2019-03", "Present", "2020", "spring", "", "2011-09", "13/2019"]


def test_ranges_and_durations(spark):
    rows = [("2018-03", "", 0), ("2018 - Present", "", 0), ("2022-01", "2020-01", 0), ("2020-01", "2020-11", 0), ("2020-01", "2021-01", 7)]
    schema = "s string, e string, m int"
    safe = values(spark, rows, schema, dates.tidy_entry(F.col("s"), F.col("e"), F.col("m"), AS_OF))
    assert [tuple(x[0]) for x in safe] == [
        ("2018-03", "", 0), ("2018", "Present", 72), ("2022-01", "Present", 24), ("2020-01", "2020-11", 10), ("2020-01", "2021-01", 7)]
    s, e = dates.split_range(F.col("s"), F.col("e"), "reference")
    assert values(spark, rows[:1], schema, s, e) == [("2018", "03")]


def test_years_policies(spark):
    got = values(spark, [(None, None, 5.0), (120, 1, 0.5), (60, 1, 2.0)], "w bigint, n bigint, s double",
                 tn.years(F.col("w"), F.col("n"), F.col("s")), tn.years(F.col("w"), F.col("n"), F.col("s"), "largest"))
    assert got == [(0.0, 5.0), (1.0, 1.0), (2.0, 2.0)]


def test_seniority_is_by_substring(spark):
    rows = [("internal auditor",), ("member of staff",), ("sde-2",), ("gardener",), ("",)]
    assert [r[0] for r in values(spark, rows, "t string", tn.seniority(F.col("t")))] == [1, 6, 3, 0, 0]


def test_employment_filter(spark):
    rows = [("B.Tech Student", "X", 12), ("Software Engineer", "State University", 3), ("Software Intern", "State University", 3),
            ("Research Assistant", "Lab", 40), ("Gardener", "Y", 3), ("Student Developer", "Z", 2)]
    got = [r[0] for r in values(spark, rows, "t string, c string, m int", tn.is_employment(F.col("t"), F.col("c"), F.col("m")))]
    assert got == [False, False, True, True, False, False]


def test_ownership_modes(spark):
    rows = [("Led a team",), ("Built it",), ("Designed it",), ("Worked on it",), ("",)]
    ref = [r[0] for r in values(spark, rows, "t string", sc.ownership_kind(F.col("t")))]
    words = [r[0] for r in values(spark, rows, "t string", sc.ownership_kind(F.col("t"), "words"))]
    assert ref == ["", "own", "", "", ""]
    assert words == ["own", "own", "own", "contribute", ""]


def test_bonus_caps(spark):
    a, d = sc.bonus_caps(F.col("r"))
    rows = [(0.0,), (0.33,), (0.34,), (0.66,), (0.67,), (1.0,)]
    assert values(spark, rows, "r double", a, d) == [(2, 1), (4, 2), (6, 3), (6, 3), (10, 8), (10, 8)]


def test_skill_ratio_without_lists(spark):
    rows = [(1.0, 1, 0.0, 0), (0.0, 0, 1.0, 4), (0.0, 0, 0.0, 0), (4.0, 4, 0.0, 4)]
    got = values(spark, rows, "rc double, rn int, pc double, pn int", sc.skill_ratio(F.col("rc"), F.col("rn"), F.col("pc"), F.col("pn")))
    assert [r[0] for r in got] == [0.7, 0.5, 1.0, 0.75]


def test_annotation_is_a_state_machine(spark):
    text = "github.com/x\nwww.example.org\nJane Roe\nSkills\nsql\nlinkedin.com/y"
    got = values(spark, [(text,)], "t string", se.annotate("t"))[0][0]
    assert got == [
        "[CONTACT_INFO]", "[LINKS]", "github.com/x", "www.example.org", "[CONTACT_INFO]", "Jane Roe", "[SKILLS]", "sql", "[LINKS]",
        "linkedin.com/y"]


def test_repair_json(spark):
    rows = [('```json\n{"k": [1, 2,],}\n```',), ('[ {"k": 1} ]',), ("no braces",)]
    assert [r[0] for r in values(spark, rows, "t string", tx.repair_json("t"))] == ['{"k": [1, 2]}', '{"k": 1}', "no braces"]


def test_dates_as_people_write_them(spark):
    from matchloom.functions import dates

    cases = {"25/03/2019": "2019-03", "03/04/2019": "2019-03", "2018 March": "2018-03", "March 15th, 2018": "2018-03", "15th of March 2018": "2018-03",
             "Mar '18": "2018-03", "Mar '85": "1985-03", "worked since March 2018 there": "2018-03", "Mar 18": "Mar 18", "31/31/2019": "31/31/2019",
             "in the marble hall 2018x": "in the marble hall 2018x", "": "", "now": "Present"}
    df = spark.createDataFrame([(k,) for k in cases], "raw string")
    assert {r.raw: r.d for r in df.select("raw", dates.parse_date("raw").alias("d")).collect()} == cases


def test_graph_rows(spark):
    from matchloom.operators.graph import graph_rows

    rows = [("a", '{"equivalent": ["x", "y"], "parents": "p", "adjacent": []}'), ("b", '["q", "r"]'), ("c", "nothing"), ("d", None), ("e", '{"adjacents": ["z"]}')]
    got = sorted((r.term, r.relation, r.pos, r.related) for r in graph_rows(spark.createDataFrame(rows, "term string, value string")).collect())
    assert got == [("a", "equivalent", 0, "x"), ("a", "equivalent", 1, "y"), ("a", "parent", 0, "p"), ("b", "parent", 0, "q"), ("b", "parent", 1, "r"), ("e", "adjacent", 0, "z")]


def test_posting_text(spark):
    from matchloom.operators.merge import posting_text

    rows = [(" Data  Engineer ", ["sql", " "], 2, "Own it"), (None, None, None, "")]
    df = spark.createDataFrame(rows, "title string, skills array<string>, years int, description string")
    got = [r.t for r in df.select(posting_text("title", "skills", "years", "description").alias("t")).collect()]
    assert got == ["Job title: Data Engineer\nRequired skills: sql\nMinimum experience: 2 years\nDescription: Own it", "Minimum experience: 0 years"]
