"""Terms and lines that are found in one pass over a whole text, against the rules stated element by element."""

from pyspark.sql import functions as F

from matchloom import fixed_values as fv
from matchloom.functions import scores as sc, text as tx


def every_character(spark):
    """One row per character: alone, between letters, before a blank, and beside separators."""
    points = spark.range(1, 0x110000).where("id < 55296 OR id > 57343")
    c = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
    return points.select("id", F.concat(c, F.lit(","), F.lit("A"), c, F.lit("b "), c, F.lit(" . ;x "), c, F.lit("\n.Y"), c).alias("t"))


def test_terms_of_every_character(spark):
    kept = lambda x: F.btrim(F.regexp_replace(F.lower(x), "[^a-z0-9+#./]+", " "), F.lit(" .,:;"))
    rows = every_character(spark)
    assert rows.where(tx.skill("t") != kept(F.col("t"))).count() == 0
    assert rows.where(tx.listed("t") != F.transform(F.split("t", fv.LIST_SPLIT), kept)).count() == 0


def test_list_elements_are_not_cleaned_one_by_one(spark):
    docs = spark.createDataFrame([("Python, py; .NET / C++ (Core) | a  b c\n\n", ), (None,), ("",), ("x",)], "t string")
    terms = docs.select(tx.canonical_terms(tx.listed("t")).alias("a"), tx.score_phrases("t", 9, 2).alias("b"))
    assert [tuple(r) for r in terms.collect()] == [
        (["python", "python", "net", "c++ core", "a b c", ""], ["python", "net", "c++ core"]), ([""], []), ([""], []), (["x"], ["x"])]
    plan = docs.select(tx.phrases("t").alias("p"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") == 1 and "split(lower(regexp_replace(" in plan  # nothing inside the lambdas


def test_word_limit(spark):
    rows = spark.createDataFrame([("",), ("a",), ("a b",), ("a b c",), ("a  c",)], "t string")
    for n in (1, 2, 3):
        assert rows.where(tx.at_most(F.col("t"), n) != (tx.n_words(F.col("t")) <= n)).count() == 0


def test_lines_of_every_character(spark):
    ws = fv.WHITESPACE
    rows = every_character(spark)
    assert rows.where(tx.strip_space(F.col("t")) != F.regexp_replace("t", f"^{ws}+|{ws}+$", "")).count() == 0
    assert rows.where(tx.lines_of("t") != F.split("t", fv.LINE_BREAK)).count() == 0


def test_contains_any_leaves_out_what_a_shorter_needle_finds(spark):
    rows = spark.createDataFrame([("my toolbox",), ("tech stack",), ("none",)], "t string")
    hit = tx.contains_any(F.col("t"), fv.TOOL_MARKERS)
    assert [r[0] for r in rows.select(hit).collect()] == [any(m in t for m in fv.TOOL_MARKERS) for t in ("my toolbox", "tech stack", "none")]
    assert str(hit._jc).count("contains") < len(fv.TOOL_MARKERS)


def test_first_words_and_caps_are_made_once(spark):
    docs = spark.createDataFrame([("Owned  the roadmap",), (" Worked on it",), ("",), ("x" * 300,), (None,)], "t string")
    kind, capped = sc.ownership_kind(F.col("t")), tx.compact("t")
    got = docs.select("t", kind.alias("k"), capped.alias("c")).collect()
    assert [r.c for r in got] == ["Owned the roadmap", "Worked on it", "", "x" * 237 + "...", ""]
    own = [any((r.t or "").strip().lower().split(" ")[0].rstrip("ed,.:;").startswith(v) for v in fv.OWNERSHIP_VERBS) for r in got]
    assert [r.k == "own" for r in got] == own
    plan = docs.select(kind.alias("k"), capped.alias("c"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1 and plan.count("regexp_replace(") == 1
