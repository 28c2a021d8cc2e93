"""Hiring-shaped tables derived from the star-schema tables.

Group sizes are kept bounded on purpose: every list column is a set over the part names (a vocabulary), built from
rows that were reduced to distinct values first, so a customer that owns a third of all lines still yields one small
row per map task. Experience stays a long table (one row per order), never an array per candidate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.functions.text import empty_if_null, strings
from matchloom.sources.tables import table

TITLES = {
    "STANDARD": "Senior Engineer", "ECONOMY": "Finance Analyst", "MEDIUM": "Engineering Manager",
    "PROMO": "Product Lead", "LARGE": "Research Associate", "SMALL": "ML Developer",
}
ARCHETYPES = {
    "STANDARD": "standard", "ECONOMY": "finance", "MEDIUM": "management", "PROMO": "product", "LARGE": "research",
    "SMALL": "data_ml",
}
POSITIONS = {
    "1-URGENT": "Senior Engineer", "2-HIGH": "Developer", "3-MEDIUM": "Contract Analyst",
    "4-NOT SPECIFIED": "Freelance Associate", "5-LOW": "Software Intern",
}


def pick(c: Column, mapping: dict[str, str], default: str = "") -> Column:
    out = None
    for key, value in mapping.items():
        out = F.when(c == key, value) if out is None else out.when(c == key, value)
    return out.otherwise(default)


def job_id() -> Column:
    return F.concat_ws("|", "p_brand", "p_type")


def distinct_list(value: Column, condition: Column) -> Column:
    return F.array_sort(F.collect_set(F.when(condition, value)))


def jobs(spark: SparkSession, sf: str) -> DataFrame:
    size, name = F.col("p_size"), F.col("p_name")
    grouped = table(spark, sf, "part").groupBy("p_brand", "p_type").agg(
        distinct_list(name, size >= 40).alias("must_have_skills"),
        distinct_list(name, size < 10).alias("good_to_have_skills"),
        (F.min(size) / 10).alias("min_years_experience"),
        distinct_list(name, size == 12).alias("required_certifications"),
        distinct_list(F.substring_index(name, " ", -1), size.between(20, 24)).alias("domain_keywords"),
        distinct_list(F.concat(F.lit("Own "), name, F.lit("; mentor team")), size.between(30, 31)).alias("responsibilities"),
    )
    return grouped.select(
        job_id().alias("job_id"),
        pick(F.col("p_type"), TITLES).alias("title"),
        "must_have_skills", "good_to_have_skills", "min_years_experience",
        F.when(F.col("p_type") == "LARGE", strings(["b.tech computer science", "phd"]))
        .when(F.col("p_type") == "SMALL", strings(["master"]))
        .when(F.col("p_type") == "MEDIUM", strings(["engineering"]))
        .otherwise(strings([])).alias("required_education"),
        "required_certifications", "domain_keywords", "responsibilities",
        pick(F.col("p_type"), ARCHETYPES, "standard").alias("archetype"),
    )


def purchases(spark: SparkSession, sf: str) -> DataFrame:
    """One row per order line with the customer and the part name."""
    lines = table(spark, sf, "lineitem")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate", "o_orderstatus")
    parts = table(spark, sf, "part").select("p_partkey", "p_name")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).join(parts, lines.l_partkey == parts.p_partkey)


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    customer = table(spark, sf, "customer").where("c_acctbal >= 0")
    nation = table(spark, sf, "nation").select("n_nationkey", "n_name")
    # customer x part name first: at most one row per name and customer leaves each map task
    owned = purchases(spark, sf).groupBy("o_custkey", "p_name").agg(
        F.max((F.col("l_returnflag") == "R") & (F.col("l_quantity") >= 49)).alias("certified"),
        F.max(F.col("l_discount") >= 0.1).alias("project"),
    )
    last = F.substring_index("p_name", " ", -1)
    lists = owned.groupBy("o_custkey").agg(
        F.array_sort(F.collect_set("p_name")).alias("skills"),
        F.array_sort(F.collect_set(last)).alias("tools"),
        distinct_list(F.col("p_name"), F.col("certified")).alias("certifications"),
        distinct_list(F.concat("p_name", F.lit(" portal, "), last, F.lit(" rollout")), F.col("project")).alias("projects"),
    )
    segment = F.lower("c_mktsegment")
    key = F.col("c_nationkey")
    school = F.struct(
        F.concat("n_name", F.lit(" Institute")).alias("institution"),
        F.when(key < 8, "B.Tech").when(key < 15, "Master of Science").otherwise("Diploma").alias("degree"),
        F.when(key < 8, "CSE").when(key < 15, "Artificial Intelligence").otherwise("").alias("field_of_study"),
    )
    no_school = F.filter(F.array(school), lambda x: F.lit(False))
    return (
        customer.join(nation, customer.c_nationkey == nation.n_nationkey, "left")
        .join(lists, customer.c_custkey == lists.o_custkey, "left")
        .select(
            F.col("c_custkey").alias("candidate_id"),
            F.col("c_name").alias("name"),
            F.when(F.col("c_acctbal") >= 500, F.concat(F.regexp_replace(F.lower("c_name"), "#", "."), F.lit("@example.com")))
            .otherwise("").alias("email"),
            F.coalesce("n_name", F.lit("")).alias("location"),
            F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), F.concat(F.lit("https://linkedin.com/in/"), segment))
            .otherwise("").alias("linkedin"),
            F.when(F.col("c_mktsegment") == "HOUSEHOLD", "https://example.org/work").otherwise("").alias("portfolio"),
            F.when(F.col("c_acctbal") >= 1000, F.concat(segment, F.lit(", hot anvil, new ring / cold rods")))
            .otherwise("").alias("summary"),
            empty_if_null("skills").alias("skills"), empty_if_null("tools").alias("tools"),
            empty_if_null("certifications").alias("certifications"), empty_if_null("projects").alias("projects"),
            F.when(key < 20, F.array(school)).otherwise(no_school).alias("education"),
            F.round(F.col("c_acctbal") / 1000, 1).alias("stated_years"),
        )
    )


def month_text(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM")


def experience(spark: SparkSession, sf: str) -> DataFrame:
    """One entry per order: title from the priority, months from order date to the last shipment."""
    orders = table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate", "o_orderstatus"
    )
    parts = table(spark, sf, "part").select("p_partkey", "p_name")
    note = F.concat(
        F.when(F.col("l_returnflag") == "R", "Reduced ").when(F.col("l_returnflag") == "A", "Worked on ").otherwise("Built "),
        F.col("p_name"),
        F.when(F.col("l_returnflag") == "R", " cost by 15%").otherwise(""),
    )
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag", "l_shipdate")
    per_order = lines.join(parts, lines.l_partkey == parts.p_partkey).groupBy("l_orderkey").agg(
        F.max("l_shipdate").alias("last_ship"),
        F.array_sort(F.collect_set("p_name")).alias("skills_used"),
        F.array_sort(F.collect_set(note)).alias("highlights"),
    )
    return orders.join(per_order, orders.o_orderkey == per_order.l_orderkey, "left").select(
        F.col("o_custkey").alias("candidate_id"),
        F.col("o_orderkey").alias("pos"),
        pick(F.col("o_orderpriority"), POSITIONS).alias("title"),
        F.when(F.col("o_orderstatus") == "P", "State University").otherwise(F.concat(F.lit("Employer "), F.col("o_orderstatus"))).alias("company"),
        month_text(F.col("o_orderdate")).alias("start_date"),
        F.coalesce(month_text(F.col("last_ship")), F.lit("")).alias("end_date"),
        empty_if_null("skills_used").alias("skills_used"),
        empty_if_null("highlights").alias("highlights"),
    )


def applications(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    parts = table(spark, sf, "part").select("p_partkey", job_id().alias("job_id"))
    first = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.min("l_partkey").alias("first_part"))
    with_part = orders.join(first, orders.o_orderkey == first.l_orderkey, "left")
    return with_part.join(parts, with_part.first_part == parts.p_partkey, "left").select(
        F.col("o_orderkey").alias("application_id"),
        F.col("o_custkey").alias("candidate_id"),
        "job_id",
        F.when(F.col("o_orderstatus") == "O", "APPLIED").when(F.col("o_orderstatus") == "F", "CLOSED").otherwise("REVIEW").alias("status"),
        (F.col("o_orderstatus") == "F").alias("processed"),
        F.col("o_orderdate").alias("applied_at"),
    )


def score_log(spark: SparkSession, sf: str) -> DataFrame:
    """Existing log rows: one per returned line, FAILED (in either case) where the line is also closed; successes carry
    DONE or no status."""
    return table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(
        F.col("l_orderkey").alias("application_id"),
        F.lit("SCORE").alias("stage"),
        F.when(F.col("l_linestatus") == "F", F.when(F.col("l_quantity") < 25, "failed").otherwise("FAILED"))
        .when(F.col("l_quantity") < 25, "DONE").alias("status"),
        F.col("l_shipdate").alias("created_at"),
    )


def resume_text(spark: SparkSession, sf: str) -> DataFrame:
    """Every document as a résumé: the whole text stays, a layout that depends on its language goes around it."""
    d = table(spark, sf, "documents")
    tag = F.concat(F.lit("item"), F.col("doc_id").cast("string"))
    phone = F.concat(F.lit("+1 415 555 "), F.lpad((F.col("doc_id") % 10000).cast("string"), 4, "0"))
    first_line = F.substring_index("text", "\n", 1)
    full = F.concat(
        F.lit("Alex Moreno\n"), tag, F.lit("@Example.com | "), phone, F.lit("\nLocation: Lyon, France\nhttps://github.com/"), tag,
        F.lit(" https://www.linkedin.com/in/"), tag,
        F.lit("\nPROFESSIONAL SUMMARY\n"), first_line,
        F.lit("\nTechnical Skills:\nPython, SQL / Spark; k8s | data modelling\nexperience, "), F.col("source"),
        F.lit("\nTools\nDocker, Git\nWork Experience\nSenior Engineer | Acme Corp | Jan 2018 - Present\n"
              "Built pipelines, cut cost by 20%\nDeveloper at Globex 2015 to 2017\n"),
        F.col("text"),
        F.lit("\nEducation\nB.Tech CSE, State Institute, 2014\nDiploma | Town College\nCertifications\nCloud Associate; "),
        F.col("lang"), F.lit("\nProjects\n- Search portal\n* search portal\n- Ranking service\nover 6+ years in total, 2.5 yrs abroad\n"),
    )
    links_first = F.concat(
        F.lit("github.com/"), tag, F.lit("\nwww.example.org/"), tag, F.lit("\nJean Petit\n"), phone, F.lit("\nskills\nsql\n"),
        F.col("text"), F.lit("\nTech stack: Airflow, Kafka\nTerraform, Helm\n3 years of practice\n"),
    )
    plain = F.concat(F.lit("maria lopez garcia\nBased in: Madrid\n"), F.col("text"))
    return d.select(
        "doc_id", "lang", "source",
        F.when(F.col("lang") == "en", full).when(F.col("lang") == "de", links_first).when(F.col("lang") == "es", plain)
        .otherwise(F.col("text")).alias("text"),
    )


def job_text(spark: SparkSession, sf: str) -> DataFrame:
    """Every benchmark passage as a job text; some with named sections, some a title and one line."""
    b = table(spark, sf, "benchmark")
    body = F.concat(
        F.lit("Position: Fullstack Developer "), F.col("item_id").cast("string"),
        F.lit("\nThe intro needs 3+ years of work\nRequired skills\nPython, fullstack; SQL, experience\n"), F.col("text"),
        F.lit("\nNice to have\nReact / entry level | Kafka\nResponsibilities\nOwn the roadmap, mentor team\n"), F.col("text"),
        F.lit("\nQualifications\nBachelor of computer science, 5.5 yrs\n"),
    )
    short = F.concat(F.when(F.col("item_id") % 3 == 1, "AI/ML Developer").otherwise("Full stack engineer"), F.lit("\n"))
    return b.select(
        "item_id",
        F.when(F.col("item_id") % 3 == 0, body).otherwise(F.concat(short, F.translate("text", "\n", " "))).alias("text"),
    )


def words(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("page_id"), F.col("l_returnflag").alias("text"),
        (F.col("l_discount") * 1000).alias("conf"), F.floor(F.col("l_extendedprice") / 100).cast("int").alias("left"),
        F.floor(F.col("l_quantity") * 10).cast("int").alias("top"), F.lit(40).alias("width"), F.lit(12).alias("height"),
    )


def model_output(spark: SparkSession, sf: str) -> DataFrame:
    """Event properties as a model would answer: fenced, with a trailing comma, some as a list."""
    props = F.regexp_replace("props", r"\}$", ",}")
    text = F.when(F.col("event_type") == "error", F.concat(F.lit("[ "), props, F.lit(" ]"))).otherwise(
        F.concat(F.lit("```json\n"), props, F.lit("\n```"))
    )
    return table(spark, sf, "events").select("event_id", "ts", "event_type", "value", text.alias("raw"))


def graph_source(spark: SparkSession, sf: str) -> DataFrame:
    """Skill-graph input: the name of the next part is related to the name of this one."""
    p = table(spark, sf, "part")
    a = p.select(
        F.col("p_name").alias("term"), F.col("p_partkey").alias("pos"),
        F.when(F.col("p_size") < 4, "equivalent").when(F.col("p_size") < 26, "parent").otherwise("adjacent").alias("relation"),
    )
    b = p.select(F.col("p_partkey").alias("next"), F.col("p_name").alias("related"))
    return a.join(b, a.pos + 1 == b.next).select("term", "relation", "related", "pos")


def term_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """A vector per part name and per word of one. A word has the mean of the embeddings of the parts named by it, at
    length 1; a name is its first word plus twice its last, so that names of one kind of part are close."""
    names = table(spark, sf, "part").select("p_partkey", F.split("p_name", " ").alias("words"))
    values = table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "x"))
    spoken = names.select("p_partkey", F.explode(F.array_distinct("words")).alias("word"))
    means = spoken.join(values, spoken.p_partkey == values.vec_id).groupBy("word", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    listed = means.groupBy("word").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda v: v["x"]).alias("v"))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    words = listed.withColumn("n", length).select("word", F.transform("v", lambda x: x / F.col("n")).alias("v"))
    pairs = names.select("words").distinct().where(F.size("words") == 2).select(F.array_join("words", " ").alias("term"), F.col("words")[0].alias("a"), F.col("words")[1].alias("b"))
    first, last = words.select(F.col("word").alias("a"), F.col("v").alias("av")), words.select(F.col("word").alias("b"), F.col("v").alias("bv"))
    both = pairs.join(first, "a").join(last, "b").select("term", F.zip_with("av", "bv", lambda x, y: x + 2 * y).alias("embedding"))
    return words.select(F.col("word").alias("term"), F.col("v").alias("embedding")).unionByName(both)
