"""Similarity of terms as tables over distinct vocabularies: (l, r, sim, back), back being the r to l direction.

Every pair comes out of an equi-join whose key is selective by construction; no pair is formed just because two
terms share a frequent token:

* equality and aliases: the canonical form;
* acronyms: a short single token against the initials of the other side;
* token overlap and subsets: prefix filtering. Tokens are ordered rarest first, and only the rarest few of a term are
  join keys, so a token that a third of the vocabulary contains is a key only for terms that consist of it;
* graph edges and cosines: the canonical form, and the threshold join of `vectors`;
* sequence ratio: prefix filtering on (character, occurrence, length), then the multiset bound inside the join. Both
  bounds are upper bounds of the ratio, so nothing at or above the floor is lost.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchloom.config import DEFAULT
from matchloom.functions import text as tx
from matchloom.operators.vectors import vector_join

BOTH_WAYS = T.StructType([T.StructField("sim", T.DoubleType()), T.StructField("back", T.DoubleType())])


@F.pandas_udf(BOTH_WAYS)
def sequence_ratio(left: pd.Series, right: pd.Series) -> pd.DataFrame:
    """Ratcliff-Obershelp ratio in both directions (it is not symmetric). Rows are taken in order of the second sequence,
    whose index the matcher then builds once for all its partners."""
    return pd.DataFrame({"sim": _ratios(left, right), "back": _ratios(right, left)})


def _ratios(first: pd.Series, second: pd.Series) -> list[float]:
    a, b = first.tolist(), second.tolist()
    out, matcher, held = [0.0] * len(a), SequenceMatcher(None), None
    for i in sorted(range(len(b)), key=b.__getitem__):
        if b[i] != held:
            held = b[i]
            matcher.set_seq2(held)
        matcher.set_seq1(a[i])
        out[i] = matcher.ratio()
    return out


def vocabulary(*columns: DataFrame) -> DataFrame:
    """Distinct non-blank terms of one-column frames (strings or string arrays)."""
    out = None
    for df in columns:
        name = df.columns[0]
        part = df.select((F.explode(name) if dict(df.dtypes)[name].startswith("array") else F.col(name)).alias("term"))
        out = part if out is None else out.union(part)
    return out.where("term <> ''").distinct()


def features(vocab: DataFrame) -> DataFrame:
    """Canonical form, token set, initials and short single token of each term."""
    parts = F.filter(F.split(F.translate("c", ".", " "), " "), lambda x: x != "")
    base = vocab.select("term", tx.canonical("term").alias("c")).where("c <> ''")
    base = base.withColumn("parts", parts).withColumn(
        "toks", F.array_distinct(tx.matches(F.col("c"), "[a-z0-9+#./]+"))
    )
    return base.select(
        "term", "c", "toks",
        F.array_join(F.transform("parts", lambda x: F.substring(x, 1, 1)), "").alias("initials"),
        F.when((F.size("parts") == 1) & (F.length(F.get("parts", F.lit(0))) <= 5), F.get("parts", F.lit(0))).alias("short"),
    )


def _sides(left: DataFrame, right: DataFrame, *columns: str) -> tuple[DataFrame, DataFrame]:
    return (
        left.select(*[F.col(c).alias(f"l_{c}") for c in columns]),
        right.select(*[F.col(c).alias(f"r_{c}") for c in columns]),
    )


def token_value(lt: Column, rt: Column) -> Column:
    """max(Jaccard, subset bonus) of two token sets."""

    def value(shared: Column) -> Column:
        small = F.least(F.size(lt), F.size(rt))
        subset = F.when(shared < small, 0.0).when(small >= 2, 0.9).otherwise(0.85)
        return F.greatest(shared / (F.size(lt) + F.size(rt) - shared), subset)

    return tx.let(F.size(F.array_intersect(lt, rt)), value)


def equal_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    a, b = _sides(left, right, "term", "c")
    return a.join(b, F.col("l_c") == F.col("r_c")).select(F.col("l_term").alias("l"), F.col("r_term").alias("r"))


def acronym_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    a, b = _sides(left, right, "term", "c", "short", "initials")
    other = F.col("l_c") != F.col("r_c")
    out = [F.col("l_term").alias("l"), F.col("r_term").alias("r")]
    return (
        a.join(b, (F.col("l_short") == F.col("r_initials")) & other).select(*out)
        .union(a.join(b, (F.col("r_short") == F.col("l_initials")) & other).select(*out))
    )


def _rarest_first(df: DataFrame, counts: DataFrame, name: str = "toks") -> DataFrame:
    """The list column reordered by how many terms contain each item."""
    others = [c for c in df.columns if c != name]
    rows = df.select(*others, F.explode(name).alias("tok")).join(counts, "tok")
    return rows.groupBy(*others).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("n", "tok"))), lambda x: x["tok"]).alias(name)
    )


def _item_counts(left: DataFrame, right: DataFrame, name: str = "toks") -> DataFrame:
    return left.select(name).union(right.select(name)).select(F.explode(name).alias("tok")).groupBy("tok").agg(F.count(F.lit(1)).alias("n"))


def token_pairs(left: DataFrame, right: DataFrame, floor: float) -> DataFrame:
    left, right = left.select("term", "toks"), right.select("term", "toks")
    counts = _item_counts(left, right)
    a, b = _sides(_rarest_first(left, counts), _rarest_first(right, counts), "term", "toks")
    size = F.size("l_toks")
    prefix = F.slice("l_toks", 1, F.greatest(size - F.ceil(size * floor - 1e-9).cast("int") + 1, F.lit(1)))  # a product just above a whole number is that number
    value = token_value(F.col("l_toks"), F.col("r_toks"))
    good = (F.col("l_term") != F.col("r_term")) & (value >= floor)
    out = [F.col("l_term").alias("l"), F.col("r_term").alias("r"), value.alias("tok")]
    # Jaccard and left-inside-right: a rare token of the left side occurs anywhere on the right
    one = a.withColumn("k", F.explode(prefix)).join(b.withColumn("k", F.explode("r_toks")), "k").where(good)
    # right-inside-left: the rarest token of the right side occurs anywhere on the left
    two = a.withColumn("k", F.explode("l_toks")).join(b.withColumn("k", F.get("r_toks", F.lit(0))), "k").where(good)
    return one.select(*out).union(two.select(*out))


def _character_keys(df: DataFrame) -> DataFrame:
    """(character, occurrence) keys of a term."""

    def keys(chars: Column) -> Column:
        def key(x: Column, i: Column) -> Column:
            return F.concat(x, F.size(F.filter(F.slice(chars, 1, i + 1), lambda y: y == x)).cast("string"))

        return F.transform(chars, key)

    return df.select("term", "c", tx.let(tx.matches(F.col("c"), "(?s)."), keys).alias("keys"))


def candidate_pairs(left: DataFrame, right: DataFrame, floor: float, same: bool = False) -> DataFrame:
    """Pairs (l_term, r_term, l_c, r_c) that may reach the floor: close lengths, a shared key among the rarest ones of
    both, and enough characters in common. With ``same`` both sides are one vocabulary and each pair comes once, l < r."""
    share = floor / (2 - floor)  # length ratio, and least share of characters in common, for a ratio >= floor
    left, right = _character_keys(left), _character_keys(right)
    counts = _item_counts(left, right, "keys")
    a, b = _sides(_rarest_first(left, counts, "keys"), _rarest_first(right, counts, "keys"), "term", "c", "keys")
    ln, rn = F.size("l_keys"), F.size("r_keys")

    def prefix(name: str) -> Column:
        n = F.size(name)
        return F.slice(name, 1, n - F.ceil(n * share - 1e-9).cast("int") + 1)

    a = a.withColumn("l_prefix", prefix("l_keys"))
    b = b.withColumn("r_prefix", prefix("r_keys"))
    lengths = F.sequence(F.ceil(ln * share - 1e-9).cast("int"), F.floor(ln / share + 1e-9).cast("int"))
    keyed = a.withColumn("n", F.explode(lengths)).withColumn("k", F.explode("l_prefix"))
    other = b.withColumn("n", rn).withColumn("k", F.explode("r_prefix"))
    first_shared = F.get(F.array_intersect("l_prefix", "r_prefix"), F.lit(0)) == F.col("k")
    bound = 2 * F.size(F.array_intersect("l_keys", "r_keys")) / (ln + rn)
    good = (F.col("l_c") != F.col("r_c")) & first_shared & (bound >= floor)
    if same:
        good = good & (F.col("l_term") < F.col("r_term"))
    return keyed.join(other, ["n", "k"]).where(good).select("l_term", "r_term", "l_c", "r_c")


def sequence_pairs(left: DataFrame, right: DataFrame, floor: float, same: bool = False) -> DataFrame:
    pairs = candidate_pairs(left, right, floor, same)
    ratio = pairs.select(F.col("l_term").alias("l"), F.col("r_term").alias("r"), sequence_ratio("l_c", "r_c").alias("s"))
    out = ratio.select("l", "r", F.col("s.sim").alias("seq"), F.col("s.back").alias("seq_back"))
    if same:  # both directions of a pair come from one comparison
        turned = F.array(F.struct("l", "r", "seq", "seq_back"), F.struct(
            F.col("r").alias("l"), F.col("l").alias("r"), F.col("seq_back").alias("seq"), F.col("seq").alias("seq_back")))
        out = out.select(F.explode(turned).alias("p")).select("p.*")
    return out.where((F.col("seq") >= floor) | (F.col("seq_back") >= floor))


def graph_pairs(edges: DataFrame) -> DataFrame:
    """Both directions of 'r is listed among the related terms of l'."""
    e = edges.select(F.col("term").alias("l"), F.col("related_term").alias("r"))
    return e.union(e.select(F.col("r").alias("l"), F.col("l").alias("r"))).where("l <> r").distinct()


def graph_hits(left: DataFrame, right: DataFrame, edges: DataFrame) -> DataFrame:
    """Pairs of terms of two feature tables whose canonical forms are joined by an edge in either direction."""
    a, b = left.select(F.col("term").alias("lt"), F.col("c").alias("l")), right.select(F.col("term").alias("rt"), F.col("c").alias("r"))
    return graph_pairs(edges).join(a, "l").join(b, "r").select(F.col("lt").alias("l"), F.col("rt").alias("r"))


def canonical_vectors(features: DataFrame, vectors: DataFrame) -> DataFrame:
    """(term, embedding) of the terms whose canonical form has a vector."""
    return features.select("term", "c").join(vectors.select(F.col("term").alias("c"), "embedding"), "c").select("term", "embedding")


def cosine(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Cosine of the wanted pairs (l, r): two equi-joins with the vector table; zero vectors give 0."""
    wanted = pairs.select("l", "r").distinct()
    unit = vectors.select(
        "term",
        tx.let(
            F.transform("embedding", lambda x: x.cast("double")),
            lambda v: F.struct(v.alias("v"), F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)).alias("norm")),
        ).alias("e"),
    )
    left = unit.select(F.col("term").alias("l"), F.col("e").alias("le"))
    right = unit.select(F.col("term").alias("r"), F.col("e").alias("re"))
    dot = F.aggregate(F.zip_with("le.v", "re.v", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norms = F.when(F.col("le.norm") > 0, F.col("le.norm")).otherwise(1.0) * F.when(F.col("re.norm") > 0, F.col("re.norm")).otherwise(1.0)
    return wanted.join(left, "l").join(right, "r").select("l", "r", (dot / norms).alias("cos"))


def composite(lex: Column, graph: Column, cos: Column) -> Column:
    """Equality and near-equality first, then the graph's flat value, then the better of words and vectors."""
    lex = F.coalesce(lex, F.lit(0.0))
    return F.when(lex >= 0.95, lex).when(graph, 0.85).otherwise(F.greatest(lex, F.coalesce(cos, F.lit(0.0))))


def pair_table(
    left: DataFrame, right: DataFrame, floor: float = DEFAULT.floor, ratio: bool = True,
    graph: DataFrame | None = None, cosines: DataFrame | None = None, vectors: DataFrame | None = None,
) -> DataFrame:
    """All pairs of two vocabularies whose similarity in either direction reaches the floor.

    Up to three joins of different kind give the parts: terms and characters, edges of the skill graph (``graph``) and
    cosines, either of given pairs (``cosines``) or of all pairs by the threshold join (``vectors``: term, embedding). Graph
    and vectors are looked up by the canonical form of a term.
    """
    lf, rf = features(left), features(right)
    none = F.lit(None).cast("double")

    def rows(df: DataFrame, **given: Column) -> DataFrame:
        names = ["eq", "acr", "tok", "seq", "seq_back", "graph", "cos"]
        return df.select("l", "r", *[given.get(n, none).cast("double").alias(n) for n in names])

    one = F.lit(1.0)
    parts = [
        rows(equal_pairs(lf, rf), eq=one), rows(acronym_pairs(lf, rf), acr=one),
        rows(token_pairs(lf, rf, floor), tok=F.col("tok")),
    ]
    if ratio:
        parts.append(rows(sequence_pairs(lf, rf, floor, left is right), seq=F.col("seq"), seq_back=F.col("seq_back")))
    known = lambda df: df.join(left.select(F.col("term").alias("l")), "l", "left_semi").join(
        right.select(F.col("term").alias("r")), "r", "left_semi"
    )
    if graph is not None:
        parts.append(rows(graph_hits(lf, rf, graph), graph=one))
    if vectors is not None:
        mine = canonical_vectors(lf, vectors)
        others = mine if left is right else canonical_vectors(rf, vectors)
        parts.append(rows(vector_join(mine, others, floor).pairs, cos=F.round("cos", 12)))  # equal ones tie, whatever the order of sums
    if cosines is not None:
        parts.append(rows(known(cosines).select("l", "r", "cos"), cos=F.col("cos")))
    union = parts[0]
    for p in parts[1:]:
        union = union.union(p)
    best = union.groupBy("l", "r").agg(*[F.max(n).alias(n) for n in ["eq", "acr", "tok", "seq", "seq_back", "graph", "cos"]])

    def lexical(seq: str) -> Column:
        return F.when(F.col("eq").isNotNull(), 1.0).when(F.col("acr").isNotNull(), 0.92).otherwise(F.greatest("tok", seq, F.lit(0.0)))

    hit = F.col("graph").isNotNull()
    return best.select(
        "l", "r", composite(lexical("seq"), hit, F.col("cos")).alias("sim"),
        composite(lexical("seq_back"), hit, F.col("cos")).alias("back"),
    ).where((F.col("sim") >= floor) | (F.col("back") >= floor))


def credit(similarity: Column, cfg=DEFAULT) -> Column:
    return F.when(similarity >= cfg.semantic, 1.0).when(similarity >= cfg.partial, 0.5).otherwise(0.0)
