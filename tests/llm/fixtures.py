"""Small tables with everything that may go wrong in them."""

import random

ALPHABET = "abcXYZ   \n\t'sé̀ßΣİı1２½!#$%<|>中😀\x1c\x85\xa0 \x07ǅ"


def odd_texts(n=150, seed=3):
    r = random.Random(seed)
    return ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 60))) for _ in range(n)] + [
        "", "  lead", "trail  ", "x" * 3000, "a<|endoftext|>b <|startoftext|>'ll we'LL", "\n\n a\n", "don't DON'T", "it is " * 4000]


def documents(spark, texts):
    """doc_id with repeats and a null, a null text, and columns whose names the operators use themselves."""
    rows = [(i, t, "en", "s", "x", 0, "k") for i, t in enumerate(texts)]
    rows += [(None, "some text", None, None, None, None, None), (10_000, None, None, None, None, None, None)] + rows[:2]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, ids string, n_tokens int, key string").repartition(3)


def none(spark, schema="doc_id long, text string, lang string, source string, n_chars long"):
    return spark.createDataFrame([], schema)
