"""Small tables with every awkward case."""

import random
import re

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
DDL = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use themselves.
CLASHING = ["score", "predicted", "rejected", "copy", "n", "fp", "bucket", "shard", "slot", "piece", "c0", "found", "n_words", "kept_text", "lang_pred", "row", "key", "node", "rank", "__doc", "__copy", "__salt", "root", "blob", "doc", "none"]


def prose(rng, n, words=None):
    words = words or ["the", "river", "runs", "under", "stone", "bridges", "while", "people", "walk", "home", "slowly", "and", "sing", "old", "songs", "of", "winter", "light", "naïve", "straße"]
    return " ".join(rng.choice(words) + rng.choice(["", "", ",", "s"]) for _ in range(n))


def awkward(seed=1):
    rng = random.Random(seed)
    base = [prose(rng, rng.randint(25, 60)) for _ in range(14)]
    shared = prose(rng, 30)
    texts = [*base, None, "", " \n\t ", "a", base[0], base[0], base[3] + " " + shared, shared + "\n" + base[4], "x " * 50, base[5].replace("river", "lake"), "word" * 500, prose(rng, 3000), "<|endoftext|> <s> ▁ \u0000", "日本語のテキスト é 😀", "ok"]
    rows = [(i, t, rng.choice(["en", "de", None]), "src", len(t or "")) for i, t in enumerate(texts)]
    return [*rows, rows[2], rows[2], (None, base[1], None, None, None), (None, None, None, None, None), (7, "another text with the same number", "en", "src", 3)]


def table(spark, rows=None):
    return spark.createDataFrame(awkward() if rows is None else rows, DDL)


def clashing(df):
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit(f"own {c}") for c in CLASHING})


def text_key(value):
    return (value is not None, value)
