"""A small corpus with every odd case: nulls, empty and long texts, copies, near copies, shared lines and passages."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SYLLABLES = {"en": ["the", "er", "ing", "on", "and", "st"], "de": ["sch", "ein", "ung", "ich", "ge", "keit"], "fr": ["eau", "que", "les", "oi", "é", "tre"], "es": ["ción", "os", "ado", "ll", "ez", "ñ"]}
PASSAGE = " ".join(f"passage{k} of words" for k in range(20)) + "."
ITEM = "Which planet of the solar system is closest to the sun and how long does it take to go around it once? Mercury takes eighty eight days."


def sentence(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n)).capitalize() + "."


def documents(seed=0, n=60):
    rng, rows = random.Random(seed), []
    for k in range(n):
        lang = ["en", "de", "fr", "es"][k % 4]
        lines = [" ".join(sentence(rng, lang, rng.randint(3, 12)) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(2, 6))]
        rows.append((k, "\n".join(lines), lang, f"s{k % 3}"))
    text = {r[0]: r[1] for r in rows}
    extra = [
        (100, text[4], "en", "s0"),
        (101, text[4], "en", "s0"),
        (102, text[8] + " Added words.", "en", "s0"),
        (103, None, "en", "s0"),
        (104, "", "de", None),
        (105, "   \n\t ", None, "s1"),
        (106, "123 456 !!", "fr", "s1"),
        (107, text[12] + " " + PASSAGE + " " + text[16], "en", "s1"),
        (108, text[20] + "\n" + PASSAGE + "\n" + text[24], "en", "s1"),
        (109, text[28] + " " + ITEM + " " + text[32], "en", "s1"),
        (110, "All rights reserved here.\n" + text[36] + "\n  ALL RIGHTS RESERVED HERE.  ", "en", "s1"),
        (111, "all rights reserved here.\nshort\n" + text[40], "en", "s1"),
        (112, "short\nshort\n\n\n", "en", "s1"),
        (113, "a", "en", "s1"),
        (114, "▁x ▁▁ y\x00z\x1c é漢字🙂 <|endoftext|> <s>", "en", "s1"),
        (115, " ".join(sentence(rng, "en", 9) for _ in range(3000)), "en", "s1"),
        (116, "nospace" * 400, "en", "s1"),
        (None, text[44], "en", "s2"),
        (None, "lost id", "en", "s2"),
        (117, text[48], "en", "s2"),
        (117, text[48], "en", "s2"),
    ]
    rows += extra
    return [(*r, None if r[1] is None else len(r[1])) for r in rows]


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA)


def crowded(spark, rows=None):
    """The corpus with extra columns of the names that operators use inside."""
    from pyspark.sql import functions as F

    names = ["block", "kind", "key", "n", "h1", "h2", "ids", "fingerprint", "registers", "first", "lang_pred", "score", "a", "b", "node", "component", "rep", "t", "k", "l", "kept", "n_lines", "training", "range", "to", "tree", "node", "pos", "size", "h", "path", "part", "leaf", "root", "row", "grp", "least", "cold", "bits", "many", "tampered"]
    return frame(spark, rows).withColumns({c: F.lit("clash") for c in names})


def empty(spark):
    return frame(spark, [])


VECTORS = "vec_id long, embedding array<float>, label int"


def vectors(seed=0, n=420, dims=9):
    """Rows of embeddings: close ones and ties, negative and zero scores, nulls everywhere, numbers that aren't finite, repeated rows."""
    rng, rows = random.Random(seed), []
    centres = [[rng.uniform(-1, 1) for _ in range(dims)] for _ in range(4)]
    for k in range(n):
        near = rng.choice(centres)
        rows.append((k, [round(x + rng.uniform(-0.4, 0.4), 2) for x in near], None if k % 31 == 30 else rng.randrange(4)))
    rows += [(1000, rows[5][1], 1), (1001, rows[5][1], 2), (1002, rows[5][1], 1), (1100, [0.0] * dims, 1), (1101, [0.0] * dims, 2)]
    odd = [(1201, None, 1), (1202, [None] + [0.5] * (dims - 1), 1), (1203, [float("nan")] + [0.5] * (dims - 1), 1), (1204, [float("inf")] + [0.5] * (dims - 1), 2), (None, [0.5] * dims, 1), (1300, None, 1), (1400, [float("-inf")] * dims, 1), (1500, rows[5][1], None)]
    return rows + odd + [rows[0], rows[7], rows[100], rows[100]]
