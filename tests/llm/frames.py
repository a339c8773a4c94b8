"""Small tables with the rows that operators stumble over."""

import re

DOCS = "doc_id long, text string, kept string, score string, _text string, fp string, word string"

SPACE = " \t\n\x0b\x0c\r"


def documents(spark, rows):
    """(doc_id, text) rows, with more columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "x", "y", "z", "u", "v") for i, t in rows], DOCS)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def passage(seed, n):
    """n distinct-looking words."""
    return " ".join(f"w{(seed * 7919 + i * 104729) % 99991}x{seed}" for i in range(n))


ODD = [
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "one"),
    (5, "one two"),
    (6, "One TWO three"),
    (7, "one two three"),
    (7, "one two three"),
    (None, "one two three"),
    (None, None),
    (8, "Ünïcode   wörds here 漢字 🙂 \x1c end"),
    (9, passage(3, 40)),
    (10, passage(3, 40)),
    (11, "lead in " + passage(3, 40) + " and out"),
    (12, passage(4, 30_000)),
]
