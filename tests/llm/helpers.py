"""Small tables with every awkward row: nulls, empty and long texts, ties, repeated rows, clashing column names."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars int, size long, key long, hub string, score double"


def prose(seed: int, n: int, parts=("th", "in", "er", "an", "ou", "re", "st", "on")) -> str:
    r = random.Random(seed)
    out = ["".join(r.choice(parts) for _ in range(r.randint(1, 4))) for _ in range(n)]
    return " ".join(w + r.choice(["", "", "", ",", ".", ".\n"]) for w in out)


def awkward_texts() -> list[tuple[int | None, str | None]]:
    base = prose(1, 120)
    near = base.split(" ")
    near[50] = "changed"
    return [
        (1, None), (2, ""), (3, "  \n\t "), (4, "one"), (5, "one two three four"), (6, "one two three four"),
        (7, base), (8, " ".join(near)), (9, base), (9, base), (10, prose(2, 30_000)), (11, "x" * 300_000),
        (12, prose(3, 60) + " " + base), (13, "a b c d e f"), (14, "a b c d e g"), (None, base), (None, None),
        (15, "naïve ÉTÉ <|endoftext|> it's 42 😀"), (16, "A B C D E F"),
    ]


def table(spark, rows, extra=True):
    data = [(i, t, "en", None if i == 4 else f"s{(i or 0) % 3}", len(t or ""), 1, 2, "h", 0.5) for i, t in rows]
    return spark.createDataFrame(data, DOCS)


def rows(df, *columns):
    return sorted(([r[c] for c in columns] for r in df.collect()), key=str)
