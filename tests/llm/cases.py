"""Small tables with what goes wrong: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

WORDS = [f"w{i}" for i in range(60)] + ["The", "the", "of", "été", "größe"]


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


def texts() -> list[tuple[int | None, str | None]]:
    base = prose(1, 120)
    words = base.split()
    near = " ".join(words[:60] + ["changed"] + words[61:])
    shared = prose(2, 50)
    rows = [
        (1, base), (2, base), (3, near), (4, base.upper()), (5, None), (6, ""), (7, " \t\n "), (8, "one"), (9, "one two"),
        (10, "one two"), (11, prose(3, 40) + "\n" + shared + "\x0b" + prose(4, 40)), (12, shared + " tail " + prose(5, 20)),
        (13, "ab " * 80), (14, "é" * 3000), (15, prose(6, 4000)), (16, "same same same"), (16, "same same same"),
        (17, "other text of one id"), (17, base), (None, base), (None, None), (18, "emoji 😀   wide space"),
        (19, near.replace("w1", "w2", 1)), (20, "the end"), (21, 'x\\"y\n\n|z'),
    ]
    return rows + [(100 + i, prose(100 + i, 30 + i)) for i in range(25)]


def docs(spark, rows=None):
    """Documents with columns whose names an operator might use itself."""
    rows = texts() if rows is None else rows
    return spark.createDataFrame([(i, t, "en", None, len(t or ""), 1, "x", None) for i, t in rows],
                                 "doc_id bigint, text string, lang string, source string, n_chars bigint, n int, "
                                 "same string, first bigint")


def labels(spark, rows=None):
    """Good documents are plain; bad ones shout. Toxic ones insult."""
    return spark.createDataFrame(rows if rows is not None else
                                 [(i, int(i % 3 > 0), int(i % 5 == 0)) for i in range(1000, 1240)]
                                 + [(None, 1, 1), (1000, 1, None), (1001, None, 0), (1001, None, 0)],
                                 "doc_id bigint, quality int, toxic int")


def labelled_docs(spark):
    rows = []
    for i in range(1000, 1240):
        text = prose(i, 60)
        if i % 3 == 0:
            text = text.upper().replace(" ", "!! ")
        if i % 5 == 0:
            text += " idiot scum " + prose(i + 1, 5) + " moron"
        rows.append((i, text))
    return docs(spark, rows + texts())
