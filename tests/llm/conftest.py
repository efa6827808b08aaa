import random

import pytest

WORDS = "amber birch cedar delta ember frost grove heath inlet jetty knoll ledge marsh north ocean plain quarry ridge slope tidal under vale woods yield zenith".split()


def prose(seed: int, n: int, line: int = 12) -> str:
    """n random words in lines."""
    r = random.Random(seed)
    w = [r.choice(WORDS) + r.choice(["", "s", "ed", "ing", "ly"]) for _ in range(n)]
    return "\n".join(" ".join(w[i : i + line]) for i in range(0, n, line))


@pytest.fixture
def edge_docs(spark):
    """Nulls in any column, empty and blank texts, a very long one, repeated rows, ties, and columns that clash with inner names."""
    long_text = prose(1, 30_000)
    rows = [
        (1, prose(11, 80), "en", "a"),
        (1, prose(11, 80), "en", "a"),
        (2, None, "en", "a"),
        (3, "", None, "a"),
        (4, " \n\t ", "en", None),
        (None, prose(12, 80), "en", "b"),
        (None, None, None, None),
        (5, long_text, "de", "b"),
        (6, long_text, "de", "b"),
        (7, "one two", "en", "c"),
        (8, "é日本 🙂 mixed text ẞ", "en", "c"),
        (9, prose(13, 60) + "\npassword = \"Abc123def456\"\n" + prose(14, 30), "en", "c"),
    ]
    names = ["node", "label", "key", "_key", "_k", "_row", "row", "spans", "lines", "bucket", "w", "s", "len", "n_lines"]
    ddl = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names)
    return spark.createDataFrame([(*r, len(r[1] or ""), *["x"] * len(names)) for r in rows], ddl)
