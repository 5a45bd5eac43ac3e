import random

import pytest

#: Extra columns by names that operators use inside.
EXTRA = ("name", "rid", "pos", "n", "key", "keys", "h", "fp", "sha", "_sha", "_keep_id", "row", "at", "tie", "level", "rejected", "lang_pred", "p0", "kept", "class_id", "text_sha256", "node", "task", "places")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def make(spark, rows, extra=True):
    """A documents table of (doc_id, text, lang) with clashing extra columns."""
    cols = EXTRA if extra else ()
    schema = SCHEMA + "".join(f", {c} string" for c in cols)
    return spark.createDataFrame([(d, t, lang, None, None if t is None else len(t), *(["x"] * len(cols))) for d, t, lang in rows], schema)


def prose(rnd, n, vocabulary=400):
    return " ".join(f"w{rnd.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Null and empty texts, null ids, repeated rows and ids, ties, copies, near copies, a long text, odd spaces."""
    rnd = random.Random(5)
    base = prose(rnd, 120)
    near = base.split()
    near[60] = "changed"
    rows = [(1, None, None), (2, "", "en"), (3, base, "en"), (4, base, "fr"), (5, " ".join(near), "en"), (5, " ".join(near), "en"), (5, "same id other text", "en")]
    rows += [(None, base, "en"), (None, None, None), (6, base.replace(" ", "\n", 3), None), (7, "one", "en"), (8, "one  ", "en"), (9, "\t \n", "en"), (10, prose(rnd, 60_000, 5000), "en")]
    rows += [(11, "aaaa " * 300, "en"), (12, "x" * 5000, "en"), (13, "é漢😀 " * 40, "de"), (14, base + " tail of its own and more words to make it longer than thirteen", "en")]
    rows += [(20 + k, prose(rnd, 40) + " " + base[:300] + " " + prose(rnd, 40), ["en", "fr"][k % 2]) for k in range(12)]
    return rows
