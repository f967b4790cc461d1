import random

import pytest

# Names the operators use inside: as extra columns of the input they must do no harm.
CLASHES = ["id", "rest", "row_no", "node", "key", "whole", "kept", "class_id", "score", "shard", "spans", "ids", "lang_pred", "__word", "no", "host"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("aeioulnrst") for _ in range(r.randint(2, 9))) for _ in range(n))


def odd_rows():
    base = prose(1, 60)
    words = base.split()
    texts = [
        (1, base), (2, base), (3, base.replace(" ", " \n\t ")), (4, " ".join([*words[:30], "changed", *words[31:]])), (None, base), (5, None),
        (6, ""), (7, "!!! ??? ..."), (8, "one"), (8, "one"), (9, "one two three"), (10, prose(2, 40)), (10, prose(3, 40)), (11, "é" * 3000),
        (12, prose(4, 20_000)), (13, " \u2003\u00a0 "), (14, None), (None, None), (15, "x" * 20_000 + " y"), (16, " ".join(reversed(words))),
    ]
    return [(i, t, None if k % 5 == 4 else "en", None if k % 3 == 1 else f"s{k % 2}", None if t is None else len(t), *["clash"] * len(CLASHES)) for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
