"""Small documents with the odd cases that every operator must stand: nulls, empty texts, ties, repeated rows, a column named uid."""

from __future__ import annotations

import random
import re

import pytest

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, uid string"


def odd_rows(seed: int = 0, n: int = 60, repeated_ids: bool = True) -> list[tuple]:
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in ("the", "Éa", "in", "zu", "x") for b in ("", "re", "tion", "ß", "日", ".")]
    bases = [" ".join(rng.choice(vocabulary) for _ in range(rng.choice([3, 14, 30, 60]))) for _ in range(8)]
    rows = []
    for i in range(n):
        kind = rng.randrange(7)
        if kind == 0:
            text = rng.choice([None, "", " \n\t", "word", "a b c", "\x1c one\x85two three"])
        elif kind < 4:
            words = rng.choice(bases).split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            text = rng.choice([" ", "\n", "  "]).join(words)
        elif kind == 4:
            text = rng.choice(bases) + "\n" + rng.choice(bases)
        else:
            text = "\n".join(" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(12))) for _ in range(rng.randrange(1, 6)))
        rows.append((i * 3, text, rng.choice(["en", None]), rng.choice(["s0", "s0", "s1", "é", "", None]), len(text or ""), "clash"))
    if repeated_ids:
        rows += [rows[5], rows[7], (rows[9][0], "another text of the same id", None, "s1", 3, None), (None, "no id at all here", None, "s0", 1, None), (None, None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="session")
def plain(spark):
    """Without repeated or null ids."""
    return spark.createDataFrame(odd_rows(1, repeated_ids=False), SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
