from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, key string, shard int, score double, bucket long, pos int, row string, sig binary, mark long"


def prose(seed: int, n: int, vocabulary: int = 400) -> str:
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" + r.choice(["", "", ".", ","]) for _ in range(n))


def texts() -> list[tuple[int | None, str | None]]:
    """Nulls, empty and very long texts, copies, near copies, shared passages, ties, and rows of one doc_id."""
    base, passage = prose(1, 200), prose(2, 60)
    near = base.split()
    near[17] = "changed"
    far = base.split()
    far[::9] = ["other"] * len(far[::9])
    rows = [(5, base), (3, base), (9, base.upper()), (4, " ".join(near)), (21, " ".join(far)), (6, None), (7, ""), (8, " \n\t "), (10, "one"), (11, "one two three"), (12, prose(3, 49)), (13, prose(3, 50)), (14, prose(3, 51)), (15, "x" * 9000), (16, prose(4, 30) + " " + passage + " " + prose(5, 30)), (17, passage + " " + prose(6, 40)), (18, "mail a.b@c.example.org now, +1 (555) 010-2030, 10.0.0.1, 4111 1111 1111 1111"), (19, "naïve   thin space Ärger É"), (20, prose(7, 6000, 3000)), (22, "same same " * 80), (23, "same same " * 80 + "end"), (None, base), (None, None), (30, prose(8, 100)), (30, prose(9, 100)), (31, prose(10, 70)), (31, prose(10, 70)), (32, prose(11, 90)), (32, " ".join([*base.split()[:-1], "ends"]))]
    return rows


@pytest.fixture(scope="session")
def docs(spark):
    rows = [(i, t, "en" if k % 3 else None, f"s{k % 5}" if k % 4 else None, None, 1, "k", k, 0.5, None, k, "r", None, None) for k, (i, t) in enumerate(texts())]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark, docs):
    return docs.limit(0)
