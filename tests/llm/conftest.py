import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omikron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed: int, n: int) -> str:
    """Repeatable pseudo-random words."""
    out, state = [], seed * 2654435761 % 2**32
    for _ in range(n):
        state = (state * 1103515245 + 12345) % 2**31
        out.append(WORDS[(state >> 8) % len(WORDS)] + WORDS[(state >> 14) % len(WORDS)])
    return " ".join(out)


EDGES = [
    (1, prose(1, 120), "en", "a"), (2, prose(1, 120), "en", "a"), (2, prose(1, 120), "en", "a"), (3, prose(1, 119) + " other", "en", None),
    (4, None, "en", "a"), (5, "", None, "b"), (6, " \n\t ", "de", "b"), (7, "one two", "de", "b"), (8, "ONE Two", None, None),
    (None, prose(9, 60), "de", "b"), (None, None, None, None), (10, prose(10, 6000), "de", "a"), (11, "x" * 40000, "en", "a"),
    (12, "naïve café 日本語 \U0001F600 mail a.b@c.example.org ip 10.0.0.7", "fr", "b"), (13, "### $$$ %%% 123", "fr", "b"),
]


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names the operators use inside."""
    rows = [(i, t, la, so, len(t or ""), 1, "r", 2.0, [1], "k") for i, t, la, so in EDGES]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key int, row string, score double, ids array<int>, label string").repartition(3)


@pytest.fixture(scope="session")
def docs_folder(spark, edge_docs, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("edges"))
    edge_docs.write.parquet(f"{folder}/documents.parquet")
    return folder


@pytest.fixture(scope="session")
def empty_folder(edge_docs, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("none"))
    edge_docs.where("false").write.parquet(f"{folder}/documents.parquet")
    return folder
