import os
import sys

import pytest
from pyspark.sql import Row

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

#: Names that the operators use themselves, given to columns that are none of their business.
EXTRA = ["size", "row", "start", "place", "shard", "slot", "copies", "comp", "fp", "code", "ids", "kept", "n_words", "verdict", "removed_lines"]
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed, n):
    out, x = [], seed * 7919 + 17
    for _ in range(n):
        x = (x * 1103515245 + 12345) % 2**31
        out.append(WORDS[(x >> 16) % len(WORDS)] + str((x >> 8) % 97))
    return " ".join(out)


def edge_rows():
    long = "\n".join(prose(k, 60) for k in range(400))
    texts = [None, "", " \t\n ", "one", prose(1, 80), prose(1, 80), prose(2, 80) + "\n" + prose(1, 80), long, "a " * 300, "Ünïcode ĐŽ 日本語 \U0001F600 " * 20]
    rows = [Row(doc_id=k, text=t, lang="en" if k % 2 else None, source=[None, "b", "a"][k % 3], n_chars=None) for k, t in enumerate(texts)]
    rows += [Row(doc_id=None, text=prose(3, 70), lang="xx", source="a", n_chars=1), Row(doc_id=None, text=None, lang=None, source=None, n_chars=None)]
    rows += [rows[4]] * 3  # repeated rows
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def edge(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(edge_rows(), SCHEMA)
    return df.select("*", *[F.lit(f"x{k}").alias(c) for k, c in enumerate(EXTRA)])


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
