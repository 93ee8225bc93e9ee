from __future__ import annotations

import pytest

from llm_edges import SCHEMA, edge_texts

pytest.importorskip("roundhouse.llm")

@pytest.fixture(scope="session")
def edge_docs(spark):
    rows = [(3 * i, t, None if i % 5 == 0 else "en", None if i % 7 == 0 else f"src{i % 3}", 0) for i, t in enumerate(edge_texts())]
    rows.append(rows[9])  # one row twice
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
