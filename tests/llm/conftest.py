from __future__ import annotations

import pytest

pytest.importorskip("tidemark.llm")


@pytest.fixture(scope="session")
def samples(spark, data):
    return spark.read.parquet(f"{data}/lang_samples.parquet")


@pytest.fixture(scope="session")
def vocab(spark, data):
    return spark.read.parquet(f"{data}/token_vocab.parquet")
