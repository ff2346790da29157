"""The registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from symloom.llm.ann import op10_nearest
from symloom.llm.minhash_dedup import op5_minhash_dedup
from symloom.llm.mixing import op2_mixing
from symloom.llm.packing import op7_packing
from symloom.llm.quality import op6_quality
from symloom.llm.secrets import SQL as SECRETS_SQL
from symloom.llm.secrets import op8_secrets
from symloom.llm.sharding import op4_sharding
from symloom.llm.token_store import op1_token_store
from symloom.llm.url_filter import op9_url_filter
from symloom.llm.vector_dedup import op3_vector_dedup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_store": op1_token_store,
    "op2_mixing": op2_mixing,
    "op3_vector_dedup": op3_vector_dedup,
    "op4_sharding": op4_sharding,
    "op5_minhash_dedup": op5_minhash_dedup,
    "op6_quality": op6_quality,
    "op7_packing": op7_packing,
    "op8_secrets": op8_secrets,
    "op9_url_filter": op9_url_filter,
    "op10_nearest": op10_nearest,
}

SQL: dict[str, str] = {
    "op8_secrets": SECRETS_SQL,
}
