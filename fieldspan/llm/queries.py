"""The text operators as queries over the driver's tables, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontam, fingerprint, langid, lexical, linecrf, negatives, pieces, ppm, secrets, sharding, simhash, substring
from .oracles import ORACLES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_fingerprints": lambda s, d: fingerprint.fingerprints(table(s, d, "documents")),
        "op2_sharding": lambda s, d: sharding.shards(table(s, d, "documents")),
        "op3_ppm": lambda s, d: ppm.score(table(s, d, "documents")),
        "op4_pieces": lambda s, d: pieces.encode(table(s, d, "documents")),
        "op5_simhash": lambda s, d: simhash.near_duplicates(table(s, d, "documents")),
        "op6_substring": lambda s, d: substring.removed(table(s, d, "documents")),
        "op7_decontamination": lambda s, d: decontam.contaminated(table(s, d, "documents"), table(s, d, "benchmark")),
        "op8_chat": lambda s, d: chat.rotated(table(s, d, "conversations")),
        "op9_language": lambda s, d: langid.identify(table(s, d, "documents")),
        "op10_secrets": lambda s, d: secrets.scan(table(s, d, "documents")),
        "op11_line_field": lambda s, d: linecrf.quality(table(s, d, "documents"), table(s, d, "labels")),
        "op12_hard_negatives": lambda s, d: negatives.hard_negatives(table(s, d, "embeddings")),
        "op13_search": lambda s, d: lexical.search(table(s, d, "documents"), table(s, d, "benchmark")),
    }


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
