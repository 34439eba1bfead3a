"""The registered queries of this subpackage: thin, whole-table, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fareindex.llm import codes, langid, lm_score, media, minhash, oracles, packing, phrases, pieces, pii, secret_scan, simhash, syncmers, toxicity
from fareindex.llm.common import documents


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_media": lambda s, d: media.media_digest(documents(s, d), ["doc_id"]),
        "op2_pii": lambda s, d: pii.personal_data_digest(documents(s, d)),
        "op3_lm_score": lambda s, d: lm_score.quality_scores(documents(s, d), _labels(s, d)),
        "op4_pieces": lambda s, d: pieces.piece_digest(documents(s, d)),
        "op5_language": lambda s, d: langid.language_digest(documents(s, d)),
        "op6_secrets": lambda s, d: secret_scan.secret_digest(documents(s, d)),
        "op7_simhash": lambda s, d: simhash.simhash_digest(documents(s, d)),
        "op8_packing": lambda s, d: packing.pack(documents(s, d)),
        "op9_toxicity": lambda s, d: toxicity.toxicity_digest(documents(s, d), _labels(s, d)),
        "op10_syncmers": lambda s, d: syncmers.syncmer_digest(documents(s, d)),
        "op11_codes": lambda s, d: codes.code_digest(s.read.parquet(f"{d}/embeddings.parquet")),
        "op12_minhash": lambda s, d: minhash.minhash_digest(documents(s, d)),
        "op13_phrases": lambda s, d: phrases.collocations(documents(s, d)),
    }


def oracle_sql() -> dict[str, str]:
    return {"op11_codes": oracles.CODES, "op12_minhash": oracles.SIMILAR, "op13_phrases": oracles.PHRASES}
