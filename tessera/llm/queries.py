"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontamination, jpeg, licenses, manifest, mixing, pii, quality, repair, sharding, simhash, suffixes, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_chat": chat.op1_chat,
        "op2_mixing": mixing.op2_mixing,
        "op3_pii": pii.op3_pii,
        "op4_decontamination": decontamination.op4_decontamination,
        "op5_simhash": simhash.op5_simhash,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_sharding": sharding.op7_sharding,
        "op8_suffixes": suffixes.op8_suffixes,
        "op9_media": jpeg.op9_media,
        "op10_quality": quality.op10_quality,
        "op11_repair": repair.op11_repair,
        "op12_manifest": manifest.op12_manifest,
        "op13_licenses": licenses.op13_licenses,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_chat": chat.OP1_SQL, "op4_decontamination": decontamination.OP4_SQL}
