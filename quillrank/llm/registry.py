"""The subpackage's queries by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import divergence, fim, neardup, pii, sharding, urls
from .byte_bpe import op12_byte_bpe
from .decontamination import op2_decontamination
from .fingerprints import op10_fingerprints
from .langid import op9_langid
from .lm import op1_lm
from .packing import op5_packing
from .token_files import op3_token_files


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_lm": op1_lm,
        "op2_decontamination": op2_decontamination,
        "op3_token_files": op3_token_files,
        "op4_pii": pii.op4_pii,
        "op5_packing": op5_packing,
        "op6_neardup": neardup.op6_neardup,
        "op7_urls": urls.op7_urls,
        "op8_sharding": sharding.op8_sharding,
        "op9_langid": op9_langid,
        "op10_fingerprints": op10_fingerprints,
        "op11_fill_in_middle": fim.op11_fill_in_middle,
        "op12_byte_bpe": op12_byte_bpe,
        "op13_divergence": divergence.op13_divergence,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_pii": pii.SQL, "op6_neardup": neardup.SQL, "op7_urls": urls.SQL, "op8_sharding": sharding.SQL, "op11_fill_in_middle": fim.SQL, "op13_divergence": divergence.SQL}
