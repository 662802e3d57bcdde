"""The queries of this subpackage and of ``corpus_pipeline``, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from loomery.llm import bpe, fingerprint, language, linededup, lm, minhash, negatives, neighbours, packing, pages, secrets, simhash, whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "pipeline": corpus_pipeline.run,
        "op1_fingerprint": fingerprint.op1_fingerprint,
        "op2_lm": lm.op2_lm,
        "op3_html": pages.op3_html,
        "op4_bpe": bpe.op4_bpe,
        "op5_secrets": secrets.op5_secrets,
        "op6_linededup": linededup.op6_linededup,
        "op7_ann": neighbours.op7_ann,
        "op8_minhash": minhash.op8_minhash,
        "op9_packing": packing.op9_packing,
        "op10_language": language.op10_language,
        "op11_simhash": simhash.op11_simhash,
        "op12_negatives": negatives.op12_negatives,
        "op13_whitening": whitening.op13_whitening,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_linededup": linededup.OP6_SQL, "op8_minhash": minhash.OP8_SQL, "op12_negatives": negatives.OP12_SQL} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
