"""Registered queries of the corpus operators and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from . import bpe, decontamination, license_scan, media_audio, merkle_manifest, pair_index_bpe, pii, quality, secret_scan, simhash_golay, sst_output, substring_dedup, token_alignment
from .common import table

ORACLE: dict[str, str] = {"op12_merkle_intervals": merkle_manifest.SQL}


def queries() -> dict:
    docs = lambda s, d: table(s, d, "documents")
    return {
        "op1_secret_ownership": lambda s, d: secret_scan.op1(docs(s, d)),
        "op2_pii_disclosure": lambda s, d: pii.op2(docs(s, d)),
        "op3_wu_manber_decontamination": lambda s, d: decontamination.op3(docs(s, d), table(s, d, "benchmark")),
        "op4_byte_bpe": lambda s, d: bpe.op4(docs(s, d)),
        "op5_debruijn_dedup": lambda s, d: substring_dedup.op5(docs(s, d)),
        "op6_sst_tokens": lambda s, d: sst_output.op6(docs(s, d)),
        "op7_mpeg_audio": lambda s, d: media_audio.op7(docs(s, d)),
        "op8_quality_qda": lambda s, d: quality.op8(docs(s, d), table(s, d, "labels")),
        "op9_license_index": lambda s, d: license_scan.op9(docs(s, d)),
        "op10_simhash_golay": lambda s, d: simhash_golay.op10(docs(s, d)),
        "op11_pair_index_bpe": lambda s, d: pair_index_bpe.op11(docs(s, d)),
        "op12_merkle_intervals": lambda s, d: merkle_manifest.op12(docs(s, d)),
        "op13_lockstep_alignment": lambda s, d: token_alignment.op13(docs(s, d)),
    }


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
