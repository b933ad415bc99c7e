"""Queries of the training-data operators and the statements they must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tillroll.llm import bpe, chat, exact, fingerprint, license, merkle, mixing, near, pii, quality, secrets, substring, trie


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_exact_dedup": exact.op1_exact_dedup,
        "op2_substring_dedup": substring.op2_substring_dedup,
        "op3_bpe": bpe.op3_bpe,
        "op4_quality_rules": quality.op4_quality_rules,
        "op5_license_scan": license.op5_license_scan,
        "op6_secret_scan": secrets.op6_secret_scan,
        "op7_mixing": mixing.op7_mixing,
        "op8_minhash_near_dedup": near.op8_minhash_near_dedup,
        "op9_pii": pii.op9_pii,
        "op10_chat_format": chat.op10_chat_format,
        "op11_prefix_trie": trie.op11_prefix_trie,
        "op12_merkle_manifest": merkle.op12_merkle_manifest,
        "op13_fingerprint": fingerprint.op13_fingerprint,
    }


STATEMENTS = {
    "op1_exact_dedup": exact.SQL,
    "op7_mixing": mixing.SQL,
    "op10_chat_format": chat.SQL,
    "op11_prefix_trie": trie.SQL,
    "op12_merkle_manifest": merkle.SQL,
}
