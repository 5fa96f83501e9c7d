"""The queries of this folder, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from tessera.llm import bpe, chat, classifier, mixing, phrases, rules, secrets, simhash, suffix, warc


def queries() -> dict[str, Callable]:
    return {
        "op1_chat_format": chat.op1_chat_format,
        "op2_quality_rules": rules.op2_quality_rules,
        "op3_quality_classifier": classifier.op3_quality_classifier,
        "op4_suffix_dedup": suffix.op4_suffix_dedup,
        "op5_arc_to_warc": warc.op5_arc_to_warc,
        "op6_mixing": mixing.op6_mixing,
        "op7_byte_bpe": bpe.op7_byte_bpe,
        "op8_simhash": simhash.op8_simhash,
        "op9_secret_scan": secrets.op9_secret_scan,
        "op10_phrase_fingerprint": phrases.op10_phrase_fingerprint,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_chat_format": chat.OP1_SQL,
        "op2_quality_rules": rules.OP2_SQL,
        "op4_suffix_dedup": suffix.OP4_SQL,
        "op5_arc_to_warc": warc.OP5_SQL,
        "op6_mixing": mixing.OP6_SQL,
    }
