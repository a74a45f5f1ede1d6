"""The registered queries of this subpackage; their SQL, where there is any, is in `statements`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from relaymill.llm.conversation_repair import op13_conversation_repair
from relaymill.llm.fingerprints import op10_fingerprints
from relaymill.llm.language_id import op6_language_id
from relaymill.llm.licence_scan import op2_licence_scan
from relaymill.llm.merkle import op12_merkle
from relaymill.llm.mixing import op11_mixing
from relaymill.llm.ngram_jaccard import op1_ngram_jaccard
from relaymill.llm.packing import op9_packing
from relaymill.llm.quality_classifier import op3_quality_classifier
from relaymill.llm.quality_rules import op7_quality_rules
from relaymill.llm.secret_scan import op5_secret_scan
from relaymill.llm.sharding import op8_sharding
from relaymill.llm.statements import statements
from relaymill.llm.tokens import op4_bpe

__all__ = ["queries", "statements"]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_jaccard": op1_ngram_jaccard,
        "op2_licence_scan": op2_licence_scan,
        "op3_quality_classifier": op3_quality_classifier,
        "op4_bpe": op4_bpe,
        "op5_secret_scan": op5_secret_scan,
        "op6_language_id": op6_language_id,
        "op7_quality_rules": op7_quality_rules,
        "op8_sharding": op8_sharding,
        "op9_packing": op9_packing,
        "op10_fingerprints": op10_fingerprints,
        "op11_mixing": op11_mixing,
        "op12_merkle": op12_merkle,
        "op13_conversation_repair": op13_conversation_repair,
    }
