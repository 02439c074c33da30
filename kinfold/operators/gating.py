"""Which relations permit which structural actions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def allowed(kind: Column, relation: Column, direction: Column) -> Column:
    """merge: EXACT or PERCEPTUAL. parameterize: SEMANTIC_PRESERVING, or SUBSUMPTION of the first by the second. Others aren't gated here."""
    merge = relation.isin("EXACT", "PERCEPTUAL")
    fold = (relation == "SEMANTIC_PRESERVING") | ((relation == "SUBSUMPTION") & (direction == "B_SUBSUMES_A"))
    return F.when(kind == "merge", merge).when(kind == "parameterize", fold)


def advice(kind: Column, relation: Column, direction: Column) -> Column:
    """What a denied action might be instead."""
    swap = (kind == "parameterize") & (relation == "SUBSUMPTION") & (direction != "B_SUBSUMES_A")
    return F.when(allowed(kind, relation, direction), F.lit("")).when(swap, F.lit("swap operands")).otherwise(F.lit("keep_separate"))


def executable(trusted: Column, allow_untrusted: bool = False, hardened: bool = False) -> Column:
    """Trusted, or untrusted where that is allowed and the executor is hardened."""
    return trusted | F.lit(allow_untrusted and hardened)
