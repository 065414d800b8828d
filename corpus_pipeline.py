"""The corpus pipeline of millrace.llm: STAGES, run and ORACLE_SQL, as the driver looks for them."""

from millrace.llm.pipeline import ORACLE_SQL, STAGES, classify, dedupe, encode, mix, redact, run

__all__ = ["ORACLE_SQL", "STAGES", "classify", "dedupe", "encode", "mix", "redact", "run"]
