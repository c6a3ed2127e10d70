"""The document pipeline: its stages, its SQL and run(), as in emberframe.llm.pipeline."""

from emberframe.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
