"""The corpus pipeline, as the driver calls it; the stages are in ``titleloom.llm.pipeline``."""

from titleloom.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
