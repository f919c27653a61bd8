"""The corpus pipeline's stages, for the driver; they are defined in ``strandlake.llm.pipeline``."""

from __future__ import annotations

from strandlake.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
