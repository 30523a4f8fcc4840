"""The corpus pipeline's stages and queries; quillet/llm/pipeline.py has them."""

from __future__ import annotations

from quillet.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
