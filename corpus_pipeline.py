"""From raw documents to packed sequences: quality rules, language ID, near duplicates, repeated passages, packing.

Each stage works on all its predecessor kept.  All but the last return the columns of ``documents``.  No stage can be
said in SQL as a whole (language ID and packing cannot), so ``ORACLE_SQL`` is None; the tests hold the operator of each
stage against a brute-force version, and the stages against what they have to keep and drop.
"""

from __future__ import annotations

from mixlens.llm.stages import COLUMNS, STAGES, run

__all__ = ["COLUMNS", "ORACLE_SQL", "STAGES", "run"]

ORACLE_SQL = None
