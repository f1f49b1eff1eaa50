"""The corpus pipeline of concord.llm.pipeline, under the name its callers expect."""

from concord.llm.pipeline import MIN_SCORE, ORACLE_SQL, STAGES, VOCABULARY, language_id, mixture, near_duplicates, personal_data, pieces, run

__all__ = ["MIN_SCORE", "ORACLE_SQL", "STAGES", "VOCABULARY", "language_id", "mixture", "near_duplicates", "personal_data", "pieces", "run"]
