"""PySpark engine for streaming transcripts and document distillation."""
