"""Spark jobs around synthetic tables, and corpus operators in ``tabweave.llm``."""
