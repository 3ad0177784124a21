"""Corpus analytics on Spark: source files and texts as tables."""

from corpusloom.settings import Settings

__all__ = ["Settings"]
