"""Localization and text analytics, declared as Spark plans."""
