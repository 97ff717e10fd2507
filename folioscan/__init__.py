"""Folioscan: document decoding, quote anchoring, page geometry and annotation history as Spark jobs."""

__version__ = "0.1.0"
