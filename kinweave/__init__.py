"""Metadata-graph analytics over shared-membership tables, expressed as Spark DataFrame jobs."""

from kinweave.catalog import Catalog

__all__ = ["Catalog"]
