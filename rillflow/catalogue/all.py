"""Imports every group of queries, which registers them."""

from rillflow.catalogue import models, network, rasters, sections, series  # noqa: F401
from rillflow.catalogue.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
