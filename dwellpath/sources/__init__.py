"""Readers and writers."""

from dwellpath.sources.stages import clean_stage, read_stage, write_stage
from dwellpath.sources.tables import read_admins, read_pings

__all__ = ["clean_stage", "read_admins", "read_pings", "read_stage", "write_stage"]
