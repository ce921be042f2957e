"""The registered queries of the library."""

from . import catalogue, details, music, signals, storage, texts  # noqa: F401
from .registry import ORACLE_SQL, QUERIES  # noqa: F401
