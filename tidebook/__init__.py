"""Ownership-flow analytics as Spark DataFrame operators."""

from tidebook.config import ScanConfig, ScoreWeights
from tidebook.session import build_session

__all__ = ["ScanConfig", "ScoreWeights", "build_session"]
