"""Distributed feature engineering, sampling, training and scoring for rounds of board games."""

from roundhouse.dims import Dims
from roundhouse.functions.board import BoardEncoder
from roundhouse.session import get_spark

__all__ = ["BoardEncoder", "Dims", "get_spark"]
