"""Automatic profiling and dashboards for tables of any size, on Spark DataFrames."""

from colonnade.config import ProfileConfig
from colonnade.dataset import Dataset
from colonnade.errors import DatasetError
from colonnade.operators.filters import CategoryFilter, DateFilter, NumberFilter
from colonnade.operators.schema import Profile
from colonnade.plans.analysis import Analysis, analyze

__all__ = [
    "Analysis",
    "CategoryFilter",
    "Dataset",
    "DatasetError",
    "DateFilter",
    "NumberFilter",
    "Profile",
    "ProfileConfig",
    "analyze",
]
