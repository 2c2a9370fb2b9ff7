"""The four steps of an analysis by name: read, profile, prepare, diagnose."""

from multifactor.operators.adequacy import diagnose
from multifactor.operators.prepare import prepare
from multifactor.operators.profile import profile as profile_columns
from multifactor.sources.delimited import read_file

__all__ = ["diagnose", "prepare", "profile_columns", "read_file"]
