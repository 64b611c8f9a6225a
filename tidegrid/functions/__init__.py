"""Scalar expressions: every function takes and returns Columns and stays inside code generation."""

from .physics import *  # noqa: F403
from .scalar import *  # noqa: F403
