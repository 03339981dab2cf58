"""Column expressions and fixed values."""

from . import columns, fixed  # noqa: F401
