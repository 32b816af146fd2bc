"""Every registered query, by the operator it exercises."""

from tidewarden.catalog import flows, decisions, metrics, logs, models, streams  # noqa: F401, I001
from tidewarden.catalog.registry import ORACLES, QUERIES  # noqa: F401
