"""All queries over the engine's own operators."""

from tessera.plans import bench, sequences, system, text, vectors  # noqa: F401
from tessera.registry import COVERS, ORACLE, QUERIES  # noqa: F401
