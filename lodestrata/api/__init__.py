"""The engine as calls: each returns one mapping with a status (ok, partial, deferred, failed, not_found), never an exception for what a user asked wrongly."""

from lodestrata.api.engine import Engine
from lodestrata.api.settings import Settings

__all__ = ["Engine", "Settings"]
