"""Connected components are the base library's."""

from ..operators.components import components

__all__ = ["components"]
