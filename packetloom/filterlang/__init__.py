"""The filter language: text to predicates, predicates to Catalyst columns, split by the stage that can decide them."""

from packetloom.filterlang.compile import Filter, holds
from packetloom.filterlang.errors import FilterError

__all__ = ["Filter", "FilterError", "holds"]
