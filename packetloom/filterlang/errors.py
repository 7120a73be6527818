"""Errors of the filter language, all raised while a plan is made."""


class FilterError(ValueError):
    """Any error in a filter."""


class InvalidFormat(FilterError):
    """The text follows no rule of the grammar."""


class InvalidProtocol(FilterError):
    """There is no such protocol."""


class InvalidPatternLayers(FilterError):
    """No chain of protocols holds all those of one conjunction."""


class InvalidPredType(FilterError):
    """The predicate can't be decided at the stage it is asked at."""


class InvalidHeader(FilterError):
    """A header value is not available in the data."""


class InvalidField(FilterError):
    """The protocol has no such field."""


class InvalidBinOp(FilterError):
    """The operator doesn't go with the type of the value or field."""


class InvalidRhsType(FilterError):
    """The value's type doesn't go with the field."""


class InvalidRhsValue(FilterError):
    """The value can't be read."""


class InvalidInt(FilterError):
    """The number is no unsigned 64-bit integer."""


class InvalidIntRange(FilterError):
    """The range's start is not below its end."""


class InvalidAddress(FilterError):
    """The address can't be read."""


class InvalidPrefixLen(FilterError):
    """The prefix is longer than the address."""
