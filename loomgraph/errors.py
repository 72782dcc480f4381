"""Errors by family; `kind` names the exact fault."""


class CypherError(Exception):
    def __init__(self, kind: str, detail: str = ""):
        super().__init__(f"{type(self).__name__}({kind}): {detail}")
        self.kind, self.detail = kind, detail


class CypherSyntaxError(CypherError):
    """The text or its meaning is wrong before any data is read."""


class CypherTypeError(CypherError):
    """An operand has the wrong type."""


class ArgumentError(CypherError):
    """An argument of the right type has a value that is not allowed."""


class EntityNotFound(CypherError):
    """A node or relationship is no longer there."""


class ProcedureError(CypherError):
    """A procedure is unknown or called wrongly."""


class ParameterMissing(CypherError):
    """A query parameter has no value."""


class UpdateError(CypherError):
    """A change would leave the graph unsound, or cannot be made as written."""
