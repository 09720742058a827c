"""What callers may catch."""


class QueryError(ValueError):
    """A filter, update, pipeline or option that is not allowed or not known."""


class DuplicateKey(ValueError):
    """An id or a unique index value that is there already."""


class Conflict(RuntimeError):
    """Another writer published first."""


class ValidationError(ValueError):
    def __init__(self, errors: list):
        super().__init__(f"{len(errors)} validation errors")
        self.errors = errors
