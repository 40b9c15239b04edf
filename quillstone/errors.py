"""One exception for each class of failure a statement can have."""


class DialectError(Exception):
    """Base of all errors that a statement raises."""


class SyntaxFailure(DialectError):
    """The text is no statement of the dialect."""


class InternalError(DialectError):
    """A rule of the dialect is broken in a way that has no class of its own."""


class TableNotFoundError(DialectError):
    def __init__(self, name: str):
        super().__init__(f"no table {name}")


class TableExistsError(DialectError):
    def __init__(self, name: str):
        super().__init__(f"table {name} is there already")


class ColumnNotFoundError(DialectError):
    def __init__(self, name: str):
        super().__init__(f"no column {name}")


class AmbiguousColumnError(DialectError):
    def __init__(self, name: str):
        super().__init__(f"several tables have a column {name}")


class IndexNotFoundError(DialectError):
    def __init__(self, table: str, columns):
        super().__init__(f"no index {table}({', '.join(columns)})")


class IndexExistsError(DialectError):
    def __init__(self, table: str, columns):
        super().__init__(f"index {table}({', '.join(columns)}) is there already")


class UniqueKeyError(DialectError):
    """A key of an index would be there twice."""


class InvalidValueCountError(DialectError):
    """INSERT has more or fewer values than the table has columns."""


class InvalidColumnLengthError(DialectError):
    """A column is declared with an impossible length."""


class StringOverflowError(DialectError):
    """A string is longer than its column."""


class IncompatibleTypeError(DialectError):
    def __init__(self, left: str, right: str):
        super().__init__(f"{left} and {right} don't go together")


class FileMissingError(DialectError):
    """LOAD names a file that isn't there."""


class LoadError(DialectError):
    """A CSV row doesn't fit its table."""


class TransactionAbortError(DialectError):
    """The transaction lost against another one, or a statement in it failed."""


class StatementNotFoundError(DialectError):
    """No prepared statement has this number."""


class BatchError(DialectError):
    """An operation of a batch failed; ``index`` tells which."""

    def __init__(self, index: int, cause: Exception):
        super().__init__(f"operation {index}: {cause}")
        self.index, self.cause = index, cause
