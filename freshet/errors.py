"""Errors that a statement's author can mend."""


class StatementError(ValueError):
    """A statement that can't be parsed, typed or deployed; points at the place where it is known."""

    def __init__(self, message: str, text: str = "", at: int | None = None):
        self.message, self.at = message, at
        if at is not None and text:
            start = text.rfind("\n", 0, at) + 1
            end = text.find("\n", at)
            line = text[start : len(text) if end < 0 else end]
            message = f"{message} (line {text.count(chr(10), 0, at) + 1} column {at - start + 1})\n{line}\n{' ' * (at - start)}^"
        super().__init__(message)
