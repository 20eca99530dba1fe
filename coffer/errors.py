"""One exception with the public error codes."""

from __future__ import annotations


class CofferError(Exception):
    def __init__(self, code: str, message: str, data: dict | None = None):
        super().__init__(f"{code}: {message}")
        self.code, self.message, self.data = code, message, data or {}
