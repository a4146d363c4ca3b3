"""The one exception type users see: a stable code, a message and details."""

from __future__ import annotations


class CleanError(Exception):
    def __init__(self, code: str, message: str, **details):
        super().__init__(f"[{code}] {message}")
        self.code = code
        self.message = message
        self.details = details
