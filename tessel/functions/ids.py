"""Small driver-side decisions: request ids and output dimensions."""

from __future__ import annotations

import re
import uuid


def request_id(text: str) -> str:
    """A UUID in canonical form or an upper-case ULID."""
    try:
        return str(uuid.UUID(text))
    except ValueError:
        if re.fullmatch(r"[0-7][0-9A-HJKMNP-TV-Z]{25}", text.upper()):
            return text.upper()
        raise ValueError("a request id is a UUID or a ULID") from None


def output_dimensions(asked: int | None, native: int, supported: tuple[int, ...] = ()) -> int:
    """Dimensions that vectors get; an error where the model cannot give what is asked."""
    if native < 1 or (asked is not None and asked < 1):
        raise ValueError("dimensions must be positive")
    if asked is None or asked == native:
        return native
    if asked > native:
        raise ValueError("more dimensions than the model has")
    if asked in supported:
        return asked
    raise ValueError("the model cannot be shortened to these dimensions")
