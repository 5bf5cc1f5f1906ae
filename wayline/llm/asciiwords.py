"""Words of letters and digits, with A-Z lowered, for tasks in Python."""

from __future__ import annotations

#: ASCII but digits and letters parts words; whatever lies beyond ASCII belongs to them.
_PLAIN = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256)).lower()


def words(text: bytes) -> list[bytes]:
    """The runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` of a text in UTF-8 once its A-Z are lowered."""
    return text.translate(_PLAIN).split()
