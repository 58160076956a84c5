"""Reading of command-line style settings."""

from __future__ import annotations

import posixpath

_TRUE, _FALSE = frozenset({"true", "t", "yes", "y", "1"}), frozenset({"false", "f", "no", "n", "0"})
_UNITS = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
LEAST_BYTES = 200 << 10


def folder_and_file(path: str) -> tuple[str, str]:
    """A path's folder and file name; a path that ends with a slash, '.' or '..' is a folder."""
    folder, name = posixpath.split(path)
    return (posixpath.join(folder, name), "") if name in (".", "..") else (folder or ".", name)


def as_list(text: str | None, separator: str = ",") -> list[str]:
    """The non-empty parts of a separated list, trimmed."""
    return [p for p in (x.strip() for x in (text or "").split(separator)) if p]


def as_bool(value: str | bool | None) -> bool:
    """Truth of a setting; anything but the usual words is refused."""
    if isinstance(value, bool):
        return value
    low = (value or "").strip().lower()
    if low not in _TRUE | _FALSE:
        raise ValueError(f"neither true nor false: {value!r}")
    return low in _TRUE


def size_in_bytes(text: str) -> int:
    """A file size such as 500K, 1M or 2G, at least 200 KiB; 0 is unlimited."""
    t = text.strip().lower()
    n = int(float(t[:-1]) * _UNITS[t[-1]]) if t[-1:] in _UNITS else int(t)
    if n and n < LEAST_BYTES:
        raise ValueError("files must hold at least 200 KiB")
    return n
