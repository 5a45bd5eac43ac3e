"""SHA-256 whose state can be handed on, so that several tasks can hash one text, each its own part."""

from __future__ import annotations

import ctypes
import hashlib
from functools import cache

#: Bytes of OpenSSL's SHA256_CTX.
STATE = 112


@cache
def _openssl():
    """The library that Python's own hashes are linked with; None if it doesn't offer what is needed."""
    try:
        import _hashlib

        lib = ctypes.CDLL(_hashlib.__file__)
        lib.SHA256_Init.argtypes = [ctypes.c_void_p]
        lib.SHA256_Update.argtypes = [ctypes.c_void_p, ctypes.c_char_p, ctypes.c_size_t]
        lib.SHA256_Final.argtypes = [ctypes.c_char_p, ctypes.c_void_p]
    except (ImportError, OSError, AttributeError):
        return None
    return lib


def can_hand_on() -> bool:
    return _openssl() is not None


class Sha256:
    """As hashlib.sha256(), and state() is what another one, of any process, can go on from."""

    def __init__(self, state: bytes | None = None):
        self.lib, self.whole = _openssl(), None
        if self.lib is None:
            if state:
                raise RuntimeError("no OpenSSL functions to go on from a state with")
            self.whole = hashlib.sha256()
            return
        self.context = ctypes.create_string_buffer(state, STATE) if state else ctypes.create_string_buffer(STATE)
        if not state:
            self.lib.SHA256_Init(self.context)

    def update(self, data: bytes) -> None:
        if self.whole is not None:
            self.whole.update(data)
        else:
            self.lib.SHA256_Update(self.context, data, len(data))

    def state(self) -> bytes:
        return b"" if self.whole is not None else self.context.raw

    def hexdigest(self) -> str:
        if self.whole is not None:
            return self.whole.hexdigest()
        copy, out = ctypes.create_string_buffer(self.context.raw, STATE), ctypes.create_string_buffer(32)
        self.lib.SHA256_Final(out, copy)
        return out.raw.hex()
