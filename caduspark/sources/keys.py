"""Keys of the audit chain: providers resolve them on the driver, column expressions sign with them.

A provider is anything with key() -> bytes and key_id: cloud and hardware stores plug in here.
"""

from __future__ import annotations

import base64
import binascii
import hmac
import os
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import Column

from caduspark.functions.hashing import hmac_sha256

LEAST_BYTES = 32


class KeyProvider(Protocol):
    """Where a signing key comes from; key_id names the key in rotation logs."""

    key_id: str

    def key(self) -> bytes: ...


@dataclass(frozen=True)
class GivenKey:
    """A key in memory, random where none is given; for tests and research."""

    secret: bytes = field(default_factory=lambda: os.urandom(LEAST_BYTES), repr=False)
    key_id: str = "software-default"

    def key(self) -> bytes:
        return self.secret


class EnvironmentKey:
    """A key of at least 32 bytes, base64 in a variable; a missing, malformed or short one raises ValueError at once."""

    def __init__(self, variable: str = "CADUSPARK_HMAC_KEY", key_id: str = "env", environment: Mapping[str, str] | None = None):
        coded = (os.environ if environment is None else environment).get(variable, "")
        try:
            self._secret = base64.b64decode(coded)
        except binascii.Error as e:
            raise ValueError(f"{variable} is not base64") from e
        if len(self._secret) < LEAST_BYTES:
            raise ValueError(f"{variable} must hold at least {LEAST_BYTES} bytes as base64")
        self.key_id = key_id

    def key(self) -> bytes:
        return self._secret


def sign(message: Column, provider: KeyProvider) -> Column:
    """Hex HMAC-SHA256 of a text under the provider's key."""
    return hmac_sha256(message, provider.key())


def verify(data: bytes, signature: str, provider: KeyProvider) -> bool:
    """Whether a hex signature fits, compared in constant time; for single messages on the driver."""
    return hmac.compare_digest(hmac.new(provider.key(), data, "sha256").hexdigest(), signature)
