"""Ed25519 (RFC 8032) in plain Python, for tokens that clinicians sign, no library needed.

Multiples of the base point and of each key are kept in tables, by byte and by half byte, so that a product is a few dozen
sums of points and a key is read from its bytes once.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

# Fixed values of the standard: the field, the order of the base point, the curve, a root of -1, and the head of a DER public key.
_P = 2**255 - 19
_L = 2**252 + 27742317777372353535851937790883648493
_D = -121665 * pow(121666, -1, _P) % _P
_ROOT = pow(2, (_P - 1) // 4, _P)
_DER = bytes.fromhex("302a300506032b6570032100")

Point = tuple[int, int, int, int]
_ZERO: Point = (0, 1, 1, 0)


def _add(p: Point, q: Point) -> Point:
    a, b = (p[1] - p[0]) * (q[1] - q[0]) % _P, (p[1] + p[0]) * (q[1] + q[0]) % _P
    c, d = 2 * p[3] * q[3] * _D % _P, 2 * p[2] * q[2] % _P
    e, f, g, h = b - a, d - c, d + c, b + a
    return e * f % _P, g * h % _P, f * g % _P, e * h % _P


def _point(code: bytes) -> Point | None:
    """The point that 32 bytes stand for, if any."""
    y = int.from_bytes(code, "little")
    odd, y = y >> 255, y & (1 << 255) - 1
    if len(code) != 32 or y >= _P:
        return None
    square = (y * y - 1) * pow(_D * y * y + 1, -1, _P) % _P
    x = pow(square, (_P + 3) // 8, _P)
    if (x * x - square) % _P:
        x = x * _ROOT % _P
    if (x * x - square) % _P or (x == 0 and odd):
        return None
    x = _P - x if x & 1 != odd else x
    return x, y, 1, x * y % _P


_BASE = _point((4 * pow(5, -1, _P) % _P).to_bytes(32, "little"))


def _code(p: Point) -> bytes:
    z = pow(p[2], -1, _P)
    return (p[1] * z % _P | (p[0] * z % _P & 1) << 255).to_bytes(32, "little")


#: Multiples of a point by digit of a number: (y + x, y - x, 2 d x y) for each digit but 0.
Table = list[list[tuple[int, int, int] | None]]


def _table(p: Point, bits: int) -> Table:
    points = []
    for _ in range(256 // bits):
        q = p
        for _ in range((1 << bits) - 1):
            points.append(q)
            q = _add(q, p)
        p = q
    shares = [1]  # one inversion for all: products of the first denominators, then back
    for q in points:
        shares.append(shares[-1] * q[2] % _P)
    inverse = pow(shares[-1], -1, _P)
    flat: list = []
    for q, share in zip(reversed(points), reversed(shares[:-1])):
        z, inverse = inverse * share % _P, inverse * q[2] % _P
        x, y = q[0] * z % _P, q[1] * z % _P
        flat.append(((y + x) % _P, (y - x) % _P, 2 * _D * x * y % _P))
    flat.reverse()
    width = (1 << bits) - 1
    return [[None, *flat[i : i + width]] for i in range(0, len(flat), width)]


def _times(n: int, table: Table, p: Point = _ZERO) -> Point:
    """p plus n times the table's point, for n below 2^256."""
    digits = n.to_bytes(32, "little")
    x, y, z, t = p
    for row, digit in zip(table, digits if len(table) == 32 else (d for b in digits for d in (b & 15, b >> 4))):
        if digit:
            plus, minus, both = row[digit]
            a, b, c = (y - x) * minus % _P, (y + x) * plus % _P, t * both % _P
            e, f, g, h = b - a, 2 * z - c, 2 * z + c, b + a
            x, y, z, t = e * f % _P, g * h % _P, f * g % _P, e * h % _P
    return x, y, z, t


@lru_cache(1)
def _base() -> Table:
    return _table(_BASE, 8)


@lru_cache(128)
def _minus(public: bytes) -> Table | None:
    """Multiples of a key's point with its sign turned; None for malformed keys."""
    key = _point(public)
    return None if key is None else _table((_P - key[0], key[1], 1, _P - key[3]), 4)


def _number(*parts: bytes) -> int:
    return int.from_bytes(hashlib.sha512(b"".join(parts)).digest(), "little") % _L


def _expand(secret: bytes) -> tuple[int, bytes]:
    h = hashlib.sha512(secret).digest()
    return int.from_bytes(h[:32], "little") & (1 << 254) - 8 | 1 << 254, h[32:]


@lru_cache(128)
def public_key(secret: bytes) -> bytes:
    return _code(_times(_expand(secret)[0], _base()))


def sign(secret: bytes, message: bytes) -> bytes:
    a, prefix = _expand(secret)
    r = _number(prefix, message)
    head = _code(_times(r, _base()))
    return head + ((r + _number(head, public_key(secret), message) * a) % _L).to_bytes(32, "little")


def verify(public: bytes, message: bytes, signature: bytes) -> bool:
    """Whether a signature fits; malformed keys and signatures don't."""
    key, s = _minus(public), int.from_bytes(signature[32:], "little")
    if key is None or len(signature) != 64 or s >= _L:
        return False
    return _code(_times(_number(signature[:32], public, message), key, _times(s, _base()))) == signature[:32]


def to_pem(public: bytes) -> bytes:
    return b"-----BEGIN PUBLIC KEY-----\n" + base64.b64encode(_DER + public) + b"\n-----END PUBLIC KEY-----\n"


def from_pem(pem: bytes) -> bytes:
    """The 32 bytes of a PEM public key; other keys raise ValueError."""
    body = b"".join(line for line in pem.split() if not line.startswith(b"-----") and line not in (b"PUBLIC", b"KEY-----"))
    der = base64.b64decode(body, validate=True)
    if len(der) != len(_DER) + 32 or not der.startswith(_DER):
        raise ValueError("not an Ed25519 public key")
    return der[len(_DER) :]
