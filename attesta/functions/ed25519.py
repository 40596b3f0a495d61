"""Ed25519 signatures (RFC 8032) in plain integers, and the states of a signed envelope."""

from __future__ import annotations

import base64
import hashlib
import json

P = 2**255 - 19
ORDER = 2**252 + 27742317777372353535851937790883648493
D = -121665 * pow(121666, -1, P) % P
ROOT = pow(2, (P - 1) // 4, P)


def _add(a: tuple, b: tuple) -> tuple:
    s = (a[1] - a[0]) * (b[1] - b[0]) % P
    t = (a[1] + a[0]) * (b[1] + b[0]) % P
    u, v = 2 * a[3] * b[3] * D % P, 2 * a[2] * b[2] % P
    e, f, g, h = t - s, v - u, v + u, t + s
    return e * f % P, g * h % P, f * g % P, e * h % P


def _times(n: int, point: tuple) -> tuple:
    out = (0, 1, 1, 0)
    while n:
        if n & 1:
            out = _add(out, point)
        point, n = _add(point, point), n >> 1
    return out


def _x_of(y: int, odd: int) -> int | None:
    if y >= P:
        return None
    square = (y * y - 1) * pow(D * y * y + 1, -1, P) % P
    x = pow(square, (P + 3) // 8, P)
    if (x * x - square) % P:
        x = x * ROOT % P
    if (x * x - square) % P or (x == 0 and odd):
        return None
    return P - x if x & 1 != odd else x


_Y = 4 * pow(5, -1, P) % P
_X = _x_of(_Y, 0)
BASE = (_X, _Y, 1, _X * _Y % P)


def _pack(point: tuple) -> bytes:
    z = pow(point[2], -1, P)
    x, y = point[0] * z % P, point[1] * z % P
    return (y | (x & 1) << 255).to_bytes(32, "little")


def _unpack(raw: bytes) -> tuple | None:
    y = int.from_bytes(raw, "little")
    odd, y = y >> 255, y & (2**255 - 1)
    x = _x_of(y, odd)
    return None if x is None else (x, y, 1, x * y % P)


def _scalar(*parts: bytes) -> int:
    return int.from_bytes(hashlib.sha512(b"".join(parts)).digest(), "little") % ORDER


def _secret(seed: bytes) -> tuple[int, bytes]:
    h = hashlib.sha512(seed).digest()
    return int.from_bytes(h[:32], "little") & (2**254 - 8) | 2**254, h[32:]


def public_key(seed: bytes) -> bytes:
    return _pack(_times(_secret(seed)[0], BASE))


def sign(seed: bytes, message: bytes) -> bytes:
    a, prefix = _secret(seed)
    key = _pack(_times(a, BASE))
    r = _scalar(prefix, message)
    point = _pack(_times(r, BASE))
    return point + ((r + _scalar(point, key, message) * a) % ORDER).to_bytes(32, "little")


def verify(key: bytes, message: bytes, signature: bytes) -> bool:
    if len(key) != 32 or len(signature) != 64:
        return False
    a, r = _unpack(key), _unpack(signature[:32])
    s = int.from_bytes(signature[32:], "little")
    if a is None or r is None or s >= ORDER:
        return False
    left, right = _times(s, BASE), _add(r, _times(_scalar(signature[:32], key, message), a))
    return (left[0] * right[2] - right[0] * left[2]) % P == 0 and (left[1] * right[2] - right[1] * left[2]) % P == 0


# Version and order of the fields in the canonical form.
VERSION = "sih-ref-1"
FIELD_ORDER = ["doc_type", "id_number", "name", "father_name", "dob", "gender", "nationality", "address", "issue_date", "expiry_date", "issuing_authority", "secondary_id"]


def canonical(payload: dict, version: str = VERSION, order: list[str] = FIELD_ORDER) -> bytes | None:
    """Version, issuer and fields joined by 0x1f; None if the payload has other fields."""
    import unicodedata

    if set(payload) - set(order) - {"issuer_id"}:
        return None
    text = lambda v: "" if v is None else " ".join(unicodedata.normalize("NFC", str(v)).split())
    return "\x1f".join([version, text(payload.get("issuer_id")), *(text(payload.get(f)) for f in order)]).encode()


def envelope_state(blob: str | None, anchors: dict[str, dict], now: str | None = None) -> tuple[str, str | None]:
    """(state, issuer) of an envelope; anchors: issuer -> {public_key, algorithm, valid_until}."""
    try:
        outer = json.loads(blob or "")
        issuer, payload, signature = outer["issuer_id"], outer["payload"], outer["signature"]
    except (ValueError, KeyError, TypeError):
        return "MALFORMED_PAYLOAD", None
    if not isinstance(payload, dict):
        return "MALFORMED_PAYLOAD", issuer
    anchor = anchors.get(issuer)
    if anchor is None:
        return "UNKNOWN_ISSUER", issuer
    if anchor.get("algorithm", "ed25519") != "ed25519":
        return "INVALID_SIGNATURE", issuer
    if now and anchor.get("valid_until") and now > anchor["valid_until"]:
        return "REVOKED", issuer
    message = canonical({**payload, "issuer_id": issuer})
    if message is None:
        return "MALFORMED_PAYLOAD", issuer
    try:
        raw = base64.b64decode(signature, validate=True)
    except (ValueError, TypeError):
        return "MALFORMED_PAYLOAD", issuer
    return ("AUTHENTIC" if verify(anchor["public_key"], message, raw) else "TAMPERED"), issuer
