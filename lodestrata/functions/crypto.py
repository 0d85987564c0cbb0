"""AES, XTS and CCM for volumes whose owner supplies the keys. Plain Python; tables follow from the field's arithmetic."""

from __future__ import annotations

import hashlib
import struct
from functools import lru_cache


def _times(a: int, b: int) -> int:
    out = 0
    while b:
        if b & 1:
            out ^= a
        a = a << 1 ^ (0x11B if a & 0x80 else 0)
        b >>= 1
    return out


@lru_cache
def _boxes() -> tuple[bytes, bytes]:
    box = bytearray(256)
    for x in range(256):
        inv = next((y for y in range(1, 256) if _times(x, y) == 1), 0) if x else 0
        r = inv
        for k in range(1, 5):
            r ^= (inv << k | inv >> (8 - k)) & 255
        box[x] = r ^ 0x63
    back = bytearray(256)
    for x, y in enumerate(box):
        back[y] = x
    return bytes(box), bytes(back)


@lru_cache
def _multiples() -> dict[int, bytes]:
    return {k: bytes(_times(x, k) for x in range(256)) for k in (2, 3, 9, 11, 13, 14)}


@lru_cache(maxsize=64)
def _round_keys(key: bytes) -> list[bytes]:
    box, n = _boxes()[0], len(key) // 4
    words, rcon = [key[4 * k : 4 * k + 4] for k in range(n)], 1
    for k in range(n, 4 * (n + 7)):
        w = words[-1]
        if k % n == 0:
            w = bytes(box[b] for b in w[1:] + w[:1])
            w = bytes([w[0] ^ rcon]) + w[1:]
            rcon = _times(rcon, 2)
        elif n > 6 and k % n == 4:
            w = bytes(box[b] for b in w)
        words.append(bytes(a ^ b for a, b in zip(words[k - n], w)))
    return [b"".join(words[k : k + 4]) for k in range(0, len(words), 4)]


def _xor(a: bytes, b: bytes) -> bytes:
    return (int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).to_bytes(len(a), "big")


_SHIFT = [(k + 4 * (k % 4)) % 16 for k in range(16)]
_BACK = [(k - 4 * (k % 4)) % 16 for k in range(16)]


def aes_encrypt(key: bytes, block: bytes) -> bytes:
    """One block of 16 bytes; keys of 16, 24 or 32 bytes."""
    box, m, keys = _boxes()[0], _multiples(), _round_keys(key)
    s = _xor(block, keys[0])
    for k, rk in enumerate(keys[1:], 1):
        s = [box[s[j]] for j in _SHIFT]
        if k < len(keys) - 1:
            s = [m[2][s[c + r]] ^ m[3][s[c + (r + 1) % 4]] ^ s[c + (r + 2) % 4] ^ s[c + (r + 3) % 4] for c in (0, 4, 8, 12) for r in range(4)]
        s = _xor(bytes(s), rk)
    return s


def aes_decrypt(key: bytes, block: bytes) -> bytes:
    back, m, keys = _boxes()[1], _multiples(), _round_keys(key)
    s = _xor(block, keys[-1])
    for k in range(len(keys) - 2, -1, -1):
        s = _xor(bytes(back[s[j]] for j in _BACK), keys[k])
        if k:
            s = bytes(m[14][s[c + r]] ^ m[11][s[c + (r + 1) % 4]] ^ m[13][s[c + (r + 2) % 4]] ^ m[9][s[c + (r + 3) % 4]] for c in (0, 4, 8, 12) for r in range(4))
    return s


def _xts(key: bytes, data: bytes, number: int, sector: int, cipher) -> bytes:
    """Whole 16-byte blocks of consecutive sectors from number on; a rest under 16 bytes stays as it is."""
    half = len(key) // 2
    out = bytearray()
    for at in range(0, len(data), sector):
        t = int.from_bytes(aes_encrypt(key[half:], struct.pack("<QQ", number + at // sector, 0)), "little")
        part = data[at : at + sector]
        for k in range(0, len(part) - 15, 16):
            tweak = t.to_bytes(16, "little")
            out += _xor(cipher(key[:half], _xor(part[k : k + 16], tweak)), tweak)
            t = (t << 1 ^ (0x87 if t >> 127 else 0)) & (1 << 128) - 1
        out += part[len(part) // 16 * 16 :]
    return bytes(out)


def xts_decrypt(key: bytes, data: bytes, number: int, sector: int = 512) -> bytes:
    return _xts(key, data, number, sector, aes_decrypt)


def xts_encrypt(key: bytes, data: bytes, number: int, sector: int = 512) -> bytes:
    return _xts(key, data, number, sector, aes_encrypt)


def ccm_decrypt(key: bytes, nonce: bytes, data: bytes, tag: bytes) -> bytes | None:
    """CCM without associated data; None if the tag does not fit."""
    width = 15 - len(nonce)
    stream = lambda k: aes_encrypt(key, bytes([width - 1]) + nonce + k.to_bytes(width, "big"))
    plain = b"".join(_xor(data[16 * k : 16 * k + 16], stream(k + 1)[: len(data[16 * k : 16 * k + 16])]) for k in range(-(-len(data) // 16)))
    mac = aes_encrypt(key, bytes([(len(tag) - 2) // 2 << 3 | width - 1]) + nonce + len(plain).to_bytes(width, "big"))
    for k in range(0, len(plain), 16):
        mac = aes_encrypt(key, _xor(mac, plain[k : k + 16].ljust(16, b"\0")))
    return plain if _xor(mac, stream(0))[: len(tag)] == tag else None


def stretched_key(password_hash: bytes, salt: bytes, rounds: int = 0x100000) -> bytes:
    """A key from a doubly hashed password: rounds of SHA-256 over (last, first, salt, counter)."""
    last = bytes(32)
    for k in range(rounds):
        last = hashlib.sha256(last + password_hash + salt + struct.pack("<Q", k)).digest()
    return last


def volume_key(text: str) -> bytes:
    """A volume key given in hexadecimal, with or without spaces; 32 or 64 bytes."""
    key = bytes.fromhex("".join(text.split()))
    if len(key) not in (32, 64):
        raise ValueError("a volume key has 32 or 64 bytes")
    return key
