"""Standard security handler, revisions 2 to 4: RC4 and AES-128, by ISO 32000 algorithms 1 to 7."""

from __future__ import annotations

import hashlib
import os

from quire.sources.syntax import Name, Ref, Stream

#: Fixed value: the padding of passwords.
PAD = bytes.fromhex("28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A")


def rc4(key: bytes, data: bytes) -> bytes:
    s, j = list(range(256)), 0
    for i in range(256):
        j = (j + s[i] + key[i % len(key)]) & 255
        s[i], s[j] = s[j], s[i]
    out, i, j = bytearray(len(data)), 0, 0
    for n, c in enumerate(data):
        i = (i + 1) & 255
        j = (j + s[i]) & 255
        s[i], s[j] = s[j], s[i]
        out[n] = c ^ s[(s[i] + s[j]) & 255]
    return bytes(out)


def _double(a: int) -> int:
    return (a << 1 ^ 0x1B) & 255 if a & 128 else a << 1


def _times(a: int, b: int) -> int:
    out = 0
    while b:
        out ^= a if b & 1 else 0
        a, b = _double(a), b >> 1
    return out


def _sbox() -> list[int]:
    out = []
    for x in range(256):
        inverse = next((y for y in range(256) if _times(x, y) == 1), 0)
        v = 0x63
        for k in range(5):
            v ^= (inverse << k | inverse >> 8 - k) & 255
        out.append(v)
    return out


_S: list[int] = []
_MUL: dict[int, list[int]] = {}


def _tables() -> None:
    if not _S:
        _S.extend(_sbox())
        _MUL.update({k: [_times(x, k) for x in range(256)] for k in (2, 3, 9, 11, 13, 14)})


def _round_keys(key: bytes) -> list[bytes]:
    n = len(key) // 4
    w, rcon = [key[4 * i : 4 * i + 4] for i in range(n)], 1
    for i in range(n, 4 * (n + 7)):
        t = w[-1]
        if i % n == 0:
            t = bytes([_S[t[1]] ^ rcon, _S[t[2]], _S[t[3]], _S[t[0]]])
            rcon = _double(rcon)
        elif n > 6 and i % n == 4:
            t = bytes(_S[c] for c in t)
        w.append(bytes(a ^ b for a, b in zip(w[i - n], t)))
    return [b"".join(w[i : i + 4]) for i in range(0, len(w), 4)]


def _xor(a: bytes, b: bytes) -> bytes:
    return bytes(x ^ y for x, y in zip(a, b))


_ROWS = [(c * 4 + r + 4 * r) % 16 for c in range(4) for r in range(4)]


def aes_block(keys: list[bytes], block: bytes, decrypt: bool) -> bytes:
    _tables()
    if not decrypt:
        s = _xor(block, keys[0])
        for k in keys[1:]:
            s = bytes(_S[s[i]] for i in _ROWS)
            if k is not keys[-1]:
                m2, m3 = _MUL[2], _MUL[3]
                s = bytes(m2[s[c + i]] ^ m3[s[c + (i + 1) % 4]] ^ s[c + (i + 2) % 4] ^ s[c + (i + 3) % 4] for c in (0, 4, 8, 12) for i in range(4))
            s = _xor(s, k)
        return s
    inverse = [0] * 256
    for i, v in enumerate(_S):
        inverse[v] = i
    back = [0] * 16
    for to, at in enumerate(_ROWS):
        back[at] = to
    s = _xor(block, keys[-1])
    for n in range(len(keys) - 2, -1, -1):
        s = _xor(bytes(inverse[s[back[i]]] for i in range(16)), keys[n])
        if n:
            a, b, c_, d = _MUL[14], _MUL[11], _MUL[13], _MUL[9]
            s = bytes(a[s[c + i]] ^ b[s[c + (i + 1) % 4]] ^ c_[s[c + (i + 2) % 4]] ^ d[s[c + (i + 3) % 4]] for c in (0, 4, 8, 12) for i in range(4))
    return s


def aes_cbc(key: bytes, data: bytes, decrypt: bool, iv: bytes | None = None) -> bytes:
    """The first block of encrypted data is the initial vector; padding as in PKCS 5."""
    _tables()
    keys, out = _round_keys(key), bytearray()
    if decrypt:
        last = data[:16]
        for at in range(16, len(data) - 15, 16):
            block = data[at : at + 16]
            out += _xor(aes_block(keys, block, True), last)
            last = block
        return bytes(out[: -out[-1]]) if out and 1 <= out[-1] <= 16 else bytes(out)
    last = iv or os.urandom(16)
    out += last
    pad = 16 - len(data) % 16
    data += bytes([pad]) * pad
    for at in range(0, len(data), 16):
        last = aes_block(keys, _xor(data[at : at + 16], last), False)
        out += last
    return bytes(out)


def _padded(password: bytes) -> bytes:
    return (password + PAD)[:32]


def file_key(password: bytes, o: bytes, p: int, file_id: bytes, revision: int, n: int, plain_metadata: bool = False) -> bytes:
    h = hashlib.md5(_padded(password) + o + (p & 0xFFFFFFFF).to_bytes(4, "little") + file_id + (b"\xff" * 4 if plain_metadata and revision >= 4 else b"")).digest()
    for _ in range(50 if revision >= 3 else 0):
        h = hashlib.md5(h[:n]).digest()
    return h[:n]


def user_entry(key: bytes, file_id: bytes, revision: int) -> bytes:
    if revision == 2:
        return rc4(key, PAD)
    h = hashlib.md5(PAD + file_id).digest()
    for k in range(20):
        h = rc4(bytes(c ^ k for c in key), h)
    return h + bytes(16)


def owner_entry(owner: bytes, user: bytes, revision: int, n: int) -> bytes:
    h = hashlib.md5(_padded(owner or user)).digest()
    for _ in range(50 if revision >= 3 else 0):
        h = hashlib.md5(h[:n]).digest()
    out = _padded(user)
    for k in range(20 if revision >= 3 else 1):
        out = rc4(bytes(c ^ k for c in h[:n]), out)
    return out


def object_key(key: bytes, num: int, gen: int, aes: bool) -> bytes:
    h = hashlib.md5(key + num.to_bytes(3, "little") + gen.to_bytes(2, "little") + (b"sAlT" if aes else b"")).digest()
    return h[: min(len(key) + 5, 16)]


class Handler:
    """Decrypts a document's strings and streams once a password has opened it."""

    def __init__(self, encrypt: dict, file_id: bytes, password: bytes = b""):
        self.revision, self.role, self.key = encrypt["R"], None, b""
        self.aes = any(isinstance(f, dict) and f.get("CFM") == "AESV2" for f in (encrypt.get("CF") or {}).values())
        n = 5 if self.revision == 2 else (16 if self.aes else encrypt.get("Length", 40) // 8)
        if self.revision not in (2, 3, 4):
            raise ValueError(f"security revision {self.revision} is not supported")
        o, u, p = encrypt["O"][:32], encrypt["U"], encrypt["P"]
        plain = encrypt.get("EncryptMetadata") is False
        for role, word in (("user", password), ("owner", self._from_owner(password, o, n))):
            key = file_key(word, o, p, file_id, self.revision, n, plain)
            if user_entry(key, file_id, self.revision)[:16] == u[:16]:
                self.role, self.key = role, key
                break

    def _from_owner(self, owner: bytes, o: bytes, n: int) -> bytes:
        h = hashlib.md5(_padded(owner)).digest()
        for _ in range(50 if self.revision >= 3 else 0):
            h = hashlib.md5(h[:n]).digest()
        for k in range(19 if self.revision >= 3 else 0, -1, -1):
            o = rc4(bytes(c ^ k for c in h[:n]), o)
        return o

    def open(self, ref: Ref, value, decrypt: bool = True):
        """A value with its strings and stream decrypted (or encrypted)."""
        key = object_key(self.key, ref.num, ref.gen, self.aes)
        turn = (lambda b: aes_cbc(key, b, decrypt) if b else b) if self.aes else (lambda b: rc4(key, b))

        def walk(v):
            if isinstance(v, bytes):
                return turn(v)
            if isinstance(v, list):
                return [walk(x) for x in v]
            if isinstance(v, dict):
                return {k: walk(x) for k, x in v.items()}
            if isinstance(v, Stream):
                return v if v.dict.get("Type") == "XRef" else Stream(walk(v.dict), turn(v.raw))
            return v

        return walk(value)


def protect(objects: dict[int, object], user: bytes, owner: bytes, file_id: bytes, aes: bool = False, permissions: int = -44) -> tuple[dict[int, object], dict]:
    """Encrypted objects and the encryption dictionary: RC4 (R3) or AES (R4) of 128 bits."""
    revision = 4 if aes else 3
    o = owner_entry(owner, user, revision, 16)
    key = file_key(user, o, permissions, file_id, revision, 16)
    encrypt = {"Filter": Name("Standard"), "V": 4 if aes else 2, "R": revision, "Length": 128, "O": o, "U": user_entry(key, file_id, revision), "P": permissions}
    if aes:
        encrypt |= {"CF": {"StdCF": {"CFM": Name("AESV2"), "Length": 16}}, "StmF": Name("StdCF"), "StrF": Name("StdCF")}
    h = Handler(encrypt, file_id, user)
    return {n: h.open(Ref(n), v, decrypt=False) for n, v in objects.items()}, encrypt
