"""Stream filters: decoding chains, and the encoders that tests and writers need."""

from __future__ import annotations

import re
import zlib

import numpy as np

MAX_BYTES = 1 << 30
#: Codecs of images: a chain stops there and hands on what it has.
IMAGE_FILTERS = {"DCTDecode", "JPXDecode", "JBIG2Decode", "CCITTFaxDecode", "DCT", "CCF"}
#: Short names of filters in inline images.
SHORT = {"AHx": "ASCIIHexDecode", "A85": "ASCII85Decode", "LZW": "LZWDecode", "Fl": "FlateDecode", "RL": "RunLengthDecode"}


class TooLarge(ValueError):
    pass


def flate(data: bytes) -> bytes:
    """zlib or bare deflate; what follows the stream or is cut off is tolerated."""
    for wbits in (15, -15):
        d, out = zlib.decompressobj(wbits), b""
        try:
            out = d.decompress(data, MAX_BYTES + 1)
        except zlib.error:
            if wbits == 15:
                continue
            break
        if len(out) > MAX_BYTES:
            raise TooLarge("a stream is too large")
        return out
    # damaged: keep what comes out byte by byte before the error
    d, parts = zlib.decompressobj(), []
    for i in range(len(data)):
        try:
            parts.append(d.decompress(data[i : i + 1]))
        except zlib.error:
            break
    return b"".join(parts)


def lzw(data: bytes, early: int = 1) -> bytes:
    table = [bytes([i]) for i in range(256)] + [b"", b""]
    out, width, bits, held, last = [], 9, 0, 0, b""
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        while bits >= width:
            code = held >> bits - width & (1 << width) - 1
            bits -= width
            held &= (1 << bits) - 1
            if code == 257:
                return b"".join(out)
            if code == 256:
                del table[258:]
                width, last = 9, b""
                continue
            if code < len(table):
                entry = table[code]
            elif last:
                entry = last + last[:1]
            else:
                return b"".join(out)
            out.append(entry)
            if last and len(table) < 4096:
                table.append(last + entry[:1])
            last = entry
            n = len(table) + early
            width = 12 if n >= 2048 else 11 if n >= 1024 else 10 if n >= 512 else 9
    return b"".join(out)


def ascii85(data: bytes) -> bytes:
    data = re.sub(rb"\s", b"", data.split(b"~")[0])
    out, group = bytearray(), []
    for c in data:
        if c == 0x7A and not group:
            out += bytes(4)
        elif 33 <= c <= 117:
            group.append(c - 33)
            if len(group) == 5:
                out += (int(np.dot(group, [52200625, 614125, 7225, 85, 1])) & 0xFFFFFFFF).to_bytes(4, "big")
                group = []
    if len(group) > 1:
        n = len(group)
        group += [84] * (5 - n)
        out += (int(np.dot(group, [52200625, 614125, 7225, 85, 1])) & 0xFFFFFFFF).to_bytes(4, "big")[: n - 1]
    return bytes(out)


def ascii_hex(data: bytes) -> bytes:
    digits = re.sub(rb"[^0-9A-Fa-f]", b"", data.split(b">")[0])
    return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())


def run_length(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and data[i] != 128:
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        else:
            out += data[i + 1 : i + 2] * (257 - n)
            i += 2
    return bytes(out)


def unpredict(data: bytes, predictor: int, colors: int = 1, bits: int = 8, columns: int = 1) -> bytes:
    """Undoes TIFF (2) and PNG (10 and above) predictors."""
    if predictor < 2:
        return data
    pixel, row = max(1, colors * bits // 8), (colors * bits * columns + 7) // 8
    if predictor == 2:
        a = np.frombuffer(data[: len(data) // row * row], np.uint8).reshape(-1, columns, colors)
        return np.cumsum(a, axis=1, dtype=np.uint8).tobytes() if bits == 8 else data
    out, above = [], bytearray(row)
    for at in range(0, len(data), row + 1):
        kind, line = data[at], bytearray(data[at + 1 : at + 1 + row])
        line += bytes(row - len(line))
        if kind == 2:
            line = bytearray((np.frombuffer(bytes(line), np.uint8) + np.frombuffer(bytes(above), np.uint8)).tobytes())
        elif kind:
            for i in range(row):
                a, b = line[i - pixel] if i >= pixel else 0, above[i]
                if kind == 1:
                    p = a
                elif kind == 3:
                    p = (a + b) // 2
                else:
                    c = above[i - pixel] if i >= pixel else 0
                    e = a + b - c
                    p = min((abs(e - a), 0, a), (abs(e - b), 1, b), (abs(e - c), 2, c))[2]
                line[i] = line[i] + p & 255
        out.append(bytes(line))
        above = line
    return b"".join(out)


def decode(data: bytes, names: list[str], parms: list[dict]) -> tuple[bytes, str | None]:
    """Bytes after the filters in turn, and the image filter that stopped the chain."""
    for k, name in enumerate(names):
        name = SHORT.get(name, name)
        p = parms[k] if k < len(parms) and isinstance(parms[k], dict) else {}
        if name in IMAGE_FILTERS:
            return data, name
        if name == "FlateDecode":
            data = flate(data)
        elif name == "LZWDecode":
            data = lzw(data, p.get("EarlyChange", 1))
        elif name in ("ASCII85Decode", "ASCIIHexDecode", "RunLengthDecode"):
            data = {"ASCII85Decode": ascii85, "ASCIIHexDecode": ascii_hex, "RunLengthDecode": run_length}[name](data)
        elif name != "Crypt":
            raise ValueError(f"unknown filter {name}")
        if len(data) > MAX_BYTES:
            raise TooLarge("a stream is too large")
        if name in ("FlateDecode", "LZWDecode"):
            data = unpredict(data, p.get("Predictor", 1), p.get("Colors", 1), p.get("BitsPerComponent", 8), p.get("Columns", 1))
    return data, None
