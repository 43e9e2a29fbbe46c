"""Secrets in wrapped, binary and large encoded layers."""

import base64
import bz2
import gzip
import io
import lzma
import random
import tarfile
import zlib

import pytest
import zstandard

from modelsieve.llm import secret_scan


def b64(data):
    return base64.b64encode(data).decode()


def wrapped(data, width, end="\n"):
    digits = b64(data)
    return end.join(digits[i : i + width] for i in range(0, len(digits), width))


def kinds(text):
    return {k for k, _, _ in secret_scan.Scan(text).spans}


def test_wrapped_base64():
    rng = random.Random(2)
    noise = "\n".join(f"line {i} {rng.random():.9f}" for i in range(20))
    secret = 'password = "Zx81kkQm27vvTTp0"'
    for width, end in ((76, "\n"), (64, "\r\n"), (20, "\n"), (76, "\n    ")):
        text = "begin\n\n" + wrapped(gzip.compress(f"{noise}\n{secret}".encode()), width, end) + "\n\nend"
        ((kind, start, stop),) = secret_scan.Scan(text).spans
        assert (kind, start, stop) == ("assign", 7, len(text) - 5)
        for pad in range(30, 60):
            text = f"see:\n{wrapped(('v' * pad + ' ' + secret + ' and more').encode(), width, end)}\nend"
            digits = [i for i, c in enumerate(text) if i > 4 and not c.isspace()]
            first, last = (pad + 1) * 4 // 3, ((pad + 1 + len(secret) - 1) * 4 + 2) // 3
            assert ("assign", digits[first], digits[last - 1] + 1) in secret_scan.Scan(text).spans


SECRET = 'password = "Zx81kkQm27vvTTp0"'


def archive():
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as tar:
        entry = tarfile.TarInfo("settings.txt")
        entry.size = len(SECRET)
        tar.addfile(entry, io.BytesIO(SECRET.encode()))
    return out.getvalue()


@pytest.mark.parametrize(
    "raw",
    [
        archive(),
        SECRET.encode("utf-16"),
        SECRET.encode("utf-16-be"),
        gzip.compress(SECRET.encode("utf-16")),
        f"caf\xe9 {SECRET}".encode("latin-1"),
        *(pack(b"first") + pack(SECRET.encode()) for pack in (gzip.compress, bz2.compress, lzma.compress, zlib.compress, zstandard.compress)),
        gzip.compress(b"first") + SECRET.encode(),
    ],
)
def test_binary_layers(raw):
    assert kinds(f"a {b64(raw)} b") == {"assign"}


def test_large_layers_are_scanned_in_blocks(monkeypatch):
    monkeypatch.setattr(secret_scan, "MAX_LAYER", 100_000)
    monkeypatch.setattr(secret_scan, "BLOCK", 10_000)
    monkeypatch.setattr(secret_scan, "TAIL", 1_000)
    prose = b"some words. " * 30_000
    inner = wrapped(gzip.compress(random.Random(4).randbytes(30_000) + SECRET.encode()), 76).encode()
    for shift in range(0, 60, 7):
        for secret in (SECRET.encode(), inner):
            data = prose + b"." * shift + b"\n" + secret + b"\n" + prose
            for raw in (gzip.compress(data), gzip.compress(bz2.compress(data))):
                scan = secret_scan.Scan(b64(raw))
                assert ({k for k, _, _ in scan.spans}, scan.refused) == ({"assign"}, 0)


def test_windows_beyond_the_memory_allowed_are_counted():
    import lzma

    secret = b"password = Tr0ub4dor-and-3x"
    for size, refused in ((1 << 28, 0), (1 << 30, 1)):
        packed = lzma.compress(secret, filters=[{"id": lzma.FILTER_LZMA2, "dict_size": size}]) if size < 1 << 29 else None
        if packed is None:
            # A frame that asks for a window of two gigabytes.
            packed = b"\x28\xb5\x2f\xfd\x00" + bytes([21 << 3]) + b"\x01\x00\x00"
        scan = secret_scan.Scan("x " + base64.b64encode(packed + b"\0" * 12).decode())
        assert scan.refused == refused and bool(scan.spans) == (not refused)
