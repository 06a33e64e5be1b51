"""Secret scans with structural confirmation (operator 7).

Base patterns (assignments, access keys, hex runs) are reported as they match. Further candidates
are decoded and parsed before they are reported: runs of base64 or hex whose bytes are DER with
nested lengths that fit exactly and the layout of a key (``der``), the binary key format of OpenSSH
(``ssh``), and three-part tokens whose header is JSON that names an algorithm (``jwt``).

A key of the coded kinds ends where its own lengths say, at the end of a line, of the run or before
five dashes; words and markers on the lines around it are no part of it, and what follows is read on.

What a text can't hold is told by its longest coded run and by fixed strings that every match has, so
no such test changes a result.

Edge cases: null counts as empty; empty texts have no spans; offsets are code points, end exclusive;
of several spans at one start (ties) the kinds go in the order of KINDS, then the shorter; spans of
different kinds may overlap; texts of any length are read whole; repeated rows get the same spans; an
empty table gives an empty one; other columns pass through, and one named like the output is replaced.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tracelet.llm.common import map_text

KINDS = ("assign", "access", "hex", "der", "ssh", "jwt")
BASE = KINDS[:3]
#: Bytes between keyword and value are ASCII, so all patterns read UTF-8 bytes; letters of the keywords go in either case, others of Unicode do not count.
ASSIGN = re.compile(rb"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
#: As greedy runs never start inside a run, 16 and more are the runs that pass.
HEX = re.compile(rb"[0-9a-f]{16,}")
CODED = re.compile(rb"[A-Za-z0-9+/_-]{32,}(?:\r?\n[A-Za-z0-9+/_-]+)*={0,2}")
#: Where a key may begin in a coded run: at a line's start or behind a marker's dashes, with the first characters of a DER sequence or of the SSH magic.
STARTS = re.compile(rb"(?:\A|(?<=\n)|(?<=-----))(?=M[A-P]|b3BlbnNzaC1rZXktdjEA)")
#: Characters of a key, as of a run.
LEAST = 32
STANDARD = bytes.maketrans(b"-_", b"+/")
HEXES = re.compile(rb"(?:[0-9a-fA-F]{2}){16,}")
TOKEN = re.compile(rb"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*")
LONG = np.array([0x30 <= c <= 0x39 or 0x41 <= c <= 0x5A or 0x61 <= c <= 0x7A or c in b"+/_-" for c in range(256)])
SSH = b"openssh-key-v1\x00"


def element(raw: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, start of content, end of content) of the DER element at ``at``, which must end by ``end``."""
    if at + 2 > end:
        return None
    tag, size, at = raw[at], raw[at + 1], at + 2
    if size & 0x80:
        n = size & 0x7F
        if not 0 < n <= 4 or at + n > end:
            return None
        size = int.from_bytes(raw[at : at + n], "big")
        if size < 0x80 or size >> 8 * (n - 1) == 0:
            return None  # not the shortest form
        at += n
    return (tag, at, at + size) if at + size <= end else None


def elements(raw: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """The elements that fill [at, end) exactly, or None."""
    out = []
    while at < end:
        found = element(raw, at, end)
        if found is None:
            return None
        out.append(found)
        at = found[2]
    return out


def is_key_encoding(raw: bytes) -> bool:
    """Whether the bytes are one DER sequence with the layout of a private or public key."""
    top = element(raw, 0, len(raw))
    if top is None or top[0] != 0x30 or top[2] != len(raw):
        return False
    parts = elements(raw, top[1], top[2])
    if not parts:
        return False
    tags = [t for t, _, _ in parts]
    if len(tags) >= 6 and set(tags) == {0x02}:  # version, modulus, exponents, primes
        return True
    if tags[:3] == [0x02, 0x30, 0x04]:  # version, algorithm, octets
        inner = elements(raw, parts[1][1], parts[1][2])
        return bool(inner) and inner[0][0] == 0x06
    if tags[:2] == [0x02, 0x04] and all(t in (0xA0, 0xA1) for t in tags[2:]):  # version, octets, curve, point
        return parts[1][2] - parts[1][1] >= 16
    if tags == [0x30, 0x03]:  # algorithm, bits
        inner = elements(raw, parts[0][1], parts[0][2])
        return bool(inner) and inner[0][0] == 0x06
    return False


def is_ssh_key(raw: bytes) -> bool:
    """The magic, then three length-prefixed strings (cipher, derivation, its options) and a count of keys."""
    if not raw.startswith(SSH):
        return False
    at = len(SSH)
    for _ in range(3):
        if at + 4 > len(raw):
            return False
        at += 4 + int.from_bytes(raw[at : at + 4], "big")
    return at + 4 <= len(raw) and 1 <= int.from_bytes(raw[at : at + 4], "big") <= 64


def is_signed_token(token: bytes) -> bool:
    """Header and payload are JSON objects, and the header names an algorithm."""
    try:
        head, body, _ = token.split(b".")
        header, payload = (json.loads(base64.urlsafe_b64decode(x + b"=" * (-len(x) % 4))) for x in (head, body))
    except (ValueError, binascii.Error):
        return False
    return isinstance(header, dict) and isinstance(header.get("alg"), str) and isinstance(payload, dict)


def ssh_size(raw: bytes) -> int | None:
    """Bytes up to the end of the private part that follows the public keys, or None where it is cut off."""
    at = len(SSH)
    for _ in range(3):
        at += 4 + int.from_bytes(raw[at : at + 4], "big")
    n, at = int.from_bytes(raw[at : at + 4], "big"), at + 4
    for _ in range(n + 1):
        if at + 4 > len(raw):
            return None
        at += 4 + int.from_bytes(raw[at : at + 4], "big")
    return at if at <= len(raw) else None


def decoded(plain: bytes) -> bytes:
    plain = plain[: len(plain) - (len(plain) % 4 == 1)]
    return base64.b64decode(plain + b"=" * (-len(plain) % 4))


def keys(run: bytes) -> Iterator[tuple[str, int, int]]:
    """The keys in one coded run. Lines of other words may stand before, between and behind them."""
    where, plain, done = None, b"", 0
    for m in STARTS.finditer(run):
        if m.start() < done:
            continue
        if where is None:
            where = np.flatnonzero(LONG[np.frombuffer(run, np.uint8)])
            plain = run.translate(STANDARD, b"\r\n=")
        k = int(np.searchsorted(where, m.start()))
        after = lambda n: len(run) if n == len(plain) else int(where[n - 1]) + 1  # noqa: E731, B023  padding belongs to the last line
        if run[m.start()] == ord("M"):
            head = decoded(plain[k : k + 8])
            top = element(head, 0, 1 << 40) if len(head) == 6 else None
            n = top and k - (-4 * top[2] // 3)
            if not top or n - k < LEAST or n > len(plain):
                continue
            end = after(n)
            fits = end == len(run) or run[end] in b"\r\n" or run.startswith(b"-----", end)
            if fits and is_key_encoding(decoded(plain[k:n])):
                yield "der", m.start(), (done := end)
        else:
            raw = decoded(plain[k:])
            if is_ssh_key(raw):
                size = ssh_size(raw)
                if size is not None:
                    done = after(k - (-4 * size // 3))
                else:  # cut off: up to the marker
                    marker = run.find(b"-----", m.start())
                    done = len(run) if marker < 0 else len(run[:marker].rstrip(b"\r\n"))
                yield "ssh", m.start(), done


def confirmed(text: bytes, run: bool = True) -> Iterator[tuple[str, int, int]]:
    """Candidates whose structure holds. run: whether the text has a run of LEAST coded bytes, without which there is no key."""
    if b"eyJ" in text:
        for m in TOKEN.finditer(text):
            if is_signed_token(m[0]):
                yield "jwt", *m.span()
    if not run:
        return
    for m in CODED.finditer(text):
        for kind, start, end in keys(m[0]):
            yield kind, m.start() + start, m.start() + end
    for m in HEXES.finditer(text):
        raw = bytes.fromhex(m[0].decode())
        if raw[:1] == b"\x30" and is_key_encoding(raw):
            yield "der", *m.span()


def base(text: bytes, run: bool = True) -> Iterator[tuple[str, int, int]]:
    """The base patterns. run: whether the text has a run of 16 coded bytes, without which no hex run is long enough."""
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= 12:
                yield "assign", *m.span()
    if b"AKIA" in text:
        for m in ACCESS.finditer(text):
            if m.end() - m.start() >= 18:
                yield "access", *m.span()
    if run:
        for m in HEX.finditer(text):
            yield "hex", *m.span()


def longest_run(text: bytes) -> int:
    """Bytes of the longest run of base64 characters; every hex run lies in one, and every candidate for a key begins with one."""
    breaks = np.flatnonzero(~LONG[np.frombuffer(text, np.uint8)])
    if not len(breaks):
        return len(text)
    return int(max(breaks[0], len(text) - 1 - breaks[-1], np.diff(breaks).max(initial=1) - 1))


def spans(text: bytes) -> list[tuple[str, int, int]]:
    """All spans in code points, by start and then kind; (kind, start, end)."""
    run = longest_run(text)
    found = {*base(text, run >= 16), *confirmed(text, run >= LEAST)}
    if not found:
        return []
    if not text.isascii():
        chars = np.concatenate(([0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)))
        found = {(k, int(chars[a]), int(chars[b])) for k, a, b in found}
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


FOUND = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan(docs: DataFrame, text_col: str = "text", out: str = "secrets", keep: list[str] | None = None) -> DataFrame:
    """Append the spans found, as an array of (kind, start, end)."""
    return map_text(docs, text_col, [(out, FOUND, ARROW)], lambda texts: ([[{"kind": k, "start": a, "end": b} for k, a, b in spans(t or b"")] for t in texts],), keep)


