"""Secret scans with structural confirmation.

Base kinds are patterns: ``assign`` (a named credential), ``access`` (an access key id), ``hex`` (a long hex run).  The method
adds what proves to be a key by its structure: every base64, base64url or hex run is decoded, and reported only if it parses -

* ``pem``  an armoured block whose body decodes to a private key (or, encrypted, to whole cipher blocks),
* ``jwt``  a signed token: the header segment decodes to a JSON object naming an algorithm, the payload to a JSON object,
* ``der``  a private key in ASN.1: every nested length fits its parent exactly, with the members of such a key,
* ``ssh``  a private key container with consistent length-prefixed fields.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import arrow_map
from .spans import digest, masked, scan

BASE_KINDS = ["assign", "access", "hex"]
KINDS = [*BASE_KINDS, "pem", "jwt", "der", "ssh"]

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}+={0,2}")
#: The next line of a run that is wrapped, with real or written-out line ends.
_NEXT = re.compile(r"(?:\r?\n[\x20\t>]*|\\r?\\n)([A-Za-z0-9+/_-]++={0,2})")
#: Where a key may begin in a run: base64 of a sequence of 32 bytes or more, of the container's magic or of armour, or these in hex.
_HEAD = re.compile(r"(?:^|(?<=[/+_-]))(?:M[C-I]|b3BlbnNzaC1rZXktdjE|LS0tLS1CRUdJTi|30(?=[2-8])|6[fF]70656[eE]7373682[dD])")
_TOKEN = re.compile(r"(?<![A-Za-z0-9_-])((?:e[wy]|I[A-P]|[CD][Q-Zg-v])[A-Za-z0-9_-]*+)\.([A-Za-z0-9_-]++)(?:\.([A-Za-z0-9_-]*+))?")
_BEGIN = re.compile(r"-----BEGIN ([A-Z0-9 ]{0,40}PRIVATE KEY)-----")

#: A text that this does not match holds neither base nor added spans.
_ANY = r"""(?i:password|passwd|secret|token|api_?key)["']? *[:=] *["']?[A-Za-z0-9+/_.=-]{6}|AKIA[A-Z0-9]{16}|[A-Za-z0-9+/_-]{24}|-----BEGIN |(?:e[wy]|I[A-P]|[CD][Q-Zg-v])[A-Za-z0-9_-]{9}[A-Za-z0-9_-]*\."""


def unbase64(s: str) -> bytes | None:
    """Base64 or base64url, padded or not; None if it is neither."""
    s = s.rstrip("=").replace("-", "+").replace("_", "/")
    if len(s) % 4 == 1:
        return None
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _length(data: bytes, at: int) -> tuple[int, int] | None:
    """The length of the ASN.1 element whose length bytes begin at ``at``, and where its contents do."""
    if at >= len(data):
        return None
    n, at = data[at], at + 1
    if n & 0x80:
        k = n & 0x7F
        if not 1 <= k <= 4 or at + k > len(data):
            return None
        n, at = int.from_bytes(data[at : at + k], "big"), at + k
    return n, at


def tlv(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """The ASN.1 elements that fill ``data[at:end]`` exactly, as ``(tag, start, end)`` of their contents; None if they, or those
    nested in them at any depth, don't."""
    top = []
    todo = [(at, end)]
    while todo:
        i, stop = todo.pop()
        first = not top
        while i < stop:
            got = _length(data, i + 1)
            if not got or got[0] + got[1] > stop:
                return None
            if first:
                top.append((data[i], got[1], got[0] + got[1]))
            if data[i] & 0x20 and got[0]:
                todo.append((got[1], got[0] + got[1]))
            i = got[0] + got[1]
    return top


def is_private_der(data: bytes) -> bool:
    """A private key in PKCS#1, PKCS#8 (plain or encrypted) or SEC 1 form, all nested lengths consistent."""
    top = tlv(data, 0, len(data)) if data[:1] == b"\x30" else None
    if not top or len(top) != 1:
        return False
    inner = tlv(data, top[0][1], top[0][2]) or []
    tags = [x[0] for x in inner]
    number = lambda x: int.from_bytes(data[x[1] : x[2]], "big")
    if tags[:9] == [0x02] * 9 and number(inner[0]) in (0, 1):
        return True
    if tags[:3] == [0x02, 0x30, 0x04] and number(inner[0]) in (0, 1):
        return data[inner[1][1]] == 0x06
    if tags[:2] == [0x02, 0x04] and number(inner[0]) == 1 and inner[1][2] - inner[1][1] in (20, 24, 28, 32, 48, 66):
        return True
    return tags == [0x30, 0x04] and inner[0][2] > inner[0][1] and data[inner[0][1]] == 0x06 and inner[1][2] - inner[1][1] >= 32


_MAGIC = b"openssh-key-v1\0"


def is_private_ssh(data: bytes) -> bool:
    """The private-key container: its magic, then cipher, kdf, options, count and fields by length prefix."""
    if not data.startswith(_MAGIC):
        return False
    at, fields = len(_MAGIC), 0
    while at + 4 <= len(data):
        n = int.from_bytes(data[at : at + 4], "big")
        at += 4
        if fields == 3:  # the number of keys is not a length
            fields += 1
            continue
        if at + n > len(data):
            return False
        at, fields = at + n, fields + 1
    return at == len(data) and fields >= 6


def is_token(head: str, body: str) -> bool:
    """A signed or encrypted token: a JSON header with an algorithm, and a JSON payload unless it is encrypted."""
    try:
        h = json.loads(unbase64(head) or b"")
        if not isinstance(h, dict) or not isinstance(h.get("alg"), str):
            return False
        return "enc" in h or isinstance(json.loads(unbase64(body) or b""), dict)
    except (ValueError, RecursionError):
        return False


def _pem(text: str) -> list[tuple[int, int]]:
    """Bounds of the armoured blocks whose body proves to be a key.  A block ends before the next begins, however long it is."""
    begins = list(_BEGIN.finditer(text))
    out = []
    for m, stop in zip(begins, [*(x.start() for x in begins[1:]), len(text)]):
        tail = f"-----END {m[1]}-----"
        end = text.find(tail, m.end(), stop)
        if end < 0:
            continue
        lines = text[m.end() : end].replace("\\r", "").replace("\\n", "\n").split("\n")
        raw = unbase64("".join(x.strip(" \t\r>") for x in lines if ":" not in x)) or b""
        if is_private_der(raw) or is_private_ssh(raw) or (any("ENCRYPTED" in x for x in lines) and len(raw) >= 32 and len(raw) % 8 == 0):
            out.append((m.start(), end + len(tail)))
    return out


def _begins_as_key(head: bytes) -> bool:
    """Whether the first element in a sequence, as far as ``head`` shows it, may be that of a private key: a number 0 or 1, or a
    sequence that begins with an object's name."""
    outer = _length(head, 1)
    at = outer[1] if outer else len(head)
    inner = _length(head, at + 1) if at + 1 < len(head) else None
    if not inner or inner[1] >= len(head):
        return at + 3 >= len(head)  # not to be seen
    size, body = inner
    if head[at] == 0x02:
        return body + size > len(head) or int.from_bytes(head[body : body + size], "big") in (0, 1)
    return head[at] == 0x30 and (size == 0 or head[body] == 0x06)


def _reach(text: str, end: int, known: dict[int, int]) -> int:
    """Characters, without padding, of the lines that wrap on after ``end``; lines of one stretch are walked once."""
    if end in known:
        return known[end]
    ends, sizes, at, last = [end], [], end, ""
    while "=" not in last and (m := _NEXT.match(text, at)) and (not sizes or len(m[1]) <= sizes[0] == len(last)):
        last, at = m[1], m.end()
        ends.append(at), sizes.append(len(last))
    left = 0
    for k in range(len(sizes) - 1, -1, -1):
        left += sizes[k] - (len(last) - len(last.rstrip("=")) if k == len(sizes) - 1 else 0)
        if k == 0 or k < len(sizes) - 1:  # from the line before the last on, the width is another
            known[ends[k]] = left
    return known.setdefault(end, 0)


def _key(text: str, start: int, end: int, known: dict[int, int]) -> tuple[str, int] | None:
    """Kind and end of the key that begins at ``start`` in a run that ends at ``end``: in it alone, or with the lines after it, of
    which all but the last are equally long.  A sequence tells its length and a container its cipher, so what does not fit is
    never decoded."""
    is_hex = text[start] in "36"
    if is_hex:
        decode = lambda x: bytes.fromhex(x) if len(x) % 2 == 0 and re.fullmatch("[0-9A-Fa-f]+", x) else None
    else:
        decode = unbase64
    size = end - start
    while text[start + size - 1] == "=":
        size -= 1
    head = decode(text[start : min(end, start + 48)]) or b""
    whole = None  # characters of the key, without padding
    if head[:1] == b"\x30":
        got = _length(head, 1)
        whole = 2 * sum(got) if got and is_hex else -(-4 * sum(got) // 3) if got else 0
        if size > whole or not _begins_as_key(head) or (size < whole and (text[end - 1] == "=" or size + _reach(text, end, known) < whole)):
            return None
    elif not head.startswith(b"-----BEGIN ") and not (head.startswith(_MAGIC) and len(head) > 20 and int.from_bytes(head[15:19], "big") < 64 and head[19:20].isalpha()):
        return None

    def kind(raw: bytes | None) -> str | None:
        if not raw:
            return None
        if whole is not None:
            return "der" if is_private_der(raw) else None
        return "ssh" if is_private_ssh(raw) else "pem" if raw.startswith(b"-----BEGIN") and _pem(raw.decode("utf-8", "replace")) else None

    lines, width, before = [text[start:end]], 0, end
    if whole is None and (k := kind(decode(lines[0]))):
        return k, end
    while whole is None or size < whole:
        m = _NEXT.match(text, end) if "=" not in lines[-1] else None
        if not m or (width and len(m[1]) > width) or (len(lines) > 1 and len(lines[-1]) < width):
            break
        width = width or len(m[1])
        lines.append(m[1])
        size, before, end = size + len(m[1].rstrip("=")), end, m.end()
    if whole is not None:
        k = kind(decode("".join(lines))) if size == whole else None
        return (k, end) if k else None
    for n, at in ((len(lines), end), (len(lines) - 1, before)):  # a last word may be no part of it
        if n > 1 and (k := kind(decode("".join(lines[:n])))):
            return k, at
    return None


def find_secrets(text: str) -> list[tuple[str, int, int, bool]]:
    """All spans of one text, by start and then kind as in ``KINDS``."""
    out = [("assign", *m.span(), True) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [("access", *m.span(), True) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", *m.span(), True) for m in _HEX.finditer(text)]
    blocks = _pem(text)
    out += [("pem", *x, False) for x in blocks]
    out += [("jwt", *m.span(), False) for m in _TOKEN.finditer(text) if is_token(m[1], m[2])]
    b, done, known = 0, 0, {}
    for m in _RUN.finditer(text):
        while b < len(blocks) and blocks[b][1] <= m.start():
            b += 1
        if (b < len(blocks) and blocks[b][0] <= m.start()) or m.start() < done:
            continue  # inside a confirmed block, or a line of a key that is found
        for h in _HEAD.finditer(m[0]):
            got = _key(text, m.start() + h.start(), m.end(), known)
            if got:
                out.append((got[0], m.start() + h.start(), got[1], False))
                done = got[1]
                break
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def _find(col: pa.Array) -> list[list[tuple[str, int, int, bool]]]:
    hit = pc.match_substring_regex(col, _ANY).to_pylist()
    out: list[list] = [[] for _ in hit]
    for i, h in enumerate(hit):
        if h:
            out[i] = find_secrets(col[i].as_py())
    return out


def scan_secrets(docs: DataFrame, text_col: str = "text", out_col: str = "spans") -> DataFrame:
    """``docs`` with ``out_col``, an array of ``(kind, start, end, base)``: code points, end exclusive, by start and then kind.

    Every text is scanned whole, however long; a null or empty one has no spans.  Each row stands alone, so nulls, ties and
    repeats in other columns change nothing, and those columns are kept under their names, but for one called ``out_col``, which
    is replaced.  An empty table gives an empty result.
    """
    return scan(docs, _find, text_col, out_col)


def redact_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span of its texts replaced by ``[SECRET]``; a text without one, null or empty stays as it is.

    All rows and columns are kept; see ``scan_secrets`` for nulls, repeats and empty tables.
    """
    names = docs.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column(at).cast(pa.string()) if not pa.types.is_string(b.column(at).type) else b.column(at)
            found = _find(col)
            hit = [i for i, f in enumerate(found) if f]
            if hit:
                new = pa.array([masked(col[i].as_py(), [(s, e, "[SECRET]") for _, s, e, _ in found[i]]) for i in hit], pa.string())
                mask = np.zeros(len(col), bool)
                mask[hit] = True
                col = pc.replace_with_mask(col, pa.array(mask), new)
            yield pa.RecordBatch.from_arrays([*b.columns[:at], col, *b.columns[at + 1 :]], names)

    return arrow_map(docs, run, docs.schema)


def op3_secret_scan(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digest(scan_secrets(docs), "doc_id", BASE_KINDS)
