"""Secret scans with structural confirmation.

Patterns find base spans (assignments, access keys, long hex). Candidates in base64 or hex are then decoded, and a span
is added only where the decoded bytes parse: DER key encodings with consistent nested lengths (plain or encrypted), OpenSSH
key containers with consistent length prefixes, armour around either of them, and signed tokens whose header is a JSON object
naming an algorithm. Base64 may be wrapped, with line ends as such or escaped, and may follow any separator.

A cheap linear pre-test of each batch leaves the Python matcher only those texts that hold a candidate at all.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import text_of

#: Kinds in the order that breaks ties of equal starts; the first three are the base kinds.
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "der", "ssh", "pem", "jwt")

_ASSIGN = re.compile(
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"""
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
# a run shorter than required fails at each later start too, so the least length can stand in the pattern
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_BREAK = r"(?:[ \t]*(?:\r?\n|(?:\\r)?\\n)[ \t]*)"
#: How base64 of DER sequences, OpenSSH containers and armour starts; the rest of the run may be wrapped.
_B64 = re.compile(r"(?<![A-Za-z0-9])(?=M[CDEFGHI]|b3BlbnNzaC1rZXktdjEA|LS0tLS1CRUdJTi)")
_RUN = re.compile(rf"(?:[A-Za-z0-9+/_-]++(?:{_BREAK}(?=[A-Za-z0-9+/_-]))?+)++={{0,2}}")
_BREAKS = re.compile(r"\\[rn]|\s")
_HEXKEY = re.compile(r"(?<![0-9A-Za-z])(?:0[xX])?([0-9A-Fa-f]{48,}+)(?![0-9A-Za-z])")
_JWT = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{16,}+\.[A-Za-z0-9_-]{2,}+\.[A-Za-z0-9_-]*+")
_PEM = re.compile(
    rf"-----BEGIN ([A-Z0-9 ]{{0,40}}PRIVATE KEY)-----((?:{_BREAK}[A-Za-z0-9-]+: [^\n\\]*+)*+)((?:[A-Za-z0-9+/=\s]++|(?:\\r)?\\n)*+)-----END \1-----"
)
_LOCKED = re.compile(r"Proc-Type: 4,ENCRYPTED\b.*DEK-Info: ([A-Z0-9-]+),([0-9A-Fa-f]{16,32})\s*\Z", re.DOTALL)
#: Holds wherever any of the patterns above can match; letters of any case may match more.
_PRETEST = (
    r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]|AKIA|[0-9a-f]{24}|[A-Za-z0-9+/_-]{40}|M[C-I][A-Za-z0-9+/_-]{6}"""
    r"""|[A-Za-z0-9_-]{16}\.[A-Za-z0-9_-]{2}|-----BEGIN """
)
_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _nested(data: bytes, at: int, end: int, depth: int) -> list[int] | None:
    """Tags of the DER elements that fill ``data[at:end]`` exactly, lengths checked at each level; else None."""
    tags: list[int] = []
    while at < end:
        if end - at < 2 or depth > 12:
            return None
        tag, size, at = data[at], data[at + 1], at + 2
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or end - at < n or data[at] == 0:
                return None
            size, at = int.from_bytes(data[at : at + n], "big"), at + n
            if size < 128:
                return None
        if size > end - at:
            return None
        if tag & 0x20 and _nested(data, at, at + size, depth + 1) is None:
            return None
        tags.append(tag)
        at += size
    return tags


def is_der_key(data: bytes) -> bool:
    """Whether the bytes are one DER sequence as private keys are: a version, then integers or nested parts; or, encrypted, an
    algorithm that starts with its identifier, and the cipher text."""
    if len(data) < 24 or data[0] != 0x30 or _nested(data, 0, len(data), 0) != [0x30]:
        return False
    body = 2 + (data[1] & 0x7F if data[1] & 0x80 else 0)
    tags = _nested(data, body, len(data), 1) or []
    if tags == [0x30, 0x04]:
        inner = body + 2 + (data[body + 1] & 0x7F if data[body + 1] & 0x80 else 0)
        return data[inner] == 0x06 and data[inner + 1] >= 5
    return len(tags) >= 2 and tags[0] == 0x02 and data[body + 1] == 1 and tags[1] in (0x02, 0x04, 0x30)


def _declared(head: bytes) -> int | None:
    """Bytes of the DER sequence that starts so, if what follows its length can start a private key."""
    if len(head) < 12 or head[0] != 0x30:
        return None
    n = head[1] & 0x7F if head[1] & 0x80 else 0
    if n > 4 or head[1] == 0x80:
        return None
    size, inner = (int.from_bytes(head[2 : 2 + n], "big") if n else head[1]), head[2 + n : 5 + n]
    return size + 2 + n if inner[:2] == b"\x02\x01" or inner[:1] == b"\x30" else None


def is_ssh_key(data: bytes) -> bool:
    """Whether the bytes are an OpenSSH private key container with consistent length prefixes."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return False
    at = len(magic)

    def string() -> bool:
        nonlocal at
        if len(data) - at < 4:
            return False
        at += 4 + int.from_bytes(data[at : at + 4], "big")
        return at <= len(data)

    if not (string() and string() and string()) or len(data) - at < 4:
        return False
    keys, at = int.from_bytes(data[at : at + 4], "big"), at + 4
    return 1 <= keys <= 16 and all(string() for _ in range(keys)) and string()


def _b64(text: str) -> bytes | None:
    body = text.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _is_armour(m: re.Match) -> bool:
    """Whether what armour holds is a key; a locked key can't be read, but its cipher text has whole blocks."""
    data = _b64("".join(m[3].replace("\\r", "").replace("\\n", "").split()))
    locked = _LOCKED.search(m[2].replace("\\r", "").replace("\\n", "\n")) if m[2] else None
    if locked:
        return bool(data) and len(data) % (len(locked[2]) // 2) == 0
    return bool(data) and (is_der_key(data) or is_ssh_key(data))


def _key_kind(data: bytes | None) -> str | None:
    if not data:
        return None
    if is_der_key(data):
        return "der"
    if is_ssh_key(data):
        return "ssh"
    if data[:11] == b"-----BEGIN ":
        found = _PEM.search(data.decode("latin-1"))
        if found and _is_armour(found):
            return "pem"
    return None


def _b64_key(text: str, at: int) -> tuple[str, int] | None:
    """(kind, end) of the key whose base64 starts at ``at``. A DER sequence ends where its length says, others with the run."""
    chars, to = 0, len(text)
    if text[at] == "M":
        head = _RUN.match(text, at, min(to, at + 96))
        size = _declared(_b64(_BREAKS.sub("", head[0])[:24]) or b"") if head else None
        if not size or size > to - at:
            return None
        chars = -(-size * 4 // 3)  # without padding
        to = min(to, at + 2 * chars + 64)
    run = _RUN.match(text, at, to)
    if run is None:
        return None
    body, end = _BREAKS.sub("", run[0]), run.end()
    if chars:
        if len(body.rstrip("=")) < chars:
            return None
        if len(body.rstrip("=")) > chars:  # more follows the sequence
            if body[chars].isalnum():
                return None
            end, left = at, chars
            for part in re.finditer(r"[A-Za-z0-9+/_-]+", re.sub(r"\\[rn]", "\n\n", run[0])):
                if len(part[0]) >= left:
                    end = at + part.start() + left
                    break
                left -= len(part[0])
        body = body[:chars]
    kind = _key_kind(_b64(body))
    return (kind, end) if kind else None


def is_signed_token(token: str) -> bool:
    """Whether the first part decodes to a JSON object with an algorithm."""
    data = _b64(token.split(".", 1)[0])
    if not data or data[:1] != b"{":
        return False
    try:
        head = json.loads(data)
    except ValueError:
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str)


def scan(text: str) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) in code points, end exclusive, by start and then kind."""
    spans = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    spans += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    spans += [("hex", *m.span()) for m in _HEX.finditer(text)]
    beyond = 0
    for m in _B64.finditer(text):
        if m.start() >= beyond and (found := _b64_key(text, m.start())):
            beyond = found[1]
            spans.append((found[0], m.start(), beyond))
    for m in _HEXKEY.finditer(text):
        if len(m[1]) % 2 == 0 and (kind := _key_kind(bytes.fromhex(m[1]))):
            spans.append((kind, *m.span(1)))
    if "-----BEGIN " in text:
        spans += [("pem", *m.span()) for m in _PEM.finditer(text) if _is_armour(m)]
    spans += [("jwt", *m.span()) for m in _JWT.finditer(text) if is_signed_token(m[0])]
    return sorted(set(spans), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _scan_batches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        found: list[list[dict]] = [[] for _ in range(len(texts))]
        hit = pc.indices_nonzero(pc.fill_null(pc.match_substring_regex(texts, _PRETEST), False)).to_pylist()
        for i in hit:
            found[i] = [{"kind": k, "start": a, "end": b} for k, a, b in scan(texts[i].as_py())]
        yield pa.array(found, _TYPE)


def spans(text: Column) -> Column:
    """Column of the spans of a text: array<struct<kind, start, end>>; empty for null and empty texts."""
    udf = F.arrow_udf(_scan_batches, "array<struct<kind:string,start:bigint,end:bigint>>")
    return udf(text)


def with_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with a column ``spans`` (replacing one of that name). Whole texts; null counts as empty.

    Rows are independent: repeats give equal spans, other columns may hold anything; an empty table stays empty.
    """
    return docs.withColumn("spans", spans(text_of(text_col)))


def _joined(found: Column) -> Column:
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(found, one), ",")


def digest(docs: DataFrame) -> DataFrame:
    """Per document the counts of base spans, their hash, and all spans as text. Null and empty texts have none; ids may be
    null or repeat; other columns are ignored; an empty table gives an empty result."""
    found = with_spans(docs.select("doc_id", "text")).select("doc_id", "spans")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id",
        *(count(k) for k in BASE),
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
    )


def _redact(text: str | None, found: list[tuple[int, int]], mask: str) -> str | None:
    out, at = [], 0
    for a, b in sorted(found):
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], mask]
        at = b
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, mask: str = "[secret]") -> DataFrame:
    """``docs`` with each span replaced by ``mask`` (overlapping spans by one); no row is dropped.

    Texts without a span, null ones included, stay as they are, and only they skip the Python worker's rewrite.
    """

    def rewrite(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            hit = pc.indices_nonzero(pc.fill_null(pc.match_substring_regex(texts, _PRETEST), False)).to_pylist()
            out: list[str | None] = [None] * len(texts)
            for i in hit:
                text = texts[i].as_py()
                if found := scan(text):
                    out[i] = _redact(text, [(a, b) for _, a, b in found], mask)
            yield pa.array(out, pa.string())

    new = F.arrow_udf(rewrite, "string")(F.col("text"))
    return docs.withColumn("text", F.coalesce(new, F.col("text")))
