"""Secret scans: pattern candidates, and structural confirmation of what they decode to."""

from __future__ import annotations

import base64
import binascii
import json
import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._spark import Positional

#: Kinds in the order in which spans of one start are listed; the first three are patterns alone, the rest are confirmed by structure.
KINDS = ("assign", "access", "hex", "jwt", "pem", "der", "sshkey")
BASE_KINDS = KINDS[:3]
SPANS = T.ArrayType(T.StructType().add("kind", "string").add("start", "integer").add("end", "integer"))
_SPANS_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

_ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ASSIGN_CUES = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # runs are maximal, so this finds the runs of [0-9a-f]+ that are long enough
#: Also what begins like a token and goes on otherwise, so that no place in it is tried again.
_JWT = re.compile(r"eyJ[A-Za-z0-9_-]++(?:\.[A-Za-z0-9_-]++(?P<whole>\.)[A-Za-z0-9_-]*+)?")
#: A key's encoding has at most so many bytes (that of a 16,384-bit private key has 9,300).
MAX_KEY_BYTES = 1 << 16
#: A body's lines may be broken by white space, by escaped line ends and by the quotes of string literals. Repeats are
#: possessive: a body holds no hyphen, so it can end in one place only.
_PEM = re.compile(r"""-----BEGIN ([A-Z0-9 ]++)-----((?:[A-Za-z0-9+/=\s"',]++|\\++[nrt]?+)++)-----END \1-----""")
_PEM_BREAK = re.compile(r"""\\+[nrt]?|[\s"',]+""")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{40,}={0,2}")
#: Runs that a key may begin with (a SEQUENCE, an algorithm's length, the container's name), at a run's start or after an escaped line end.
_WRAPPED = re.compile(r"(?:(?<![A-Za-z0-9+/_-])|(?<=\\[nr]))(?=M[A-P]|AAAA[B-P]|b3BlbnNzaC1r)[A-Za-z0-9+/_-]{16,}={0,2}")
_NEXT_LINE = re.compile(r"[\x20\t]*+(?:\r?\n|(?:\\++[nr])+)[\x20\t]*+([A-Za-z0-9+/_-]++={0,2})")
_SSH_NAME = re.compile(rb"\0\0\0[\x01-\x40](?:ssh|ecdsa|sk)-")
_ANY_HEX = re.compile(r"[0-9A-Fa-f]{24,}")
_ANY_HEX_TABLE = bytes(120 if chr(b) in "0123456789abcdefABCDEF" else 32 for b in range(256))
_HEX_TABLE = bytes(120 if chr(b) in "0123456789abcdef" else 32 for b in range(256))
_RUN_TABLE = bytes(120 if chr(b).isalnum() and b < 128 or chr(b) in "+/_-" else 32 for b in range(256))


def der_is_whole(data: bytes, depth: int = 0) -> bool:
    """True if data is DER elements end to end whose constructed ones hold such elements in turn."""
    at = 0
    while at < len(data):
        if at + 2 > len(data):
            return False
        tag, size = data[at], data[at + 1]
        at += 2
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > len(data):
                return False
            size = int.from_bytes(data[at : at + n], "big")
            at += n
        if at + size > len(data):
            return False
        if tag & 0x20 and depth < 8 and not der_is_whole(data[at : at + size], depth + 1):
            return False
        at += size
    return True


def is_der_key(data: bytes) -> bool:
    """A SEQUENCE over all of data, whole inside, whose first element is an INTEGER, a SEQUENCE or an OBJECT IDENTIFIER."""
    if len(data) < 16 or data[0] != 0x30 or not der_is_whole(data):
        return False
    size = data[1]
    head = 2 + (size & 0x7F if size & 0x80 else 0)
    whole = size if size < 0x80 else int.from_bytes(data[2:head], "big")
    return head + whole == len(data) and data[head] in (0x02, 0x06, 0x30)


def is_ssh_key(data: bytes) -> bool:
    """Strings with 4-byte lengths end to end, at least two, the first an algorithm's name; or the private key container."""
    if data.startswith(b"openssh-key-v1\0"):
        return True
    at, parts = 0, []
    while at < len(data):
        if at + 4 > len(data):
            return False
        size = int.from_bytes(data[at : at + 4], "big")
        at += 4
        if at + size > len(data):
            return False
        parts.append(data[at : at + size])
        at += size
    return len(parts) > 1 and re.fullmatch(rb"(ssh|ecdsa|sk)-[a-z0-9@.-]+", parts[0]) is not None


def _unbase64(text: str) -> bytes | None:
    text = text.rstrip("=").replace("-", "+").replace("_", "/")
    if len(text) % 4 == 1:
        return None
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def is_signed_token(text: str) -> bool:
    """Three dotted parts: a JSON object with `alg`, and a JSON object. What nests too deep to be read is none."""
    try:
        head, body = (json.loads(_unbase64(x) or b"") for x in text.split(".")[:2])
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str) and isinstance(body, dict)


def _key_kind(data: bytes | None) -> str | None:
    if not data:
        return None
    return "der" if is_der_key(data) else "sshkey" if is_ssh_key(data) else None


class _Lines:
    """Chains of consecutive lines of base64 in a text, each read once: the lines, their ends, and for each line the
    last one that follows it at the same width without padding between."""

    def __init__(self, text: str):
        self.text = text
        self.places: dict[int, tuple[tuple[list[str], list[int], list[int]], int]] = {}

    def at(self, first: re.Match) -> tuple[tuple[list[str], list[int], list[int]], int]:
        """The chain that holds a line, and the line's place in it."""
        if first.start() not in self.places:
            lines, starts, ends = [first[0]], [first.start()], [first.end()]
            while m := _NEXT_LINE.match(self.text, ends[-1]):
                lines.append(m[1])
                starts.append(m.start(1))
                ends.append(m.end())
            last = list(range(len(lines)))
            for k in range(len(lines) - 2, -1, -1):
                if len(lines[k]) == len(lines[k + 1]) and "=" not in lines[k]:
                    last[k] = last[k + 1]
            chain = (lines, ends, last)
            self.places |= {start: (chain, k) for k, start in enumerate(starts)}
        return self.places[first.start()]


def _wrapped_key(text_lines: _Lines, first: re.Match) -> tuple[str, int] | None:
    """Kind and end of the key whose first line is given: lines of one width, and a last one that may be shorter. Keys
    have at most MAX_KEY_BYTES, so a place costs no more than that."""
    need = None
    most = -(-4 * MAX_KEY_BYTES // 3)
    if first[0][0] == "M":  # the SEQUENCE tells its length, so what follows it in lines of its own is left
        head = _unbase64(first[0][:16]) or b"00"
        n = head[1] & 0x7F if head[1] & 0x80 else 0
        need = -(-4 * (2 + n + (int.from_bytes(head[2 : 2 + n], "big") if n else head[1])) // 3)
    elif not first[0].startswith("b3BlbnNzaC1r") and not _SSH_NAME.match(_unbase64(first[0].rstrip("=")[: len(first[0]) // 4 * 4]) or b""):
        return None
    (lines, ends, last), k = text_lines.at(first)
    width, end = len(lines[k]), last[k] + 1
    if "=" not in lines[end - 1] and end < len(lines) and len(lines[end]) < width:
        end += 1
    if need is not None:
        end = min(end, k + max(1, -(-need // width)))
    if max(need or 0, (end - k) * width) > most + width:
        return None
    for stop in (end, end - 1) if need is None else (end,):
        if stop > k and (kind := _key_kind(_unbase64("".join(lines[k:stop])))):
            return kind, ends[stop - 1]
    return None


def _within(spans: list[tuple[int, int]], at: int) -> bool:
    """Whether one of the spans, in order and apart, holds a place."""
    k = bisect_right(spans, (at, float("inf"))) - 1
    return k >= 0 and at < spans[k][1]


def find_secrets(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of one text, in code points, by start and then in the order of KINDS."""
    if not text:
        return []
    found: list[tuple[str, int, int]] = []
    low = text.lower()
    if any(cue in low for cue in _ASSIGN_CUES):
        found += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    raw = text.encode("utf-8", "surrogatepass")
    if b"x" * 24 in raw.translate(_HEX_TABLE):
        for m in _HEX.finditer(text):
            found.append(("hex", m.start(), m.end()))
            if len(m[0]) % 2 == 0 and (kind := _key_kind(bytes.fromhex(m[0]))):
                found.append((kind, m.start(), m.end()))
    if b"x" * 24 in raw.translate(_ANY_HEX_TABLE):
        for m in _ANY_HEX.finditer(text):
            if len(m[0]) % 2 == 0 and (kind := _key_kind(bytes.fromhex(m[0]))):
                found.append((kind, m.start(), m.end()))
    if "eyJ" in text:
        found += [("jwt", m.start(), m.end()) for m in _JWT.finditer(text) if m["whole"] and is_signed_token(m[0])]
    pems = []
    if "-----BEGIN " in text:
        for m in _PEM.finditer(text):
            if _key_kind(_unbase64(_PEM_BREAK.sub("", m[2]))):
                pems.append((m.start(), m.end()))
                found.append(("pem", m.start(), m.end()))
    if b"x" * 40 in raw.translate(_RUN_TABLE):
        for m in _BASE64.finditer(text):
            if not _within(pems, m.start()) and (kind := _key_kind(_unbase64(m[0]))):
                found.append((kind, m.start(), m.end()))
    if "\n" in text or "\\n" in text or "\\r" in text:
        past, lines = 0, _Lines(text)
        for m in _WRAPPED.finditer(text):
            if m.start() >= past and not _within(pems, m.start()) and (key := _wrapped_key(lines, m)):
                past = key[1]
                found.append((key[0], m.start(), past))
    rank = {kind: i for i, kind in enumerate(KINDS)}
    return sorted(set(found), key=lambda x: (x[1], rank[x[0]], x[2]))


@F.arrow_udf(SPANS)
def _spans(texts: pa.Array) -> pa.Array:
    rows = [[{"kind": k, "start": a, "end": b} for k, a, b in find_secrets(x.as_py())] for x in texts]
    return pa.array(rows, _SPANS_ARROW)


def scan_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with secret_spans: kind, start and end (code points, end exclusive) of every secret in the whole text.

    Pattern kinds are as written; jwt, pem, der and sshkey are reported only if the decoded bytes have the structure:
    a signed token's JSON header and body, DER elements or length-prefixed strings that fill the bytes exactly.
    Null and empty texts have no spans, very long ones are read whole in time linear in their length; repeated rows get
    equal spans; an empty table gives an empty result; a column named secret_spans is replaced, all others stay,
    whatever their names.
    """
    p = Positional(docs, ["secret_spans"])
    return p.restore(p.df.withColumn("secret_spans", _spans(p.col(text_col))))


def span_text(spans: F.Column) -> F.Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op3_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Counts, digest and spans of every document's secrets."""
    d = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("text")
    of = lambda *kinds: F.filter("secret_spans", lambda s: s["kind"].isin(*kinds))
    counts = [F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in BASE_KINDS]
    confirmed = F.size("secret_spans") - F.size(of(*BASE_KINDS))
    return d.select(
        "doc_id",
        *counts,
        F.sha2(span_text(of(*BASE_KINDS)).cast("binary"), 256).alias("base_sha256"),
        span_text(F.col("secret_spans")).alias("spans"),
        confirmed.cast("long").alias("n_confirmed"),
    )
