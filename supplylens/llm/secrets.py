"""Secret scans with structural confirmation.

Three base patterns report by their form alone. Further candidates are reported only when
their content holds: base64 and hex runs are decoded and parsed as private-key encodings
(every nested length must fit), PEM blocks likewise, and signed tokens must carry a JSON
header that names an algorithm.

Cases: a null or empty text has no spans; rows keep their null or repeated ids, one result per
input row; other columns are ignored whatever their names; texts are scanned whole, each
pattern in time linear in the text.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from supplylens.llm.common import bounded_batches, read

BASE = ("assign", "access", "hex")
#: Order of kinds that start at the same place.
KINDS = (*BASE, "pem", "jwt", "key_der", "key_ssh")

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
PEM = re.compile(r"-----BEGIN ([A-Z0-9]+ )*PRIVATE KEY-----([^-]*)-----END ([A-Z0-9]+ )*PRIVATE KEY-----")
SIGNED = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)")
#: Runs that may hold an encoded key: 32 characters encode 24 bytes, less than any key.
RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}={0,2}")
ALL_HEX = re.compile(r"(?:[0-9a-fA-F]{2})+")
MAGIC = b"openssh-key-v1\0"
#: Line ends as JSON and shell strings write them, and the fixed first bytes of the names of password-based encryption.
ESCAPED = re.compile(r"(?:\\+[nrt])+")
SCHEMES = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))


def _elements(data: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    """The (tag, start, end) of the DER elements that fill data[start:end], None if they don't."""
    found = []
    while start < end:
        if end - start < 2:
            return None
        tag, size = data[start], data[start + 1]
        start += 2
        if size >= 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or end - start < n:
                return None
            size = int.from_bytes(data[start : start + n], "big")
            start += n
        if size > end - start:
            return None
        found.append((tag, start, start + size))
        start += size
    return found


def is_der_key(data: bytes) -> bool:
    """Whether the bytes are a private key: PKCS#1, PKCS#8 (encrypted or not), SEC1 or DSA with all nested lengths right."""
    top = _elements(data, 0, len(data)) if data[:1] == b"\x30" else None
    if not top or len(top) != 1 or top[0][0] != 0x30:
        return False
    inner = _elements(data, *top[0][1:])
    if inner and [x[0] for x in inner] == [0x30, 0x04]:  # an encrypted key names its scheme before the bytes
        scheme = _elements(data, *inner[0][1:])
        return bool(scheme) and scheme[0][0] == 0x06 and data[scheme[0][1] : scheme[0][2]].startswith(SCHEMES)
    if not inner or inner[0][0] != 0x02 or inner[0][2] - inner[0][1] != 1:
        return False
    todo = [x for x in inner if x[0] & 0x20]
    while todo:
        parts = _elements(data, *todo.pop()[1:])
        if parts is None:
            return False
        todo += [x for x in parts if x[0] & 0x20]
    tags = [x[0] for x in inner]
    pkcs1 = len(tags) >= 9 and set(tags[:9]) == {0x02}
    pkcs8 = len(tags) >= 3 and tags[1:3] == [0x30, 0x04]
    sec1 = len(tags) >= 2 and tags[1] == 0x04 and data[inner[0][1]] == 1
    dsa = tags == [0x02] * 6 and data[inner[0][1]] == 0
    return pkcs1 or pkcs8 or sec1 or dsa


def is_ssh_key(data: bytes) -> bool:
    """Whether the bytes are an OpenSSH private key: magic, three strings, the number of keys, as many
    public keys and the private part, which ends the data."""
    if not data.startswith(MAGIC):
        return False
    at, left = len(MAGIC), 3
    counted = False
    while left:
        if len(data) - at < 4:
            return False
        size, at = int.from_bytes(data[at : at + 4], "big"), at + 4
        if size > len(data) - at:
            return False
        at, left = at + size, left - 1
        if not left and not counted:
            # Each public key takes four bytes or more, so a wrong number ends the walk.
            number, at, counted = int.from_bytes(data[at : at + 4], "big"), at + 4, True
            left = number + 1 if 0 < number < len(data) else 0
            if not left:
                return False
    return at == len(data) and size > 0


def _unbase64(run: str) -> bytes | None:
    run = run.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(run + "=" * (-len(run) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _is_signed(header: str, payload: str) -> bool:
    try:
        head, body = (json.loads(_unbase64(x) or b"") for x in (header, payload))
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str) and isinstance(body, dict)


def _key_kind(data: bytes | None) -> str | None:
    if not data:
        return None
    return "key_der" if is_der_key(data) else "key_ssh" if is_ssh_key(data) else None


def find(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every secret in a text, by start and then by the order of kinds."""
    found: list[tuple[str, int, int]] = []
    if ":" in text or "=" in text:
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    if "-----BEGIN" in text:
        found += [("pem", *m.span()) for m in PEM.finditer(text) if _key_kind(_unbase64("".join(ESCAPED.sub("", m[2]).split())))]
    if "eyJ" in text:
        found += [("jwt", *m.span()) for m in SIGNED.finditer(text) if _is_signed(m[1], m[2])]
    for m in RUN.finditer(text):
        kind = _key_kind(_unbase64(m[0]))
        if kind is None and ALL_HEX.fullmatch(m[0]):
            kind = _key_kind(bytes.fromhex(m[0]))
        if kind:
            found.append((kind, *m.span()))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = [
            [{"kind": k, "start": a, "end": b} for k, a, b in find(t)] if t else [] for t in batch.column(1).to_pylist()
        ]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(SPAN))], ["id", "spans"])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id and its spans, array<struct<kind, start, end>>."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    found = rows.mapInArrow(_scan, f"id {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>")
    return found.withColumnRenamed("id", id_col)


def joined(spans):
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.col("spans")
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    base = F.filter(spans, lambda s: s["kind"].isin(*BASE))
    return scan(read(spark, sf_dir, "documents")).select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in BASE),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(spans).alias("spans"),
    )


QUERIES = {"op1_secret_scan": query}
ORACLES: dict[str, str] = {}
