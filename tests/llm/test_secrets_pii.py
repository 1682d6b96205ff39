import base64
import hashlib
import json
import re

from conftest import by_text

from supplylens.llm import pii, secrets

BASE_SECRETS = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    "hex": (re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
}


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def digits(m):
    return re.sub("[^0-9]", "", m[0])


BASE_PII = {
    "email": (re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda m: True),
    "ip": (re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda m: all(int(x) <= 255 for x in m[0].split("."))),
    "card": (re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))),
    "phone": (re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda m: 10 <= len(digits(m)) <= 15),
}


def brute(patterns, text):
    found = [(m.start(), k, kind, m.end()) for k, (kind, (r, ok)) in enumerate(patterns.items()) for m in r.finditer(text or "") if ok(m)]
    return [(kind, a, b) for a, _, kind, b in sorted(found)]


def sha(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def test_base_spans_match_brute_force(spark, docs, sf):
    for module, patterns in ((secrets, BASE_SECRETS), (pii, BASE_PII)):
        query = next(iter(module.QUERIES.values()))
        got = [(r["doc_id"], *(r[f"n_{k}"] for k in patterns), r["base_sha256"]) for r in query(spark, sf).collect()]
        want = []
        for r in docs.select("doc_id", "text").collect():
            spans = brute(patterns, r["text"])
            want.append((r["doc_id"], *(sum(s[0] == k for s in spans) for k in patterns), sha(spans)))
        assert by_text(got) == by_text(want)


def test_odd_texts(spark):
    odd = ["a@b.com_x@y.org", "1.2.3.4.5.6.7.8", "+1+2 +12345678901-", "9" * 5000, "1-2 " * 4000, "a@" * 3000, "." * 4000 + "@a.b", "x@-.-", "00001.02.3.0255", "+1 234 567 8901 4111 1111 1111 1111", "ſecret=abcdefg toKen=abcdefg"]
    df = spark.createDataFrame(list(enumerate(odd)), "doc_id bigint, text string")
    for r in pii.detect(df).collect():
        got = [(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["base"]]
        assert got == brute(BASE_PII, odd[r["doc_id"]]), odd[r["doc_id"]][:40]
    for r in secrets.scan(df).collect():
        got = [(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["kind"] in secrets.BASE]
        assert got == brute(BASE_SECRETS, odd[r["doc_id"]])


def test_empty_tables(empty):
    assert secrets.scan(empty).count() == 0
    assert pii.detect(empty).count() == 0
    assert pii.mask(empty).columns == empty.columns


def der(tag, *parts):
    body = b"".join(parts)
    size = bytes([len(body)]) if len(body) < 128 else b"\x82" + len(body).to_bytes(2, "big")
    return bytes([tag]) + size + body


def test_structure_decides():
    number = lambda n: der(2, b"\x01" * n)
    pkcs1 = der(0x30, der(2, b"\x00"), *(number(32) for _ in range(8)))
    pkcs8 = der(0x30, der(2, b"\x00"), der(0x30, der(6, b"\x2a\x03")), der(4, b"k" * 40))
    kinds = lambda text: [k for k, _, _ in secrets.find(text)]
    for key in (pkcs1, pkcs8):
        assert "key_der" in kinds("x " + base64.b64encode(key).decode() + " y")
        assert "key_der" in kinds("x " + key.hex().upper() + " y")
        assert "key_der" not in kinds(base64.b64encode(key[:-1]).decode())  # a nested length is wrong
    pem = "-----BEGIN PRIVATE KEY-----\n" + base64.b64encode(pkcs8).decode() + "\n-----END PRIVATE KEY-----"
    assert "pem" in kinds(pem)
    assert "pem" not in kinds(pem.replace(base64.b64encode(pkcs8).decode(), "AAAA" * 20))
    part = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=")
    assert "jwt" in kinds(f"{part({'alg': 'HS256'})}.{part({'sub': 1})}.abc")
    assert "jwt" not in kinds(f"{part({'typ': 'JWT'})}.{part({'sub': 1})}.abc")
    ssh = secrets.MAGIC + b"".join(len(x).to_bytes(4, "big") + x for x in (b"none", b"none", b"")) + b"\0\0\0\1" + b"\0\0\0\4abcd" + b"\0\0\0\x14" + b"k" * 20
    assert "key_ssh" in kinds(base64.b64encode(ssh).decode())
    assert secrets.find("A" * 200_000) == []


def test_labelers_decide_on_loose_spans(spark):
    rows = [(k, f"call tel ({200 + k}) 555-{1000 + k} today") for k in range(40)] + [(100 + k, f"order version {100 + k}-111-{2000 + k}") for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    hits = {r["doc_id"] for r in pii.detect(df).collect() if any(s["kind"] == "local_phone" for s in r["spans"])}
    assert len([k for k in hits if k < 100]) >= 36 and not [k for k in hits if k >= 100]


def test_expectation_maximisation_ranks_labelers():
    counts = {(0, 1, 1, 1): 50.0, (0, -1, -1, -1): 50.0, (0, 1, 1, -1): 10.0, (0, -1, -1, 1): 10.0}
    post = pii.expectation_maximisation(counts)
    assert post[0, 1, 1, 1] > 0.95 and post[0, -1, -1, -1] < 0.05
    assert post[0, 1, 1, -1] > 0.5 > post[0, -1, -1, 1]


def test_masking_keeps_the_rest(spark, docs):
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    out = pii.mask(docs, length_col="n_chars")
    assert out.columns == docs.columns
    for r in out.collect():
        spans = brute(BASE_PII, before[r["doc_id"]]) if r["doc_id"] is not None else []
        if not spans:
            assert r["doc_id"] is None or r["text"] == before[r["doc_id"]]
        else:
            text, at, want = before[r["doc_id"]], 0, ""
            for kind, a, b in spans:
                if a >= at:
                    want += text[at:a] + f"[{kind.upper()}]"
                at = max(at, b)
            assert r["text"] == want + text[at:] and r["n_chars"] == len(r["text"])


def test_keys_of_other_forms():
    """Escaped line ends, encrypted and DSA keys; what stops short is no key."""
    der = lambda tag, body: bytes([tag, 0x82]) + len(body).to_bytes(2, "big") + body
    number = lambda n: der(0x02, bytes([n]) * 40)
    dsa = der(0x30, b"\x02\x01\x00" + b"".join(map(number, range(1, 6))))
    scheme = der(0x30, b"\x06\x09" + bytes.fromhex("2a864886f70d01050d") + der(0x30, b""))
    encrypted, digest = der(0x30, scheme + der(0x04, b"e" * 90)), der(0x30, der(0x30, b"\x06\x09" + bytes.fromhex("608648016503040201")) + der(0x04, b"d" * 32))
    ssh = secrets.MAGIC + b"".join(len(x).to_bytes(4, "big") + x for x in (b"none", b"none", b"")) + b"\0\0\0\1" + b"\0\0\0\4abcd"
    assert secrets.is_der_key(dsa) and secrets.is_der_key(encrypted) and not secrets.is_der_key(digest) and not secrets.is_der_key(dsa[:-1])
    assert secrets.is_ssh_key(ssh + b"\0\0\0\5krypt") and not secrets.is_ssh_key(ssh) and not secrets.is_ssh_key(ssh + b"\0\0\0\5kry") and not secrets.is_ssh_key(ssh + b"\0\0\0\5krypt!")
    body = base64.b64encode(dsa).decode()
    for end in ("\n", "\\n", "\\\\n", "\r\n"):
        text = "-----BEGIN DSA PRIVATE KEY-----" + end + end.join(body[k : k + 64] for k in range(0, len(body), 64)) + end + "-----END DSA PRIVATE KEY-----"
        assert [x for x in secrets.find(text) if x[0] == "pem"] == [("pem", 0, len(text))], end
