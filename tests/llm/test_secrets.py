import base64
import json
import random
import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from fieldstream.llm.secrets import KINDS, der_items, is_ssh_key, scan, secrets


def der(tag, body):
    n = len(body)
    head = bytes([n]) if n < 128 else bytes([0x82]) + n.to_bytes(2, "big")
    return bytes([tag]) + head + body


KEY = der(0x30, der(2, b"\0") + b"".join(der(2, bytes([k + 1]) * 60) for k in range(8)))
SSH = b"".join(len(x).to_bytes(4, "big") + x for x in (b"ssh-ed25519", b"k" * 32))


def token():
    part = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).rstrip(b"=").decode()
    return ".".join([part({"alg": "HS256", "typ": "JWT"}), part({"sub": "12"}), "c2lnbmF0dXJlLXNpZ25hdHVyZQ"])


def kinds(text):
    base, more = scan(text)
    return [KINDS[k] for _, k, _ in base], [KINDS[k] for _, k, _ in more]


def test_base_patterns():
    assert kinds('Password : "abc123" x') == (["assign"], [])
    assert kinds("secret: token = abcdefgh") == ([], [])  # the failing match takes "token" with it
    assert kinds("api_key=abcdef apikey='x.y-z=1'") == (["assign", "assign"], [])
    assert kinds("ſecret=abcdefg toKen=abcdefg") == ([], [])
    assert kinds("AKIA" + "A1" * 8 + " AKIASHORT") == (["access"], [])
    assert kinds("x" + "0a" * 12 + " " + "0a" * 11) == (["hex"], [])


def test_structure():
    assert der_items(KEY) == 10 and not der_items(KEY[:-1])
    assert is_ssh_key(SSH) and not is_ssh_key(SSH[:-1])
    for blob, kind in ((KEY, "der"), (SSH, "ssh")):
        assert kinds("see " + base64.b64encode(blob).decode()) == ([], [kind])
        assert kinds("see " + blob.hex())[1] == [kind]
    assert kinds("see " + base64.b64encode(bytes(range(90))).decode()) == ([], [])
    assert kinds(f"auth {token()} end") == ([], ["jwt"])
    assert kinds("a" * 12 + "." + "b" * 12 + "." + "c" * 12) == ([], [])
    assert kinds("eyJ" + "z" * 200_000) == ([], [])
    pem = "-----BEGIN RSA PRIVATE KEY-----\n" + base64.encodebytes(KEY).decode() + "-----END RSA PRIVATE KEY-----"
    assert "pem" in kinds(pem)[1]


def pem(label, data, wrap="\n", head=""):
    return f"-----BEGIN {label}-----{wrap}{head}{base64.encodebytes(data).decode().replace(chr(10), wrap)}-----END {label}-----"


def test_pem_is_parsed_before_it_is_reported():
    string = lambda x: len(x).to_bytes(4, "big") + x
    openssh = b"openssh-key-v1\0" + string(b"none") * 2 + string(b"") + (1).to_bytes(4, "big") + string(SSH) + string(b"p" * 64)
    assert kinds(pem("OPENSSH PRIVATE KEY", openssh))[1] == ["pem"] and kinds(pem("OPENSSH PRIVATE KEY", openssh[:-9]))[1] == []
    assert kinds(pem("OPENSSH PRIVATE KEY", b"openssh-key-v1\0" + bytes(range(200))))[1] == []
    assert kinds(pem("ENCRYPTED PRIVATE KEY", KEY))[1] == ["pem"] and kinds(pem("ENCRYPTED PRIVATE KEY", bytes(range(200))))[1] == []
    assert kinds("key = '" + pem("RSA PRIVATE KEY", KEY, "\\n") + "'")[1] == ["pem"]
    locked = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC," + "0A" * 16 + "\n\n"
    assert kinds(pem("RSA PRIVATE KEY", bytes(range(192)), head=locked))[1] == ["pem"]
    assert kinds(pem("RSA PRIVATE KEY", bytes(range(191)), head=locked))[1] == [] == kinds(pem("RSA PRIVATE KEY", bytes(range(192)), head="Proc-Type: 4,CLEAR\n"))[1]


def test_more_candidates():
    assert kinds("key " + SSH.hex().upper() + " x") == ([], ["ssh"])
    wrapped = base64.encodebytes(KEY).decode()
    assert kinds("see\n" + wrapped + "more words\n")[1] == ["der"] and kinds("  " + wrapped.replace("\n", "\r\n  "))[1] == ["der"]
    assert kinds("see\n" + base64.encodebytes(bytes(range(200))).decode())[1] == []
    spaced = ".".join([base64.urlsafe_b64encode(b' { "alg" : "ES256" }').decode().rstrip("="), base64.urlsafe_b64encode(b'{"a":1}').decode().rstrip("="), "c2lnbmF0dXJl"])
    for before in ("", "www-example-com.", "a.b.", ".."):
        assert kinds(f"go {before}{spaced} end") == ([], ["jwt"]), before
        start = 3 + len(before)
        assert scan(f"go {before}{spaced} end")[1] == [(start, 4, start + len(spaced))]
    for odd in ("a." * 100_000, "A" * 300_000, ("B" * 64 + "\n") * 4000, "-----BEGIN RSA PRIVATE KEY-----" * 2000, "x-" * 100_000, "0f" * 200_000, "token=" * 20_000):
        scan(odd)


def test_keys_in_paths_and_encoded_twice():
    b64 = lambda x: base64.b64encode(x).decode()
    for blob, kind in ((KEY, "der"), (SSH, "ssh")):
        for before in ("https://x/", "/a/b_c-d/", "https://host.example/path/to/", "//"):
            text = f"see {before}{b64(blob)} end"
            at = text.index(b64(blob))
            assert scan(text)[1] == [(at, KINDS.index(kind), at + len(b64(blob)))], before
        assert scan(f"see x/{b64(blob[:-1])} end")[1] == []
    whole = pem("RSA PRIVATE KEY", KEY)
    assert kinds("secret " + b64(whole.encode()))[1] == ["pem"]
    assert kinds("data:\n" + base64.encodebytes(whole.encode()).decode())[1] == ["pem"]
    assert kinds("secret " + b64(pem("RSA PRIVATE KEY", bytes(range(200))).encode()))[1] == [] == kinds("x " + b64(b"-----BEGIN of a plain text that is long enough"))[1]
    began = time.perf_counter()
    for odd in ("/MIIB" * 60_000, "/AAAAB3NzaC1yc2E" * 20_000, "AAAA/" * 60_000, "/" * 300_000, "/LS0tLS1CRUdJTi" * 20_000):
        scan(odd)
    assert time.perf_counter() - began < 20


def test_recall_of_planted_keys():
    """300 keys in ten forms among as many decoys of the same forms: every key is reported, and no decoy."""
    rng, b64 = random.Random(4), lambda x: base64.b64encode(x).decode()
    forms = [
        ("der", b64), ("der", lambda k: base64.urlsafe_b64encode(k).decode().rstrip("=")), ("der", lambda k: k.hex()), ("der", lambda k: k.hex().upper()), ("der", lambda k: "\n" + base64.encodebytes(k).decode()), ("pem", lambda k: pem("PRIVATE KEY", k)),
        ("pem", lambda k: pem("RSA PRIVATE KEY", k, "\\n")), ("pem", lambda k: b64(pem("PRIVATE KEY", k).encode())), ("der", lambda k: "https://keys.example/v1/" + b64(k)), ("der", lambda k: "key=" + b64(k)),
    ]
    found = wrong = 0
    for _ in range(30):
        key = der(0x30, der(2, b"\0") + b"".join(der(2, bytes([rng.randrange(1, 127)]) + rng.randbytes(rng.randrange(40, 70))) for _ in range(8)))
        noise = bytes([0x31]) + rng.randbytes(len(key) - 1)
        for kind, form in forms:
            found += kind in kinds(f"Some words, {form(key)} and more words.")[1]
            wrong += bool(kinds(f"Some words, {form(noise)} and more words.")[1])
    assert (found, wrong) == (300, 0)


PLAIN = (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]+"))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["password", "PassWD", "api_key", "apikey", "token", "secret", '"', "'", " ", ":", "=", "abc", "123456", "AKIA", "Z" * 16, "0f" * 11, "0", "é", "-", "\n"]), max_size=40))
def test_base_equals_plain_patterns(parts):
    text = "".join(parts)
    want = [(m.start(), 0, m.end()) for m in PLAIN[0].finditer(text) if len(m[2]) >= 6]
    want += [(m.start(), 1, m.end()) for m in PLAIN[1].finditer(text) if len(m[0]) >= 20]
    want += [(m.start(), 2, m.end()) for m in PLAIN[2].finditer(text) if len(m[0]) >= 24]
    assert scan(text)[0] == sorted(want)


def test_rows(spark):
    df = spark.createDataFrame([(1, "é token=abcdef", 1), (2, None, 1), (3, "", 1), (1, "é token=abcdef", 1), (None, "a" * 200_000, 2)], "doc_id long, text string, found int")
    got = sorted(((r.doc_id, [tuple(x) for x in r.found]) for r in secrets(df).collect()), key=str)
    assert got == sorted([(1, [(2, 14, "assign", True)])] * 2 + [(2, []), (3, []), (None, [(0, 200_000, "hex", True)])], key=str)
    assert secrets(df.limit(0)).count() == 0
