import random
import re
import time

from tests.llm.data import awkward, empty
from tillroll.llm import secrets

ASSIGN = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def plain(text):
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    return found + [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]


def test_strong_patterns_against_plain_ones():
    rng = random.Random(3)
    bits = ["password", "PassWD", "secret", "toKen", "token", "api_key", "APIKEY", "ſecret", ": ", " = ", '"', "'", "=", "short", "AKIA", "AKIA" * 4, "0a" * 16, "ABCDEFGH1234", "\n", " ", "é", "longenough_value", "token=token=abc", "deadbeef"]
    for _ in range(4000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(1, 12)))
        assert sorted(secrets.strong(text)) == sorted(plain(text)), text


def test_a_short_value_uses_up_its_text():
    assert list(secrets.strong("password: token: abcdefghij")) == []


def test_weak_parts_need_complementary_parts():
    url, key = "https://store.example.com/bucket", "abcdefGHIJKL1234567890mnopQRST"
    kinds = lambda t: [k for k, _, _ in secrets.spans(t)]
    assert kinds(f"see {url} for more") == []
    assert kinds(f"a string {key} alone") == []
    assert kinds(f"at {url} with {key}") == ["endpoint", "key"]
    assert kinds(f"at {url}\n\nother paragraph {key}") == []
    assert kinds(f"at {url} {'word ' * 100} {key}") == []
    assert kinds(f"AKIA{'B' * 16} on {url}") == ["access", "endpoint"]
    assert kinds(f"client_id=robot77 {key}") == ["id", "key"]


def test_parts_are_linked_over_the_whole_paragraph(spark):
    key, far = "abcdefGHIJKL1234567890mnopQRST", "word " * 2000
    docs = awkward(spark, [f"client_id=robot77 {far}{key}", f"client_id=robot77\n\n{far}{key}"])
    rows = {r.doc_id: [s.kind for s in r.spans] for r in secrets.find_secrets(docs, ["doc_id"]).collect()}
    assert rows[100] == ["id", "key"] and rows[101] == []
    done = {r.doc_id: r.text for r in secrets.redact_documents(docs).collect()}
    assert key not in done[100] and key in done[101]


def test_a_strong_part_inside_a_weak_one_is_its_partner():
    kinds = lambda t: [k for k, _, _ in secrets.spans(t, None)]
    assert secrets.spans("get https://api.example.com/v1?token=abcdefgh12345") == [("endpoint", 4, 50), ("assign", 31, 50)]
    assert secrets.redact("get https://api.example.com/v1?token=abcdefgh12345 now") == "get [secret] now"
    assert kinds(f"AKIA{'B' * 16}/wJalrXUtnFEMIK7MDENGbPxRfiCY") == ["access", "key"]
    assert kinds("secret=abcdefGHIJKL1234567890mnopQRST") == ["assign"]  # one part, not two


def test_redaction():
    text = 'é token = "0123456789abcdef0123456789abcdef" end'
    assert secrets.redact(text) == 'é [secret]" end' and secrets.spans(secrets.redact(text)) == []
    assert secrets.redact("nothing here") == "nothing here"


def test_awkward_rows(spark):
    docs = awkward(spark, ["é password=12345678"])
    rows = {r.doc_id: r.spans for r in secrets.find_secrets(docs, ["doc_id"]).collect()}
    assert [tuple(s) for s in rows[100]] == [("assign", 2, 19)] and rows[1] == rows[2] == []
    done = secrets.redact_documents(docs)
    assert done.columns == docs.columns and done.count() == docs.count()
    assert done.filter("doc_id = 100").first().text == "é [secret]" and done.filter("doc_id = 100").first().n_chars == 10
    assert done.filter("doc_id = 1").first().text is None
    assert secrets.find_secrets(empty(spark), ["doc_id"]).count() == secrets.redact_documents(empty(spark)).count() == 0


def test_weak_parts_against_comparing_all_pairs():
    rng = random.Random(6)
    key = "abcdefGHIJKL1234567890mnopQRST"
    bits = ["ftp://h.example/x", "9svn+ssh://u@h", "client_id=robot77", "ASIA" + "B" * 14, key, "db.eu.amazonaws.com", "token=abcdefgh123", "0a" * 16, "AKIA" + "C" * 16, "\n\n", " ", " ", " word ", "é", "-"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(1, 12)))
        found = list(secrets.strong(text))
        role = lambda s: secrets.ROLES[s[0]]
        weak = [s for s in secrets.weak_spans(text) if not any(role(s) == role(f) and f[1] < s[2] and s[1] < f[2] for f in found)]
        breaks = [m.span() for m in re.finditer(r"\n\s*\n", text)]
        scope = lambda at: sum(b <= at for _, b in breaks)
        edges = list(zip([0, *(b for _, b in breaks)], [*(a for a, _ in breaks), len(text)]))
        expected = []
        for w in weak:
            low, high = next(e for e in edges if w[1] < e[1] or e is edges[-1])
            if any(role(o) != role(w) and o[1] <= high and o[2] >= low for o in found + weak):
                expected.append(w)
        assert sorted(secrets.linked(text, found)) == sorted(expected), text


def test_addresses_begin_with_the_first_letter_of_their_scheme():
    found = lambda t: [t[a:b] for kind, a, b in secrets.weak_spans(t) if kind == "endpoint"]
    assert found("x http://a.b 9ftp://c '.+s3+x://d' éhttps://e ://f 1://g") == ["http://a.b", "ftp://c", "s3+x://d", "https://e"]
    assert found("at db.eu.amazonaws.com, 2.blob.windows.net; windows.net") == ["db.eu.amazonaws.com", "2.blob.windows.net"]


def test_time_of_unbroken_runs():
    rng = random.Random(7)
    for letters in ("abcdefghijklmnopqrstuvwxyz", "0123456789abcdef", "ACGT", "a.-+1", "Aa1+/", "一二三四"):
        run = "".join(rng.choices(letters, k=1_000_000))
        begin = time.monotonic()
        secrets.spans(f"see http://a.example {run} token=abcdefgh1 {run}", None)
        assert time.monotonic() - begin < 20, letters
    text = "AKIA" + "B" * 16 + " client_id=robot77 http://h/x?token=abcdefgh1" * 20000
    assert len(secrets.spans(text, None)) == 1 + 3 * 20000
