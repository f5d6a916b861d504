import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from parcelweave.llm import pii, secrets


def luhn(s):
    return sum((lambda v: v - 9 if v > 9 else v)(int(c) * (2 if i % 2 else 1)) for i, c in enumerate(s[::-1])) % 10 == 0


def base_pii(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    cards = ((m, re.sub("[ -]", "", m[0])) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t))
    out += [("card", *m.span()) for m, d in cards if 16 <= len(d) <= 19 and luhn(d)]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def base_secrets(t):
    out = [("assign", *m.span()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A) if len(m[2]) >= 12]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    return sorted(out, key=lambda s: (s[1], secrets.BASE.index(s[0])))


PII_TEXT = st.text(st.sampled_from("ab.@+-()0123456789 é%_:/"), max_size=60)
PARTS = ["password", "Token", "api_key", "SECRET", "=", ":", " ", '"', "AKIA", "ABCDEF0123456789", "0123456789abcdef", "x", "é", "ſecret", "\n", "aB3/+xYz09"]


@settings(max_examples=400, deadline=None)
@given(PII_TEXT)
def test_pii_base(t):
    assert [s for s in sorted(pii.spans_of(t), key=pii.order) if s[0] in pii.BASE] == base_pii(t)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=14).map("".join))
def test_secret_base(t):
    assert [s for s in sorted(secrets.Finder()(t), key=secrets.order) if s[0] in secrets.BASE] == base_secrets(t)


def test_added_kinds():
    text = "IBAN DE89 3704 0044 0532 0130 00 now, ssn 123-45-6789, account no: 12345678, http://bob:pw@host.example/x and https://10.0.0.1:80/"
    found = {(k, text[a:b]) for k, a, b in pii.spans_of(text)}
    assert {("iban", "DE89 3704 0044 0532 0130 00"), ("ssn", "123-45-6789"), ("account", "12345678"), ("login", "http://bob:pw@host.example"), ("login", "https://10.0.0.1:80")} <= found
    assert {k for k, _, _ in pii.spans_of("The number of an account is 7, and the iban is secret.")} == set()
    text = "Social Security 123-45-6789; SSN Number: 987-65-4321. Customer ID: 12345678, Https://10.0.0.1, Iban no de89370400440532013000 and x. İİ CUSTOMER id: 87654321"
    found = [(k, text[a:b]) for k, a, b in sorted(pii.spans_of(text), key=pii.order) if k not in pii.BASE]
    assert found == [("login", "Https://10.0.0.1"), ("iban", "de89370400440532013000"), ("ssn", "123-45-6789"), ("ssn", "987-65-4321"), ("account", "12345678"), ("account", "87654321")]
    assert pii.spans_of("classn 123-45-6789") == [] and {k for k, *_ in pii.spans_of("iban DE89 3704 0044 0532 0130 01")} <= set(pii.BASE)
    text = 'passphrase: "xK9#mQ2$vL7!" and password = changeme and pwd=qwertyuiop'
    assert [(k, text[a:b]) for k, a, b in secrets.Finder()(text)] == [("credential", "xK9#mQ2$vL7!")]


def test_guesses():
    g = secrets.Guesser()
    easy = [g.log10(x) for x in ("password", "Password1", "qwertyuiop", "aaaaaaaaaaaa", "20240115", "abcabcabc", "drowssap", "p4ssw0rd")]
    assert max(easy) < 7 and min(g.log10(x) for x in ("xK9#mQ2$vL", "f3ef4d6b2755a36d")) > 9
    assert g.log10("") == 0 and g.log10("a" * 50_000) < 8
    assert g.log10("passwordqwerty") <= g.log10("password") + g.log10("qwerty") + 0.31


def test_tables(docs, prose):
    texts = [None, "", "é me@x.example 4111 1111 1111 1111", prose(1, 100_000) + " token=abcdefghijkl me@x.example", "x"]
    for op, finder, order, base in ((pii.scan, pii.spans_of, pii.order, pii.BASE), (secrets.scan, secrets.Finder(dictionary=secrets.ranked_words()), secrets.order, secrets.BASE)):
        rows = {r.doc_id: r for r in op(docs(*texts)).collect()}
        for i, t in enumerate(texts):
            spans = sorted(finder(t or ""), key=order)
            own = ",".join(f"{k}:{a}:{b}" for k, a, b in spans if k in base)
            assert rows[i].base_sha256 == hashlib.sha256(own.encode()).hexdigest()
            assert rows[i].spans == ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert op(docs()).count() == 0 and op(docs("a", ids=[None])).count() == 1
    clean = pii.masked(docs(*texts))
    assert clean.columns == docs().columns and clean.where("doc_id = 2").first().text == "é [email] [card]"
    assert "[assign]" in secrets.masked(docs(*texts)).where("doc_id = 3").first().text
