import hashlib
import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from widestat.llm import pii

from .conftest import by_id

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0


def brute(text):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]
    return out


def base(text):
    return [s for s in pii.scan(text, pii.anchors()) if s[0] in pii.BASE_KINDS]


PIECES = st.sampled_from(["a@b.c", "x.y+z@mail-1.example.com", "@", ".", "+", "-", " ", "1.2.3.4", "256.1.1.1", "5", "0042",
                          "4111 1111 1111 1111", "4111111111111111", "+1 (555) 123-4567", "é", "９", "(", "://", "abc", "%"])


@settings(max_examples=400, deadline=None)
@given(st.lists(PIECES, max_size=14).map("".join))
def test_base_kinds_equal_the_patterns(text):
    assert base(text) == brute(text)


def test_long_runs_are_linear():
    for make in (lambda n: "1" * n, lambda n: "1." * n, lambda n: "a@" * n, lambda n: "+" + "1 " * n, lambda n: "x" * n + "@",
                 lambda n: "9-" * n, lambda n: "0" * n + ".1.1.1"):
        assert base(make(500)) == brute(make(500))
        began = time.process_time()
        base(make(200_000))  # the plain patterns need minutes for some of these
        assert time.process_time() - began < 5


def test_spans_of_the_method():
    auto = pii.anchors()
    text = "see http://u:p@h.org/x and https://e.org/~ann, Account no: AB12 3456, token = \"abc123def\" by @some_one"
    got = {(k, text[s:e]) for k, s, e in pii.scan(text, auto)}
    assert ("url", "http://u:p@h.org/x") in got and ("url", "https://e.org/~ann") in got
    assert ("account", "AB12 3456") in got and ("secret", "abc123def") in got and ("account", "@some_one") in got
    assert pii.scan("https://e.org/plain page, an account of things, the token ring", auto) == []


def test_mask():
    assert pii.mask("me a@b.c ok", pii.scan("me a@b.c ok", pii.anchors())) == "me <email> ok"


def test_query_columns_and_edge_rows(docs):
    rows = [(1, "a@b.co 10.0.0.1 +1 555 123 4567"), (2, None), (3, ""), (4, "x" * 300_000 + " a@b.co"), (None, "a@b.co"),
            (1, "a@b.co 10.0.0.1 +1 555 123 4567")]
    out = pii.digest(pii.find_personal_data(docs(rows).withColumn("spans", F.lit("clash"))))
    assert out.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    got = by_id(out)
    assert out.count() == len(rows)
    r = got[1]
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 1, 0, 1)
    text = ",".join(f"{k}:{s}:{e}" for k, s, e in brute(rows[0][1]))
    assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest() and r.spans == text
    assert got[2].spans == "" and got[2].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[4].n_email == 1 and got[None].n_email == 1


def test_empty_table(docs):
    assert pii.digest(pii.find_personal_data(docs([]))).count() == 0
