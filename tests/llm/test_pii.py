import hashlib
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quadrille.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    def digits(s):
        return re.sub("[^0-9]", "", s)

    def luhn(d):
        n = [int(c) for c in d][::-1]
        return (sum(n[::2]) + sum(sum(divmod(2 * x, 10)) for x in n[1::2])) % 10 == 0

    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]
    return out


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab@.-+%_ 0123456789()ñ", max_size=60))
def test_base_spans_match_the_patterns(text):
    assert pii.base_spans(text) == plain(text)


def test_base_edges():
    for text in ["a@b.c@d.e", "a@b@c.d", "a@b.c+d@e.f", "1.2.3.4.5.6.7.8", "256.1.1.1 001.2.3.4", "4111 1111-1111 1111", "+1 (017) 555-7713", ""]:
        assert pii.base_spans(text) == plain(text)


@pytest.mark.parametrize(
    ("text", "kind", "hidden"),
    [
        ("write to jane.doe [at] example [dot] com now", "email", "jane.doe [at] example [dot] com"),
        ("write to jane at example dot com now", "email", "jane at example dot com"),
        ("write to jane(at)example.com now", "email", "jane(at)example.com"),
        ("mail ｊａｎｅ＠ｅｘａｍｐｌｅ．ｃｏｍ ok", "email", "ｊａｎｅ＠ｅｘａｍｐｌｅ．ｃｏｍ"),
        ("mail jane@exаmple.com ok", "email", "jane@exаmple.com"),
        ("host one nine two dot one six eight dot zero dot one up", "ip", "one nine two dot one six eight dot zero dot one"),
        ("host 10[.]0[.]0[.]1 up", "ip", "10[.]0[.]0[.]1"),
        ("call plus one five five five zero one two three four five six now", "phone", "plus one five five five zero one two three four five six"),
        ("call +１ ２３４ ５６７ ８９０１ now", "phone", "+１ ２３４ ５６７ ８９０１"),
        ("pay four one one one one one one one one one one one one one one one ok", "card", "four one one one one one one one one one one one one one one one"),
        ("host 192 dot 168 dot one dot one up", "ip", "192 dot 168 dot one dot one"),
        ("host 192.168.zero.one up", "ip", "192.168.zero.one"),
        ("host 192.168.one.one up", "ip", "192.168.one.one"),
        ("call +49 30 1234 five six now", "phone", "+49 30 1234 five six"),
        ("pay 4111 1111 1111 111 one ok", "card", "4111 1111 1111 111 one"),
        ("pay four one one one - one one one one - one one one one -\none one one one ok", "card", "four one one one - one one one one - one one one one -\none one one one"),
        ("write to jane at example.com now", "email", "jane at example.com"),
        ("write to jane arroba example punto com now", "email", "jane arroba example punto com"),
        ("write to jane at example punkt de now", "email", "jane at example punkt de"),
        ("write to jane at five dot com now", "email", "jane at five dot com"),
        ("pay 4111​1111​1111​1111 ok", "card", "4111​1111​1111​1111"),
    ],
)
def test_disguises_map_back(text, kind, hidden):
    start = text.index(hidden)
    base, extra = pii.find_pii(text)
    assert (kind, start, start + len(hidden)) in extra + base
    assert hidden not in pii.redact(text)


def test_clean_prose_has_no_spans():
    for text in ["Meet me at the dot on the map at noon.", "One two three, go.", "le point est un deux", "été à la dot com boom", "· bullet – dash", "Visit us at example.com.", "Un, deux, trois et quatre.", "From one point to the next point de vue", "It was hosted at example.org/x or one.two"]:
        assert pii.find_pii(text) == ([], [])


def test_many_addresses_take_linear_time():
    text = " ".join(f"u{i}@ex.com j{i} [at] ex [dot] com" for i in range(20_000))
    start = time.monotonic()
    base, extra = pii.find_pii(text)
    assert len(base) == len(extra) == 20_000 and time.monotonic() - start < 20


def test_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "a@b.com", "x"), (3, "a@b.com", "x"), (None, "9.9.9.9", None), (5, "z" * 100_000 + " a@b.com", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = sorted(map(tuple, pii.pii_spans(docs).collect()), key=str)
    assert len(got) == 6
    empty = hashlib.sha256(b"").hexdigest()
    assert [r for r in got if r[0] in (1, 2)] == [(1, 0, 0, 0, 0, empty, "", 0), (2, 0, 0, 0, 0, empty, "", 0)]
    assert [r[6] for r in got if r[0] == 5] == ["email:100001:100008"]
    assert pii.pii_spans(docs.limit(0)).count() == 0


def test_query_matches_the_patterns(spark, sf_dir):
    got = {r.doc_id: r for r in pii.op2_pii(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        base = plain(d.text or "")
        assert got[d.doc_id].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert got[d.doc_id].n_email == sum(x[0] == "email" for x in base)
