import pytest

from pageloom.functions.text import cut_bytes, decode_attribute
from pageloom.functions.urls import (
    allowlist_host,
    is_valid_url,
    normalize_url,
    resolve_url,
    same_domain,
    url_filename,
    url_host,
)


def evaluate(spark, rows, names, expression):
    schema = ", ".join(f"{n} string" for n in names)
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}")
    return [r[1] for r in sorted(frame.selectExpr("i", f"{expression} AS x").collect())]


NORMALIZE = [
    ("https://example.com/page#fragment", "https://example.com/page"),
    ("https://Example.com/Page/", "https://example.com/Page"),
    ("https://example.com", "https://example.com"),
    ("invalid-url", None),
    ("https://h/a//", "https://h/a/"),
    ("https://h/", "https://h/"),
    ("HTTP://X/y?b=2&a=1#z", "http://x/y?b=2&a=1"),
    ("https://h:443/", "https://h:443/"),
    ("https://User:Pw@Host/a", "https://User:Pw@host/a"),
    ("mailto:a@b", None),
    ("javascript:void(0)", None),
    ("https://h/für,x.", "https://h/f%C3%BCr,x."),
    ("https://h/f%C3%BCr", "https://h/f%C3%BCr"),
    ("https://h/%zz", None),
    ("https://h/a\tb", None),
    ("https://h/a b?c d", "https://h/a%20b?c d"),
    ("https://h/a!b", "https://h/a!b"),
    ("https://h/a!b/", "https://h/a%21b"),
    ("https://h/a?", "https://h/a?"),
    ("https://h/a/?x=1", "https://h/a?x=1"),
    ("https://h:ab/", None),
    ("https://bad host/", None),
    ("https://MÜ.de/", "https://m%C3%BC.de/"),
    ("", None),
    (None, None),
]


def test_normalize(spark):
    got = evaluate(spark, [(u,) for u, _ in NORMALIZE], ["u"], normalize_url("u"))
    assert got == [want for _, want in NORMALIZE]


def test_normalize_twice_changes_nothing(spark):
    urls = [(u,) for u, want in NORMALIZE if want and "//" not in u.split("://", 1)[1]]
    once = evaluate(spark, urls, ["u"], normalize_url("u"))
    assert evaluate(spark, [(u,) for u in once], ["u"], normalize_url("u")) == once


def test_same_domain(spark):
    cases = [
        ("https://example.com/page1", "https://example.com/page2", True),
        ("https://example.com", "https://other.com", False),
        ("http://example.com", "https://example.com", True),
        ("https://h:8080/a", "https://h/a", False),
        ("https://a.h/", "https://h/", False),
        ("https://Go.dev/", "https://go.dev/", False),
        ("https://h/%zz", "https://h/", False),
    ]
    got = evaluate(spark, [c[:2] for c in cases], ["a", "b"], same_domain("a", "b"))
    assert got == [c[2] for c in cases]


def test_resolve(spark):
    cases = [
        ("https://example.com/page1", "/page2", "https://example.com/page2"),
        ("https://example.com/", "page2", "https://example.com/page2"),
        ("https://example.com", "https://other.com/page", "https://other.com/page"),
        ("https://h/dir", "page2", "https://h/page2"),
        ("https://h/dir/", "page2", "https://h/dir/page2"),
        ("https://h/a/b/c?x=1", "../d", "https://h/a/d"),
        ("https://h/a/b/c?x=1", "../../../d/.", "https://h/d/"),
        ("https://h/a/b", "..", "https://h/"),
        ("https://h/a?x=1", "#f", "https://h/a?x=1#f"),
        ("https://h/a?x=1", "?y", "https://h/a?y"),
        ("https://h/a?x=1", "", "https://h/a?x=1"),
        ("https://h/a", "//o/p", "https://o/p"),
        ("https://h/a", "mailto:x", "mailto:x"),
        ("https://h/a", "1:2", None),
        ("https://h", "p q", "https://h/p%20q"),
        ("https://h/a", "/x?q=http://o/../y", "https://h/x?q=http://o/../y"),
    ]
    got = evaluate(spark, [c[:2] for c in cases], ["b", "r"], resolve_url("b", "r"))
    assert got == [c[2] for c in cases]


def test_valid(spark):
    cases = [
        ("https://example.com", True),
        ("http://example.com", True),
        ("HTTPS://example.com", True),
        ("ftp://example.com", False),
        ("not-a-url", False),
        ("", False),
        ("https://h/%zz", False),
    ]
    got = evaluate(spark, [c[:1] for c in cases], ["u"], is_valid_url("u"))
    assert got == [c[1] for c in cases]


def test_host_and_allowlist(spark):
    assert evaluate(spark, [("https://u:p@Go.dev:8080/x",)], ["u"], url_host("u")) == ["Go.dev:8080"]
    entries = [("Go.dev",), ("http://go.dev/x",), ("https://a.b:1",)]
    assert evaluate(spark, entries, ["d"], allowlist_host("d")) == ["go.dev", "go.dev", "a.b:1"]
    exact = evaluate(spark, entries, ["d"], allowlist_host("d", lower=False))
    assert exact == ["Go.dev", "go.dev", "a.b:1"]


@pytest.mark.parametrize("size", [1, 2, 3, 99, 100])
def test_cut_bytes(spark, size):
    texts = ["", "abc", "é" * 80, "aé" * 50, "x" * 99 + "\U0001f600", "漢字" * 40]
    got = evaluate(spark, [(t,) for t in texts], ["t"], cut_bytes("t", size))
    assert got == [t.encode()[:size].decode(errors="ignore") for t in texts]


def test_filename(spark):
    long = "https://h/" + "a" * 150
    cases = [
        ("https://go.dev/ref/spec", "go_dev_ref_spec.md"),
        ("https://go.dev/", "go_dev_index.md"),
        ("https://go.dev", "go_dev_index.md"),
        ("https://go.dev:80/a/b/?q=1", "go_dev_a_b.md"),
        ("https://h/a:b*c%3Fd", "h_a_b_c_d.md"),
        ("https://h/f%C3%BCr+x", "h_für+x.md"),
        ("https://h//", "h.md"),
        ("https://h/%zz", "page_008.md"),
        (long, "h_" + "a" * 100 + ".md"),
    ]
    got = evaluate(spark, [c[:1] for c in cases], ["u"], url_filename("u", "7"))
    assert got == [c[1] for c in cases]


def test_attribute_references(spark):
    cases = [
        ("a&amp;b", "a&b"),
        ("?a=1&copy=2", "?a=1&copy=2"),
        ("&copy;x &copy x", "\xa9x \xa9 x"),
        ("&#65;&#x42;&#x1F600;", "AB\U0001f600"),
        ("&nope;&", "&nope;&"),
        ("&ampx=1", "&ampx=1"),
        ("&#0;&#xD800;&#xFFFFFFFFFFFFFFFFFFFF;&#99999999999999999999;", "\ufffd" * 4),
        ("/x&#146;y&#x80;&#129;&#1;", "/x\u2019y\u20ac\x81\x01"),
    ]
    got = evaluate(spark, [c[:1] for c in cases], ["v"], decode_attribute("v"))
    assert got == [c[1] for c in cases]
