import hashlib
import random
import re

from metaloom.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")


def plain_luhn(d):
    total = 0
    for i, x in enumerate(reversed(d)):
        v = int(x) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def brute_base(text):
    out = []
    for k, pattern in enumerate((EMAIL, IP, pii.DIGITS, pii.PLUS)):
        for m in pattern.finditer(text):
            d = re.sub("[^0-9]", "", m.group())
            if k == 1 and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if k == 2 and not (14 <= len(d) <= 19 and plain_luhn(d)):
                continue
            if k == 3 and not 10 <= len(d) <= 15:
                continue
            out.append((k, *m.span()))
    return sorted(out, key=lambda x: (x[1], x[0]))


def digested(text):
    return hashlib.sha256(",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in brute_base(text)).encode()).hexdigest()


def noise(rng):
    parts = ["a@b.c", "@", ".", "1.2.3.4", "300.1.1.1", "1.2.3.4.5.6.7.8", "+1 (555) 123-4567", "+", "4111 1111 1111 1111", "4111-1111-1111-1111", "x@y@z.w", "0001.2.3.255", " ", "-", "9", "0", "é@é.com", "a.b%c@d-e.f.g", "+49.30.1234567", "(", ")", "12"]
    return "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))


def test_base_spans_equal_the_patterns():
    rng = random.Random(4)
    for _ in range(4000):
        text = noise(rng)
        assert pii.found_in(text)[0] == brute_base(text), text


def test_digest_and_added_spans(spark):
    texts = [
        "write to a.b@mail.example.com now", None, "", "a card behind an address 38.211.12.41 4111111111111111 here",
        "call +1 (555) 123-4567 or mail bob [at] example [dot] com today", "token = 8b4111111111111111ab", "é" * 10 + " 1.2.3.4", "9" * 20000 + "@" * 50,
    ]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(0, texts[0], "x"), (None, texts[0], "x")]
    got = pii.digest(spark.createDataFrame(rows, "doc_id long, text string, base string")).collect()
    assert len(got) == len(rows)
    for r, (_, text, _) in zip(sorted(got, key=lambda r: (r.doc_id is None, r.doc_id)), sorted(rows, key=lambda r: (r[0] is None, r[0])), strict=True):
        assert r.base_sha256 == digested(text or "")
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == i for k, _, _ in brute_base(text or "")) for i in range(4))
    by = {r.doc_id: r.spans for r in got}
    assert by[3] == "ip:25:37,card:38:54"
    assert by[4].startswith("phone:5:22,email:31:")


def test_redaction(spark):
    rows = [(1, "mail a@b.com, 1.2.3.4", "en", "s", 21), (2, None, "en", "s", None), (3, "nothing here", "en", "s", 12)]
    out = pii.redact(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    assert [tuple(r) for r in out.orderBy("doc_id").collect()] == [(1, "mail [EMAIL], [IP]", "en", "s", 18), (2, None, "en", "s", None), rows[2]]
    assert pii.digest(out.limit(0)).count() == 0
