"""Pseudonyms against a plain Feistel network, in all formats, and on texts made to hold up the matcher."""

import datetime as dt
import hashlib
import random
import time

import pytest
from pyspark.sql import functions as F

from loadcast.llm import pii

KEY = "k"
LINE = "from {}, and so on"


def feistel(values, limits, kind, beside=None):
    n, h = len(values), (len(values) + 1) // 2
    a, b, la, lb = values[:h], values[h:], limits[:h], limits[h:]
    for r in range(1, pii.ROUNDS + 1):
        parts = [KEY, kind, str(n), str(r), ",".join(map(str, b))] + ([beside] if beside is not None else [])
        digest = hashlib.sha256("|".join(parts).encode()).hexdigest()
        moved = [(v + int(digest[i % 16 * 4 : i % 16 * 4 + 4], 16)) % m for i, (v, m) in enumerate(zip(a, la))]
        a, b, la, lb = b, moved, lb, la
    return a + b


def luhn(digits):
    doubled = [d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed(digits))]
    return sum(doubled) % 10


def refill(text, digits):
    it = iter(digits)
    return "".join(str(next(it)) if c.isdigit() else c for c in text)


def plain_card(m):
    digits = [int(c) for c in m if c.isdigit()]
    body = feistel(digits[:-1], [10] * (len(digits) - 1), "card")
    return refill(m, [*body, -luhn([*body, 0]) % 10])


def plain_phone(m):
    digits = [int(c) for c in m if c.isdigit()]
    national = digits[-10:]
    least = [2 if i in (0, 3) and d >= 2 else 0 for i, d in enumerate(national)]
    limits = [10 if i not in (0, 3) else 8 if d >= 2 else 2 for i, d in enumerate(national)]
    new = feistel([d - low for d, low in zip(national, least)], limits, "phone")
    return refill(m, digits[:-10] + [d + low for d, low in zip(new, least)])


def plain_abroad(m):
    text = "".join(c for c in m if c.isdigit())
    n = 1 if text[0] == "7" else 2 if text[:2] in pii.TWO_DIGIT_CODES else 3
    return refill(m, [*map(int, text[:n]), *feistel([*map(int, text[n:])], [10] * (len(text) - n), "abroad", text[:n])])


def plain_ssn(m):
    a, g, s = map(int, m.split("-"))
    x = feistel([a - 2 if a > 666 else a - 1, g - 1, s - 1], [898, 99, 9999], "ssn")
    return f"{x[0] + 2 if x[0] >= 665 else x[0] + 1:03d}-{x[1] + 1:02d}-{x[2] + 1:04d}"


def plain_ipv4(m):
    return ".".join(map(str, feistel([*map(int, m.split("."))], [256] * 4, "ipv4")))


def plain_ipv6(m):
    new = feistel([int(p, 16) for p in m.split(":")], [65536] * 8, "ipv6")
    return ":".join(f"{x:04x}" if len(m) == 39 else f"{x:x}" for x in new)


def mod97(chars):
    return int("".join(str(int(c, 36)) for c in chars)) % 97


def plain_iban(m):
    chars = m.replace(" ", "")
    body = chars[4:]
    base = [ord("0") if c.isdigit() else ord("A") for c in body]
    new = feistel([ord(c) - b for c, b in zip(body, base)], [10 if c.isdigit() else 26 for c in body], "iban", chars[:2])
    text = "".join(chr(b + v) for b, v in zip(base, new))
    it = iter(f"{chars[:2]}{98 - mod97(text + chars[:2] + '00'):02d}{text}")
    return "".join(c if c == " " else next(it) for c in m)


def plain_mail(m):
    local, domain = m.split("@")
    base = [97 if "a" <= c <= "z" else 65 if "A" <= c <= "Z" else 48 if "0" <= c <= "9" else 0 for c in local]
    limits = [1 if not b else 10 if b == 48 else 26 for b in base]
    new = feistel([ord(c) - b if b else 0 for c, b in zip(local, base)], limits, "mail", domain.lower())
    return "".join(chr(b + v) if b else c for c, b, v in zip(local, base, new)) + "@" + domain


def plain_day(day):
    month = (day.year - 1900) * 12 + day.month - 1
    era = month // 4800 * 4800
    start = lambda n: dt.date(1900 + n // 12, n % 12 + 1, 1)
    before = lambda n: (start(n) - start(era)).days - 12 * (n - era)
    if day.day <= 12:
        rank = (month - era) * 12 + day.day - 1
        x = feistel([rank // 240, rank % 240], [240, 240], "date")
        rank = x[0] * 240 + x[1]
        return start(era + rank // 12) + dt.timedelta(days=rank % 12)
    rank = before(month) + day.day - 13
    x = feistel([rank // 9833, rank % 9833], [9, 9833], "late date")
    rank = x[0] * 9833 + x[1]
    n = max(n for n in range(era, era + 4800) if before(n) <= rank)
    return start(n) + dt.timedelta(days=rank - before(n) + 12)


def iban(country, body):
    return f"{country}{98 - mod97(body + country + '00'):02d}{body}"


def values():
    rng = random.Random(1)
    card = lambda n: "".join(map(str, [*n, -luhn([*n, 0]) % 10]))
    number = lambda n: [rng.randrange(1, 10) for _ in range(n)]
    spaced = lambda s: " ".join(s[i : i + 4] for i in range(0, len(s), 4))
    cards = [card(number(15)) for _ in range(6)]
    ibans = [iban("DE", "".join(map(str, number(18)))) for _ in range(3)] + [iban("GB", "WEST" + "".join(map(str, number(14)))), iban("NO", "".join(map(str, number(11))))]
    return {
        plain_card: cards[:3] + [spaced(c) for c in cards[3:]] + [card(number(12)), card(number(18))],
        plain_phone: ["+1 (212) 555-7713", "(017) 155-7713", "212-555-1234", "1-800-555-0000", "415.555.0133"],
        plain_abroad: ["+44 20 7946 0958", "+442079460958", "+49 30 901820", "+7 495 123-45-67", "+353 1 234 5678"],
        plain_ssn: ["123-45-6789", "665-01-0001", "667-99-9999", "899-10-1000"],
        plain_ipv4: ["10.0.0.1", "192.168.255.3"],
        plain_ipv6: ["2001:db8:0:0:8:800:200c:417a", "2001:0db8:0000:0000:0008:0800:200c:417a"],
        plain_iban: ibans + [spaced(i) for i in ibans],
        plain_mail: ["ab.C9@x.org", "J.O'Neil@mail.example.com", "josé@x.org", "q@b.co", "a" * 64 + "@x.org", "x+y_z@a-b.info"],
    }


def test_every_format_is_a_plain_feistel_network(spark):
    rows = [(i, v, LINE.format(v)) for i, (_, vs) in enumerate(values().items()) for v in vs]
    plain = list(values())
    out = pii.pseudonymise(spark.createDataFrame(rows, "i int, v string, text string"), KEY, found_col="n").collect()
    wrong = [(r.v, r.text, plain[r.i](r.v)) for r in out if r.text != LINE.format(plain[r.i](r.v)) or r.n != 1]
    assert not wrong
    assert all(plain[r.i](r.v) != r.v for r in out)


def written(d):
    early = d.day <= 12
    forms = [f"{d:%Y-%m-%d}", f"{d:%d/%m/%Y}", f"{d:%d.%m.%Y}", f"{d:%d-%m-%Y}", f"{d:%b} {d.day}, {d.year}", f"{d.day} {d:%B} {d.year}"]
    if early and d.month < 10:
        forms.append(f"{d.day}/{d.month}/{d.year}")
    return forms if early else [*forms, f"{d:%m/%d/%Y}", f"{d:%m-%d-%Y}"]


def test_a_day_has_one_pseudonym_in_every_format(spark):
    rng = random.Random(2)
    days = [dt.date(2024, 12, 31), dt.date(2024, 7, 5), dt.date(1899, 12, 31), dt.date(1500, 1, 1), dt.date(2000, 2, 29)]
    days += [dt.date(1700, 1, 1) + dt.timedelta(days=rng.randrange(200_000)) for _ in range(40)]
    rows = [(str(d), w, LINE.format(w)) for d in days for w in written(d)]
    assert ("2024-12-31", "12/31/2024") in {r[:2] for r in rows}
    for r in pii.pseudonymise(spark.createDataFrame(rows, "day string, w string, text string"), KEY).collect():
        new = plain_day(dt.date.fromisoformat(r.day))
        text = r.text.removeprefix("from ").removesuffix(", and so on")
        padded = r.w[:2].isdigit() and len(r.w) == 10
        plain = written(new) + [f"{new.month}/{new.day}/{new.year}", f"{new.day}/{new.month}/{new.year}"] + [f"{new:%B} {new.day}, {new.year}", f"{new.day} {new:%b} {new.year}"]
        assert text in plain, (r.w, text, new)
        assert not padded or len(text) == 10


def test_days_are_permuted(spark):
    days = spark.range(0, 40_000, 2).select(F.date_add(F.lit("1960-01-01"), F.col("id").cast("int")).alias("d"))
    out = pii.pseudonymise(days.select(F.date_format("d", "yyyy-MM-dd").alias("text"), F.dayofmonth("d").alias("dom")), KEY)
    assert out.agg(F.count_distinct("text")).first()[0] == 20_000
    assert out.where((F.col("dom") > 12) != (F.dayofmonth(F.try_to_date("text", "yyyy-MM-dd")) > 12)).count() == 0


@pytest.mark.parametrize("kind", ["mail", "values"])
def test_texts_made_to_hold_up_the_matcher(spark, kind):
    card = "4845 1681 1440 7329"
    texts = {
        "mail": ["x@" + "a." * 500_000, "a%" * 500_000, "a%@" * 300_000, "a@" * 300_000, "x@" + "a-" * 400_000, "1.1." * 200_000, "a:" * 400_000, "AB12 " * 100_000],
        "values": ["212-555-1234, " * 5000, (card + " ") * 2000, (card + ", ") * 2000, "1234 " * 100_000, "1234-" * 100_000, "1" * 500_000, "12/31/2024; " * 5000],
    }[kind]
    counts = {"mail": [0] * 8, "values": [5000, 2000, 2000, 0, 0, 0, 5000]}[kind]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(4)
    started = time.time()
    out = {r.i: r for r in pii.pseudonymise(df, KEY, found_col="n").collect()}
    assert time.time() - started < 90
    assert [out[i].n for i in range(len(texts))] == counts
    assert all(len(out[i].text) == len(t) for i, t in enumerate(texts))


def test_columns_named_like_helpers_stay(spark):
    df = spark.createDataFrame([("call 212-555-1234", 1, 2, "x")], "text string, _pieces int, kind int, t string")
    out = pii.pseudonymise(df, KEY)
    assert out.columns == df.columns
    r = out.first()
    assert (r["_pieces"], r["kind"], r["t"]) == (1, 2, "x") and r.text == "call " + plain_phone("212-555-1234")
