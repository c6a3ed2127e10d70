"""Personal data against a plain version over random texts, and what the caller's key decides."""

import hashlib
import hmac
import random

import pytest
import regex

from emberframe.llm import pii

DOCS = "doc_id long, text string, n_entities int, row string"
KEY = "s3cret"


def replaced(spark, texts, key=KEY):
    df = spark.createDataFrame([(i, t, 0, "") for i, t in enumerate(texts)], DOCS)
    return {x.doc_id: x for x in pii.replace(df, key).collect()}


def digits(t):
    return "".join(c for c in t if c in "0123456789")


def luhn_sum(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d)))


def mod97(t):
    return int("".join(str(int(c, 36)) for c in t[4:] + t[:4])) % 97


def kind_of(m):
    for k, p in pii.KINDS:
        if regex.fullmatch(p, m) and (k != "card" or luhn_sum(digits(m)) % 10 == 0) and (k != "iban" or mod97(m.replace(" ", "")) == 1):
            return k
    return None


def pieces(m, kind):
    """(kind, entity, said)"""
    given = {n for v in pii.NAMES.values() for n in v}

    def words(t):
        out = []
        for i, w in enumerate(t.split(" ")):
            none = not w or w in pii.JOINED or (i == 0 and w.removesuffix(".") in pii.BEFORE)
            out.append((None if none else "given" if w in given or regex.fullmatch(r"\p{Lu}\.", w) else "surname", w, (" " if i else "") + w))
        return out

    if kind == "name":
        return words(m)
    if kind == "cued":
        cue = regex.match(f"(?:{pii.CUES[1]}|{pii.CUES[2]})", m)[0]
        return [(None, cue, cue), *words(m[len(cue) :])]
    if kind == "passport":
        before = regex.match(pii._PASSPORT, m)[0]
        return [(None, before, before), ("passport", m[len(before) :], m[len(before) :])]
    entity = {"email": m.lower(), "ipv6": m.lower(), "iban": m.replace(" ", ""), "ssn": digits(m), "card": digits(m), "phone": regex.sub("^0", "", digits(m))[-10:]}.get(kind, m)
    return [(kind, entity, m)]


def surrogate(kind, entity, attempt):
    d = hmac.digest(KEY.encode(), "\x01".join([kind, entity, str(attempt)]).encode(), "sha256").hex()
    byte = lambda i: int(d[i % 31 * 2 : i % 31 * 2 + 2], 16)

    def exchanged(t, sorts=pii._SORTS):
        out = ""
        for i, c in enumerate(t):
            own = next((s for s in sorts if c in s), None)
            if own is not None:
                out += own[byte(i) % len(own)]
            elif regex.match(r"\p{L}", c):
                out += (str.lower if c == c.lower() else str.upper)(pii._LOWER["latin"][byte(i) % 26])
            else:
                out += c
        return out

    if kind == "email":
        return exchanged(entity.split("@")[0]) + "@m" + d[49:57] + ".example.net"
    if kind == "ip":
        return ".".join(str(byte(i) % 254 + 1) for i in range(4))
    if kind == "ipv6":
        return exchanged(entity, pii._HEX)
    if kind == "card":
        most = exchanged(entity)[:-1]
        return most + str(-luhn_sum(most + "0") % 10)
    if kind == "iban":
        core = exchanged(entity[4:])
        return entity[:2] + f"{98 - mod97(entity[:2] + '00' + core):02d}" + core
    if kind == "given":
        said, made = pii._exchanges(KEY)
        return made[said.index(entity)] if entity in said else None
    if kind == "surname":
        script = "cyrillic" if regex.search(r"\p{IsCyrillic}", entity) else "latin"
        first, second, ends = pii._SYLLABLES[script]
        made = "".join(first[byte(2 * i) % len(first)] + second[byte(2 * i + 1) % len(second)] for i in range(attempt + 3)) + ends[byte(30) % len(ends)]
        return made[0].upper() + made[1:] + ("а" if script == "cyrillic" and entity[-1] in "ая" else "")
    return exchanged(entity)


def refilled(said, made):
    own = [i for i, c in enumerate(said) if c in "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"]
    out = list(said)
    for i, c in zip(own[len(own) - len(made) :], made, strict=True):
        out[i] = c
    return "".join(out)


def plain(texts):
    found = {i: [(m.start(), m.end(), kind_of(m[0]), m[0]) for m in regex.finditer(pii.PATTERN, t)] for i, t in enumerate(texts) if t}
    entities = {(k, e): 0 for own in found.values() for *_, kind, m in own if kind for k, e, _ in pieces(m, kind) if k}
    while True:
        made = {x: surrogate(*x, n) for x, n in entities.items()}
        firsts = {}
        for (k, e), s in sorted(made.items()):
            firsts.setdefault((k, s), e)
        again = [x for x, s in made.items() if x[0] != "given" and (firsts[x[0], s] != x[1] or (x[0], s) in entities)]
        if not again:
            break
        for x in again:
            entities[x] += 1
    out = {}
    for i, t in enumerate(texts):
        text, at = "", 0
        for start, end, kind, m in found.get(i, []):
            text += t[at:start]
            for k, e, said in pieces(m, kind) if kind else [(None, m, m)]:
                s = made.get((k, e))
                if s is None:
                    text += said
                elif kind in ("name", "cued"):
                    text += (" " if said[0] == " " else "") + s
                elif k in ("phone", "ssn", "card", "iban"):
                    text += refilled(said, s)
                else:
                    text += s.upper() if k in ("email", "ipv6") and said == said.upper() and regex.search("[A-Z]", said) else s
            at = end
        out[i] = (text + t[at:] if t else t, sum(1 for *_, kind, _ in found.get(i, []) if kind))
    return out


def test_a_plain_version_agrees(spark):
    r = random.Random(8)
    parts = [
        "Emily Smith", "Mr. Okafor", "my name is Okonkwo", "Contact Priya Raghunathan or Wei Zhang", "contact us", "Contact Us Today", "Dear All", "Name: Ana P. Gil", "Dr. John Q. Doe", "Светлана Иванова", "Alice", "Ich heiße Jürgen",
        "a.b@mail.example", "A.B@MAIL.EXAMPLE", "x@y.zz", "10.1.2.3", "2001:db8::1", "Passport X1234567", "passport no. 123456789", "Reisepass: C01X", "07911 123456", "+44 20 7946 0958", "+1 (788) 555-2942", "788-555-2942",
        "123-45-6789", "4845168114407329", "4845 1681 1440 7329", "1234567890123456", "GB82 WEST 1234 5698 7654 32", "DE00370400440532013000", "2024-05-06", "12:30:45", "std::map", "01-02-2003", "order 0123", "v1.2.3.4.5", "and", "the", "Berlin", "\n", "é😀",
    ]
    texts = [" ".join(r.choice(parts) for _ in range(r.randrange(1, 12))) + r.choice(["", ".", ", x"]) for _ in range(250)] + [None, "", "x" * 50_000 + " 10.1.2.3"]
    got, want = replaced(spark, texts), plain(texts)
    for i, t in enumerate(texts):
        assert (got[i].text, got[i].n_entities) == want[i], t


def test_cues_and_national_forms(spark):
    said = "Contact Priya Raghunathan or Wei Zhang. My name is Okonkwo. Passport X1234567, 07911 123456 or +44 20 7946 0958"
    (row,) = replaced(spark, [said]).values()
    for gone in ("Priya", "Raghunathan", "Wei", "Zhang", "Okonkwo", "1234567", "7911", "123456", "7946", "0958"):
        assert gone not in row.text
    assert regex.fullmatch(r"Contact \w+ \w+ or \w+ \w+\. My name is \w+\. Passport [A-Z]\d{7}, 0\d{4} \d{6} or \+44 \d\d \d{4} \d{4}", row.text) and row.n_entities == 5
    clean = ["Contact us for details", "The name is unknown", "Contact Support now", "born 01.02.2003 at 10:20", "version 2.0.1 of 2024-05-06 12:30", "rows 100 200 300"]
    assert [x.text for _, x in sorted(replaced(spark, clean).items())] == clean


def test_the_key_decides(spark):
    names = pii.NAMES["female_latin"]
    texts = [f"{n} Miller, 788-555-2942" for n in names]
    one, two = replaced(spark, texts), replaced(spark, texts, "other")
    first = lambda rows: [rows[i].text.split()[0] for i in range(len(names))]
    assert sorted(first(one)) == sorted(names) and all(a != b for a, b in zip(first(one), names, strict=True)) and first(one) != first(two)
    turned = {(names.index(b) - names.index(a)) % len(names) for a, b in zip(names, first(one), strict=True)}
    assert len(turned) > 10  # not one shift
    assert one[0].text.split()[-1] != two[0].text.split()[-1]
    with pytest.raises(ValueError):
        pii.replace(spark.createDataFrame([], DOCS), "")
    message = pii._coded("k" * 100, pii.F.lit("é")).alias("h")
    assert spark.range(1).select(message).first().h == hmac.digest(b"k" * 100, "é".encode(), "sha256").hex() == hmac.new(b"k" * 100, "é".encode(), hashlib.sha256).hexdigest()
