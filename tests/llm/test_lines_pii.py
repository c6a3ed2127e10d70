import random
import re

from emberframe.llm import lines, pii

DOCS = "doc_id long, text string, n_chars long, row string"


def test_lines_against_sql(spark):
    import duckdb
    import pandas as pd

    r = random.Random(6)
    pool = ["Licensed under the Apache License 2.0", "Licensed under the Apache License 3.1", "the cat sat on a mat today", "short line", "", "  padded line of five tokens ", "error at host a42 of rack b7 now", "error at host c9 of rack zz now", "error at host d1 of rack qq now"]
    vocab = [f"v{chr(97 + i)}" for i in range(26)]
    docs = [(0, None), (1, ""), (2, "\n\n")]
    for i in range(3, 90):
        own = [" ".join(r.choice(vocab) for _ in range(r.randint(1, 12))) for _ in range(r.randint(1, 4))] + [r.choice(pool) for _ in range(r.randint(0, 3))]
        r.shuffle(own)
        docs.append((i, "\n".join(own)))
    docs += [(200, docs[10][1]), (201, docs[10][1]), (202, "word " * 40_000)]
    got = sorted(tuple(x) for x in lines.report(spark.createDataFrame([(i, t, 0, "clash") for i, t in docs], DOCS)).collect())
    con = duckdb.connect()
    con.register("frame", pd.DataFrame(docs, columns=["doc_id", "text"]))
    con.execute("CREATE TABLE documents AS SELECT doc_id::BIGINT AS doc_id, text::VARCHAR AS text FROM frame")
    assert got == sorted(con.execute(lines.SQL).fetchall())
    assert sum(x[2] for x in got) > 20
    kept = {x.doc_id: x for x in lines.deduplicate(spark.createDataFrame([(i, t, len(t or ""), "clash") for i, t in docs] + [(None, "the cat sat on a mat today", 3, "")], DOCS)).collect()}
    assert kept[0].text is None and kept[None].text.startswith("the cat") and all(x.n_chars == len(x.text) for k, x in kept.items() if x.text is not None and k is not None)


def test_templates_generalise_variable_fields(spark):
    docs = [(1, "alpha one two three four x five six seven eight"), (2, "alpha one two three four y five six seven eight"), (3, "alpha one two three four z five six seven eight"), (4, "alpha one two something else entirely different from all others")]
    got = {x.doc_id: x.n_dropped for x in lines.report(spark.createDataFrame([(i, t, 0, "") for i, t in docs], DOCS)).collect()}
    assert got == {1: 0, 2: 1, 3: 1, 4: 0}


def test_lines_of_every_length_count(spark):
    docs = [(1, "All rights reserved.\n\npage 12\n中文的一行没有空格\none of its own"), (2, "other\nAll rights reserved.\n\npage 13"), (3, "中文的一行没有空格\n \n\t\nAll rights reserved.\npage 12"), (4, "more\n\n \n\t")]
    got = {x.doc_id: x.text for x in lines.deduplicate(spark.createDataFrame([(i, t, 0, "") for i, t in docs], DOCS)).collect()}
    assert got == {1: docs[0][1], 2: "other\n\npage 13", 3: " \n\t", 4: docs[3][1]}


def test_given_tables_against_sql(spark):
    import duckdb

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    want = con.execute(lines.SQL).fetchall()
    assert sorted(tuple(x) for x in lines.report(docs).collect()) == sorted(want)
    assert sum(x[2] for x in want) > 100


def test_a_leaf_with_several_templates(spark):
    ends = ["one", "two", "three"]
    texts = [f"alpha beta gamma {middle} {end} said today" for middle in ("x y z", "p q r", "k l m") for end in ends]
    texts += [f"alpha beta gamma {w} {w}a {w}b {w}c {w}d {w}e" for w in "stuv"]
    docs = list(enumerate(texts))
    got = {x.doc_id: x.n_dropped for x in lines.report(spark.createDataFrame([(i, t, 0, "") for i, t in docs], DOCS)).collect()}
    assert got == {i: int(i < 9 and i % 3 > 0) for i in range(len(texts))}


def test_many_templates_against_sql(spark):
    import duckdb
    import pandas as pd

    r = random.Random(12)
    kinds = [[r.choice("abcdefgh") * 2 for _ in range(r.randint(3, 7))] for _ in range(25)]
    docs = []
    for i in range(250):
        own = []
        for _ in range(r.randint(1, 4)):
            k = list(r.choice(kinds))
            for _ in range(r.choice([0, 1, 1, 2])):
                k[r.randrange(len(k))] = r.choice("mnopq")
            own.append(" ".join([*r.choice(["aa bb cc", "aa bb dd"]).split(), *k]))
        docs.append((i, "\n".join(own)))
    got = sorted(tuple(x) for x in lines.report(spark.createDataFrame([(i, t, 0, "") for i, t in docs], DOCS)).collect())
    con = duckdb.connect()
    con.register("frame", pd.DataFrame(docs, columns=["doc_id", "text"]))
    con.execute("CREATE TABLE documents AS SELECT doc_id::BIGINT AS doc_id, text::VARCHAR AS text FROM frame")
    assert got == sorted(con.execute(lines.SQL).fetchall())
    assert sum(x[2] for x in got) > 50


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def test_pii_is_replaced_consistently(spark):
    texts = [
        None, "", "nothing here", "Write to Jürgen.Müller+x@mail6.example.com, or JÜRGEN.MÜLLER+X@MAIL6.EXAMPLE.COM.", "At 10.0.0.255 and 1.2.3.4.5 and 999.1.1.1.",
        "+1 (788) 555-2942 and 788-555-2942.", "card 4845168114407329 or 4845 1681 1440 7329", "ssn 123-45-6789", "Emily met Emily Smith and Charles; Светлана Иванова too. Emilyx", "jürgen.müller+x@mail6.example.com",
        "x" * 200_000 + " 10.0.0.255", "GB82 WEST 1234 5698 7654 32 and DE89370400440532013000, not DE00370400440532013000",
    ]
    df = spark.createDataFrame([(i, t, 0, "clash") for i, t in enumerate(texts)] + [(7, texts[7], 0, ""), (None, texts[7], 0, "")], DOCS)
    rows = pii.replace(df, "k1").collect()
    assert len(rows) == len(texts) + 2
    got = {x.doc_id: x for x in rows}
    assert got[0].text is None and got[1].text == "" and got[2].text == texts[2]
    assert [got[i].n_entities for i in range(12)] == [0, 0, 0, 2, 1, 2, 2, 1, 4, 1, 1, 2]
    a = re.search(r"\S+@\S+net", got[3].text)[0]
    assert a == a.lower() and a.upper() in got[3].text and got[9].text == a
    ip = re.search(r"At (\S+) and", got[4].text)[1]
    assert got[10].text.endswith(" " + ip) and re.fullmatch(r"(\d{1,3}\.){3}\d{1,3}", ip) and ip != "10.0.0.255"
    m = re.fullmatch(r"\+1 \((\d{3})\) (\d{3})-(\d{4}) and (\d{3})-(\d{3})-(\d{4})\.", got[5].text)
    assert m.groups()[:3] == m.groups()[3:] != ("788", "555", "2942")
    m = re.fullmatch(r"card (\d{16}) or ((?:\d{4} ){3}\d{4})", got[6].text)
    assert m[1] == m[2].replace(" ", "") != "4845168114407329" and luhn(m[1])
    assert got[7].text == got[None].text and re.fullmatch(r"ssn \d{3}-\d{2}-\d{4}", got[7].text)
    m = re.fullmatch(r"(\w+) met (\w+) (\w+) and (\w+); (\w+) (\w+) too\. Emilyx", got[8].text)
    assert m[1] == m[2] in pii.NAMES["female_latin"] and m[4] in pii.NAMES["male_latin"] and m[5] in pii.NAMES["female_cyrillic"]
    assert re.fullmatch("[А-Я][а-я]+а", m[6]) and m[3][0].isupper() and m[1] != "Emily" and m[3] != "Smith"
    m = re.fullmatch(r"(GB\d\d [A-Z]{4} \d{4} \d{4} \d{4} \d\d) and (DE\d{20}), not DE00370400440532013000", got[11].text)
    for own in m.groups():
        own = own.replace(" ", "")
        assert int("".join(str(int(c, 36)) for c in own[4:] + own[:4])) % 97 == 1


def test_names_by_context_and_word(spark):
    said = "Emily Smith and John Smith, Mr. Okafor, 2001:db8::1, order 1234567890123456, Sarah Smith, Dear Okafor, Dear All, Dr. John Q. Smith at 12:30:45 in std::map"
    (row,) = pii.replace(spark.createDataFrame([(1, said, 0, "")], DOCS), "k1").collect()
    w = r"([A-Z][a-z]+)"
    m = re.fullmatch(rf"{w} {w} and {w} {w}, Mr\. {w}, ([0-9a-f:]+), order 1234567890123456, {w} {w}, Dear {w}, Dear All, Dr\. {w} ([A-Z]\.) {w} at 12:30:45 in std::map", row.text)
    emily, smith, john, smith2, okafor, v6, sarah, smith3, okafor2, john2, initial, smith4 = m.groups()
    assert smith == smith2 == smith3 == smith4 != "Smith" and okafor == okafor2 not in ("Okafor", smith) and john == john2
    assert {emily, sarah} <= set(pii.NAMES["female_latin"]) - {"Emily"} and emily != sarah and john in pii.NAMES["male_latin"] and john != "John"
    assert initial != "Q." and re.fullmatch(r"\d{4}:[a-f]{2}\d::\d", v6) and v6 != "2001:db8::1" and row.n_entities == 7


def test_surrogates_stay_distinct(spark):
    many = [(i, f"{i // 100 % 10}.{i // 10 % 10}.0.{i % 10} a{i}@x.com 100-10-{i:04d}", 0, "") for i in range(600)]
    rows = pii.replace(spark.createDataFrame(many, DOCS), "k1").collect()
    for k in range(3):
        assert len({x.text.split()[k] for x in rows}) == len({t.split()[k] for _, t, *_ in many})
    assert not {w for x in rows for w in x.text.split()} & {w for _, t, *_ in many for w in t.split()}


def test_no_rows(spark):
    none = spark.createDataFrame([], DOCS)
    assert pii.replace(none, "k1").count() == 0 and lines.report(none).count() == 0 and lines.deduplicate(none).count() == 0
