import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from methspark.llm import disclosure, queries

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 if k % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain_spans(text):
    found = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            good = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m.group().split(".")), "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                found.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(found)


def odd_texts(r):
    yield from ("", None, "a@b.c.d_e@f.g", "x@y@z.w", "@@a@b.c", "a@b", "a@b.", "+.@-.-", "1.2.3.4.5.6.7.8", "256.1.1.1 1.1.1.256", "0000255.01.1.001", "1.2.3", "4111 1111 1111 1111", "4111-1111-1111-1111 4111111111111112")
    yield from ("+1 (499) 555-6503", "+1 2 3", "++12345678901", "+1234567890123456", "é𝄞 a@b.co 𝄞", "+4 4111111111111111", "1" * 40 + "." + "2.3.4", "a.b@1.2.3.4", "9" * 14 + "-" + "9" * 3 + " " + "1")
    for _ in range(250):
        yield "".join(r.choice(["a", "@", ".", "b.c", "1", "23", "255", "300", " ", "-", "+", "(", "é", "\n", "4111111111111111", "x@y.zz", "+49 30 1234567"]) for _ in range(r.randint(0, 30)))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "k") for i, t in rows], "doc_id long, text string, email string, hash int, id string").repartition(3)


def listed(df):
    return df.select("doc_id", disclosure.listed(*disclosure.KINDS).alias("base"), disclosure.listed("generalise", "remove").alias("added"))


def test_base_spans_equal_the_plain_patterns(spark):
    rows = list(enumerate(odd_texts(random.Random(11))))
    got = {x.doc_id: x.base for x in listed(disclosure.disclosures(frame(spark, rows))).collect()}
    assert got == {i: plain_spans(t) for i, t in rows}


def test_very_long_texts(spark):
    many = "mail a1@b.co, " * 30_000
    rows = [(1, "a" * 2_000_000), (2, "1" * 500_000), (3, many), (4, "1 " * 300_000), (5, "+1" + " " * 300_000), (6, "x." * 300_000 + "@"), (7, "1." * 200_000)]
    got = {x.doc_id: x.base for x in listed(disclosure.disclosures(frame(spark, rows))).collect()}
    assert got[3] == plain_spans(many) and got[7] == ",".join(f"ip:{k}:{k + 7}" for k in range(0, 400_000, 8)) and not any(got[k] for k in (1, 2, 4, 5, 6))


def planted(r):
    """Documents on which a surname and a code word go with an address, a first name less so, and common words not at all."""
    common = [f"word{k}" for k in range(60)]

    def prose(n):
        return " ".join(r.choice(common) for _ in range(n))

    rows = [prose(r.randint(5, 60)) for _ in range(300)]
    for k in range(20):
        near = ["Quillfeather,", "zx9", "Anna" if k < 12 else "Bob"]
        r.shuffle(near)
        rows.append(f"{prose(r.randint(3, 20))} {' '.join(near)} anna.q@mail.example.com {prose(r.randint(3, 20))}")
    rows += [f"{prose(5)} Anna {prose(5)}" for _ in range(10)] + [f"{prose(4)} (Quillfeather) {prose(3)} zx9@other.example.com Quillfeather", "Quillfeathers zx99 quillfeather"]
    rows += [f"{prose(9)} office@copy.example.com Uncommon {prose(9)}"] * 1
    rows += [rows[-1]] * 30  # copies are one window
    hot = [f"{prose(r.randint(2, 9))} +1 (499) 555-6503 {prose(r.randint(2, 9))} Imprint" for _ in range(150)]
    return list(enumerate(rows + hot + ["", None]))


def test_the_query_equals_its_oracle_where_terms_disclose(spark, tmp_path):
    rows = planted(random.Random(2))
    spark.createDataFrame([*rows, (5, "a b"), (None, "Quillfeather"), (5, "a b")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    found = duck.execute(queries.ORACLE_SQL["op11_disclosure"])
    names = [d[0] for d in found.description]
    want = sorted(found.fetchall(), key=str)
    got = queries.QUERIES["op11_disclosure"](spark, str(tmp_path))
    assert sorted((tuple(x[c] for c in names) for x in got.collect()), key=str) == want
    spans = {x[names.index("doc_id")]: x[names.index("spans")] for x in want}
    assert "remove:" in spans[305] and sum("generalise:" in s or "remove:" in s for i, s in spans.items() if i is not None and i < 300) == 0


def test_terms_are_replaced_everywhere_and_copies_are_no_evidence(spark, monkeypatch):
    rows = planted(random.Random(2))
    got = {x.doc_id: x.text for x in disclosure.sanitise(frame(spark, rows), everywhere=True).collect()}
    assert len(got) == len(rows) and all(got[i] == (t or "") for i, t in rows if i < 300)
    for i, t in rows:
        assert "anna.q@" not in got[i] and "Quillfeather " not in f"{got[i]} " and "Quillfeather)" not in got[i], (t, got[i])
        assert ("Uncommon" in (t or "")) == ("Uncommon" in got[i])
    assert got[331] == "Quillfeathers zx99 quillfeather" and "[EMAIL]" in got[330] and "zx9" not in got[330]
    holders = {x.doc_id: x.text for x in disclosure.sanitise(frame(spark, rows)).collect()}
    for i, t in rows:  # the same where the entity stands, and nothing but base spans elsewhere
        assert holders[i] == (got[i] if "anna.q@" in (t or "") or "Quillfeather" not in (t or "") else re.sub(PLAIN["email"], "[EMAIL]", t)), i
    monkeypatch.setattr(disclosure, "BROADCAST_BYTES", -1)
    assert got == {x.doc_id: x.text for x in disclosure.sanitise(frame(spark, rows), everywhere=True).collect()}
    assert holders == {x.doc_id: x.text for x in disclosure.sanitise(frame(spark, rows)).collect()}


def test_overlapping_spans_become_one(spark):
    rows = [(1, "+378282246310005"), (2, "a é +378282246310005, a@1.2.3.4 𝄞"), (3, None), (4, "")]
    assert plain_spans(rows[1][1]) == "email:22:31,ip:24:31,card:5:20,phone:4:20"
    got = {x.doc_id: x.text for x in disclosure.sanitise(frame(spark, rows)).collect()}
    assert got == {1: "[PHONE]", 2: "a é [PHONE], [EMAIL] 𝄞", 3: "", 4: ""}


def test_edges(spark):
    assert disclosure.disclosures(frame(spark, [])).collect() == [] and disclosure.sanitise(frame(spark, [])).collect() == []
    rows = [(None, "x a@b.co"), (None, "x a@b.co"), (1, "x a@b.co"), (1, "x"), (1, None)]
    assert sorted((str(x.doc_id), x.base) for x in listed(disclosure.disclosures(frame(spark, rows))).collect()) == [("1", ""), ("1", ""), ("1", "email:2:8"), ("None", "email:2:8"), ("None", "email:2:8")]
    assert sorted(x.text for x in disclosure.sanitise(frame(spark, rows)).collect()) == ["", "x", "x [EMAIL]", "x [EMAIL]", "x [EMAIL]"]


def test_it_is_native(spark, tiny, monkeypatch):
    from pyspark.sql import DataFrame

    plans, write = [], disclosure.written
    monkeypatch.setattr(disclosure, "written", lambda df, *a: (plans.append(df._jdf.queryExecution().toString()), write(df, *a))[1])
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    out = disclosure.disclosures(docs)
    assert isinstance(out, DataFrame) and out.filter(F.size("email") > 0).count() > 0
    plans.append(out._jdf.queryExecution().toString())
    assert len(plans) >= 4 and not any(word in plan for plan in plans for word in ("Python", "Arrow", "Pandas"))


def test_running(spark):
    for n in (0, 1, 2, 3, 31, 32, 33, 1000):
        values = list(range(n))
        df = spark.createDataFrame([(values,)], "v array<int>")
        got = df.select(F.transform(F.array("v"), lambda v: disclosure.running(v, lambda x, y: x + y))[0].alias("s")).first().s
        assert got == [sum(values[: k + 1]) for k in range(n)]


@pytest.mark.parametrize("number", ["4111111111111111", "4111111111111112", "378282246310005", "6011000990139424000", "0000000000000"])
def test_luhn(spark, number):
    assert (listed(disclosure.disclosures(frame(spark, [(1, number)]))).first().base != "") == luhn(number)
