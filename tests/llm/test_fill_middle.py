import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F
from tokenizers import Regex, pre_tokenizers

from methspark.llm import fill_middle

SPLIT = pre_tokenizers.Split(Regex(fill_middle.LINES), "isolated")


def plainly(name, text, rate=100, spm=50, seed=7):
    """The contract, on Python strings."""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(units)
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < spm else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def texts():
    r = random.Random(13)
    made = ["", None, "\n", "\n\n\n", "a", "a\n", "a\r\nb c\x0bd\x00", "é\n𝄞𝄞\n\nß", "<P>\na\nb", "x\n<S>", "<M>", "<P", "P>\n<\nS>\n<M", ">\n<", "< P>\n" * 3]
    for _ in range(150):
        made.append("".join(r.choice(["\n", "a", "é", "𝄞 ", "<", ">", "S>", "M", "<P ", "word "]) for _ in range(r.randint(0, 60))))
    return made


@pytest.mark.parametrize("piece", [1, 2, 3, 7, 4096])
def test_units_do_not_depend_on_pieces(piece):
    for text in texts():
        units = re.findall(r"[^\n]*\n|[^\n]+", text or "")
        ends = fill_middle.unit_ends(text or "", SPLIT, piece).tolist()
        assert ends == [sum(map(len, units[:k])) for k in range(len(units) + 1)]


@pytest.mark.parametrize(("rate", "spm"), [(100, 50), (60, 0), (0, 50), (100, 100)])
def test_documents_are_cut_as_in_plain_python_and_come_back(spark, monkeypatch, rate, spm):
    monkeypatch.setattr(fill_middle, "BATCH", 200)
    rows = list(enumerate(texts()))
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, form string, n int").repartition(3)
    got = {x.doc_id: x for x in fill_middle.fill_middle(df, rate=rate, spm=spm).withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()}
    for i, t in rows:
        x = got[i]
        assert (x.n, x.form, x.prefix_chars, x.middle_chars, x.output) == plainly(i, t or "", rate, spm)
        assert x.back == (t or "")
    assert len(got) == len(rows)


def test_fill_middle_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert fill_middle.fill_middle(empty).collect() == []
    long, lines = "x" * 3_000_000, "é\n" * 700_000
    rows = [(None, "a\nb\nc"), (5, "a\nb"), (5, "a\nb"), (5, None), (6, long), (7, lines)]
    got = fill_middle.fill_middle(spark.createDataFrame(rows, "doc_id long, text string")).withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    assert sorted((str(x.doc_id), x.back) for x in got) == sorted((str(i), t or "") for i, t in rows)
    for x in got:
        assert (x.n, x.form, x.prefix_chars, x.middle_chars, x.output) == plainly("" if x.doc_id is None else x.doc_id, x.back)
    names = spark.createDataFrame([("k é", "a\nb")], "name string, body string")
    assert fill_middle.fill_middle(names, "name", "body").first().output == plainly("k é", "a\nb")[4]
