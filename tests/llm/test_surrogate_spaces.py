"""Surrogates (operator 8) when the corpus has more entities than a format's own shape."""

from itertools import product

from pyspark.sql import functions as F

from factorframe.llm import pii


def test_more_entities_than_a_space_has(spark):
    names = [("name", f"m|latin|person{chr(97 + i // 676)}{chr(97 + i // 26 % 26)}{chr(97 + i % 26)}") for i in range(6000)]
    ips = [("ip", ".".join(o)) for o in product("123456789", repeat=4)]
    mails = [("email", f"{a}@{b}.com") for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz"]
    entities = names + ips + mails
    got = pii.surrogates(spark.createDataFrame(entities, "kind string, normal string"), "k", attempts=30).toPandas()
    assert len(got) == len(entities) and not got.duplicated(["kind", "surrogate"]).any()
    assert not set(zip(got.kind, got.surrogate.str.lower())) & set(entities)
    assert got[got.kind == "email"].surrogate.str.fullmatch(r"[a-z]+@[a-z]\.com").all()
    assert got[got.kind == "ip"].surrogate.map(lambda x: all(0 <= int(o) < 256 for o in x.split("."))).all()


def test_a_longer_number_keeps_all_its_digits(spark):
    value, kind = F.lit("+1 23 45 67"), F.lit("phone")
    drawn = pii._surrogate(F.lit("1234567"), kind, F.lit(2 * pii.WIDER), "k")
    row = spark.range(1).select(drawn.alias("s"), pii._rendered(value, kind, drawn).alias("r")).first()
    assert len(row.s) == 8 and row.r.replace(" ", "") == "+" + row.s and row.r.startswith("+" + row.s[0] + " ")
