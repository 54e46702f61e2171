from pyspark.sql import functions as F

from riskloom.llm import pii


def luhn(d):
    s = 0
    for i, c in enumerate(reversed([int(x) for x in d if x.isdigit()])):
        s += c if i % 2 == 0 else sum(divmod(2 * c, 10))
    return s % 10 == 0


VALID = {
    "card": ["4111 1111 1111 1111", "4785380592391139", "5500-0000-0000-0004"], "ip": ["152.143.123.131", "0.0.0.0"],
    "date": ["2021-03-04", "31/12/1999", "12/31/1999", "04.03.2021", "2000-02-29"], "ssn": ["123-45-6789", "899-99-9999"],
    "iban": ["DE89370400440532013000", "DE89 3704 0044 0532 0130 00"], "phone": ["+1 (017) 555-7713", "(212) 555-0100", "212-555-0100"],
    "email": ["a.b.34@mail7.example.com", "é.90@x.org"], "secret": ['token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff'],
}
INVALID = ["4111111111111112", "999.1.1.1", "2021-02-30", "000-12-3456", "666-12-3456", "900-12-3456", "123-00-4567",
           "DE88370400440532013000", "1.2.3.4.5", "12345", "3.14", "a@b", "2021-13-01"]


def rewrite(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r for r in pii.pseudonymise(df).collect()}


def test_valid_values_become_valid_values_of_their_format(spark):
    flat = [(k, v) for k, vs in VALID.items() for v in vs if not (k == "card" and not luhn(v))]
    got = rewrite(spark, [f"before {v} after" for _, v in flat])
    again = rewrite(spark, [f"x {v}\n{v}." for _, v in flat])
    for i, (kind, v) in enumerate(flat):
        (f,) = got[i].findings
        assert (f.kind, f.match) == (kind, v)
        assert f.pseudonym != v and got[i].text == f"before {f.pseudonym} after"
        assert again[i].text == f"x {f.pseudonym}\n{f.pseudonym}."
        if kind not in ("email", "secret"):
            shape = lambda s: "".join("9" if c.isdigit() else c for c in s)
            assert kind == "ip" or shape(f.pseudonym) == shape(v)
            assert rewrite(spark, [f.pseudonym])[0].findings[0].kind == kind


def test_invalid_values_and_plain_text_stay(spark):
    texts = [f"see {x} there" for x in INVALID] + ["", " ", "plain words only", "x " * 5000]
    got = rewrite(spark, texts)
    for i, t in enumerate(texts):
        assert (got[i].text, got[i].findings) == (t, [])


def test_feistel_is_a_permutation(spark):
    s = pii.feistel((F.col("id") / 13).cast("long"), F.col("id") % 13, F.lit(7), F.lit(13), "t")
    out = spark.range(91).select(s.alias("s")).select(F.col("s.x") * 13 + F.col("s.y")).toPandas()
    assert sorted(out.iloc[:, 0]) == list(range(91))
    d = spark.range(100).select(pii.feistel_digits(F.lpad(F.col("id").cast("string"), 2, "0"), "t").alias("d")).toPandas()
    assert sorted(d.d) == [f"{i:02d}" for i in range(100)]


def test_nulls_repeats_empty_and_other_columns(spark):
    rows = [(None, None, "k"), (1, "1.2.3.4", "k"), (1, "1.2.3.4", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, m string")
    got = pii.pseudonymise(df).collect()
    assert got[0].text is None and not got[0].findings
    assert got[1] == got[2] and got[1].text != "1.2.3.4"
    assert pii.pseudonymise(df.limit(0)).count() == 0


def test_query_counts_by_kind(spark, sf_small):
    got = pii.op5_pii(spark, sf_small)
    kinds = " + ".join(f"n_{k}" for k in pii.KINDS)
    r = got.selectExpr("sum(n_found) AS n", f"sum({kinds}) AS m", "sum(n_email) AS e", "sum(n_card) AS c", "count(*) AS rows").first()
    assert r.n == r.m > 0 and r.e > 0 and r.c > 0 and r.rows == 200


def test_values_beside_other_numbers(spark):
    card, ssn = "4111 1111 1111 1111", "123-45-6789"
    cases = [("4111111111111111 12/27", ["4111111111111111"]), (f"{card} 123", [card]), ("order 7 4111111111111111", ["4111111111111111"]),
             (f"in 2019 {ssn}", [ssn]), ("212-555-0100 212-555-0101", ["212-555-0100", "212-555-0101"]),
             ("4111111111111111 5500000000000004 4111111111111112", ["4111111111111111", "5500000000000004"]),
             (f"{ssn} {ssn} {card}", [ssn, ssn, card]), ("DE89 3704 0044 0532 0130 2024", []),
             ("BE68 5390 0754 7034 2024", ["BE68 5390 0754 7034"]), ("2021-02-30 2021-02-27", ["2021-02-27"])]
    got = rewrite(spark, [t for t, _ in cases])
    for i, (t, want) in enumerate(cases):
        assert [f.match for f in got[i].findings] == want
        for f in got[i].findings:
            t = t.replace(f.match, f.pseudonym)
        assert got[i].text == t


def test_date_pattern_is_the_calendar():
    import datetime
    import re
    from itertools import product
    for y, m, d in product((1799, 1800, 1896, 1900, 1999, 2000, 2004, 2100, 2199, 2200), range(14), range(33)):
        def ok(m, d):
            try:
                return 1800 <= datetime.date(y, m, d).year <= 2199
            except ValueError:
                return False
        assert bool(re.search(pii.DATE, f"{y}-{m:02}-{d:02}")) == ok(m, d)
        for sep in "/.":
            assert bool(re.search(pii.DATE, f"{m:02}{sep}{d:02}{sep}{y}")) == (ok(m, d) or ok(d, m))


def test_ibans_with_letters_long_secrets_and_spaced_phones(spark):
    value = "aB3_" * 100 + "." + "xyZ9" * 50 + "=="
    cases = [(f"pay {x} PAID NOW", x, "iban") for x in
             ("GB82 WEST 1234 5698 7654 32", "GB82WEST12345698765432", "NL91 ABNA 0417 1643 00", "NO93 8601 1117 947", "FR14 2004 1010 0505 0001 3M02 606",
              "IT60 X054 2811 1010 0000 0123 456", "MT84 MALT 0110 0001 2345 MTLC AST0 01S")]
    cases += [("call 212 555 0100 now", "212 555 0100", "phone"), (f"see token={value}. Next", f"token={value}", "secret")]
    got = rewrite(spark, [t for t, _, _ in cases])
    for i, (t, v, kind) in enumerate(cases):
        (f,) = got[i].findings
        assert (f.kind, f.match) == (kind, v) and f.pseudonym != v and len(f.pseudonym) == len(v)
        assert got[i].text == t.replace(v, f.pseudonym)
        if kind == "iban":
            assert "".join(c for c in f.pseudonym if c.isalpha()) == "".join(c for c in v if c.isalpha())
            s = f.pseudonym.replace(" ", "")
            assert int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1
