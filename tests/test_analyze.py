import pytest
from pyspark.sql import functions as F

from maskwright.functions.checksums import VALIDATORS
from maskwright.operators import anonymize as anon
from maskwright.operators.analyze import Options, analyze
from maskwright.operators.catalog import RECOGNIZERS, supported_entities
from maskwright.operators.scan import lines


def spans(spark, text, **options):
    row = analyze(spark.createDataFrame([(text,)], "text string"), options=Options(**options)).first()
    for s in row.spans:
        assert text.encode()[s.start : s.end].decode() == s.text
    return [(s.entity_type, s.text, round(s.score, 4)) for s in row.spans]


def test_catalog():
    assert (len(RECOGNIZERS), sum(len(r.patterns) for r in RECOGNIZERS), sum(r.validator is not None for r in RECOGNIZERS), len(supported_entities())) == (52, 74, 28, 51)


def test_iban_and_mail(spark):
    text = "Contact jane@example.com or pay to IBAN DE89370400440532013000"
    found = spans(spark, text, entities=["IBAN_CODE", "EMAIL_ADDRESS"])
    assert found == [("IBAN_CODE", "DE89370400440532013000", 1.0), ("EMAIL_ADDRESS", "jane@example.com", 0.5)]
    assert [x[0] for x in spans(spark, text, threshold=0.6, entities=["IBAN_CODE", "EMAIL_ADDRESS"])] == ["IBAN_CODE"]
    assert spans(spark, text, entities=[]) == []


def test_all_types_on_one_text(spark):
    found = spans(spark, "card 4111 1111 1111 1111, email jane@example.com, ip 10.0.0.1")
    kinds = {x[0] for x in found}
    assert {"CREDIT_CARD", "IP_ADDRESS", "EMAIL_ADDRESS"} <= kinds


def test_context_and_offsets(spark):
    only = {"entities": ["EMAIL_ADDRESS"]}
    assert spans(spark, "email: jane@example.com", **only) == [("EMAIL_ADDRESS", "jane@example.com", 0.85)]
    assert spans(spark, "the recipient is jane@example.com", **only) == [("EMAIL_ADDRESS", "jane@example.com", 0.5)]
    row = analyze(spark.createDataFrame([("Reservación: jane@example.com",)], "text string"), options=Options(**only)).first()
    assert (row.spans[0].start, row.spans[0].end) == (14, 30)


def test_allow_and_null(spark):
    text = "test card 4111 1111 1111 1111 billed to jane@example.com"
    assert [x[0] for x in spans(spark, text, entities=["CREDIT_CARD", "EMAIL_ADDRESS"], allow_regex=[r"@example\.com$"])] == ["CREDIT_CARD"]
    assert analyze(spark.createDataFrame([(None,), ("",)], "text string")).collect()[0].spans == []


@pytest.mark.parametrize(
    ("name", "good", "bad"),
    [
        ("luhn", "4532015112830366", "4532015112830367"), ("ssn", "536-90-4399", "666-90-4399"), ("iban", "DE89 3704 0044 0532 0130 00", "DE88370400440532013000"), ("aba", "021000021", "021000022"),
        ("nhs", "943 476 5919", "943 476 5918"), ("cpf", "529.982.247-25", "529.982.247-24"), ("cnpj", "11.222.333/0001-81", "11.222.333/0001-82"), ("es_nif", "12345678Z", "12345678A"),
        ("es_nie", "X1234567L", "X1234567M"), ("pesel", "44051401359", "44051401358"), ("abn", "51824753556", "51824753557"), ("tfn", "123456782", "123456789"), ("it_fiscal", "RSSMRA85T10A562C", "RSSMRA85T10A562X"),
        ("sg_fin", "F1234567N", "F1234567A"), ("fi_code", "131052-308T", "131052-308U"), ("aadhaar", "234123412346", "234123412347"), ("nino", "AB123456C", "BG123456C"), ("itin", "970-12-3456", "970-00-3456"),
    ],
)
def test_validators(spark, name, good, bad):
    row = spark.createDataFrame([(good, bad)], "a string, b string").select(VALIDATORS[name](F.col("a")).alias("a"), VALIDATORS[name](F.col("b")).alias("b")).first()
    assert row.a and not row.b


def test_anonymize(spark):
    text = "by jane jane@x.com!"
    df = spark.createDataFrame([(text, [("PERSON", 3, 12, 0.4, "", ""), ("EMAIL_ADDRESS", 8, 18, 0.95, "", "")])], "text string, spans array<struct<entity_type:string,start:int,end:int,score:double,text:string,recognizer:string>>")
    put = lambda op: df.select(anon.anonymize(F.col("text"), F.col("spans"), op).alias("o")).first().o
    assert put(anon.mask("#")) == "by ###############!"
    assert put(anon.replace()) == "by <PERSON><EMAIL_ADDRESS>!"
    assert put(anon.redact()) == "by !"


def test_token_and_display(spark):
    df = spark.createDataFrame([("jane@example.com",)], "m string")
    assert df.select(anon.token()(F.lit("EMAIL_ADDRESS"), F.col("m")).alias("o")).first().o == "EMAIL_ADDRESS_272f9d53"
    assert df.select(anon.display(F.col("m")).alias("o")).first().o == "ja************om"


def test_lines(spark):
    rows = lines(spark.createDataFrame([(1, "a\r\nb\n"), (2, None), (3, ""), (4, "x\n\ny")], "id int, text string"), "id").collect()
    assert sorted((r.id, r.line, r.content) for r in rows) == [(1, 1, "a"), (1, 2, "b"), (4, 1, "x"), (4, 2, ""), (4, 3, "y")]
