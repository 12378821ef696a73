from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilframe.functions import text as X
from veilframe.plans.written import with_luhn
from veilframe.functions.otp import STEP, Verifier, hotp
from veilframe.sources import requests
from veilframe.streaming import process


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x"))).first()[0]


def test_checksums(spark):
    check = lambda d, weights: sum(int(x) * w for x, w in zip(d, weights)) % 11 % 10
    ten = "362814095" + str(check("362814095", X.INN_10))
    twelve = "3628140957" + str(check("3628140957", X.INN_11))
    twelve += str(check(twelve, X.INN_12))
    snils = "90811630" + "2"
    snils += f"{sum(int(x) * w for x, w in zip(snils, range(9, 0, -1))) % 101 % 100:02}"
    card = with_luhn("402960001234567")
    for number, valid in ((ten, X.inn_valid), (twelve, X.inn_valid), (snils, X.snils_valid), (card, X.luhn_valid)):
        assert one(spark, number, valid) and not one(spark, number[:-1] + str((int(number[-1]) + 1) % 10), valid)
    assert not one(spark, "", X.inn_valid) and not one(spark, "0", X.luhn_valid)


def test_codes_of_the_standard():
    """RFC 6238, appendix B, SHA-256."""
    secret = b"12345678901234567890123456789012"
    for at, code in ((59, "46119246"), (1111111109, "68084774"), (1111111111, "67062674"), (1234567890, "91819424"), (2000000000, "90698825")):
        assert hotp(secret, at // STEP) == code


def test_forms(spark):
    assert one(spark, "петрова", X.name_forms) == ["петровой", "петрову", "петровы", "петровых"]
    assert "александровичем" in one(spark, "александрович", X.name_forms)
    assert one(spark, "толстой", X.name_forms)[0] == "толстого"


def test_base64url(spark):
    assert one(spark, b"\xfb\xff\x00", X.base64url, "binary") == "-_8A"
    assert bytes(one(spark, "-_8A", X.from_base64url)) == b"\xfb\xff\x00"


def test_hmac(spark):
    import hashlib
    import hmac

    assert bytes(one(spark, b"message", lambda c: X.hmac_sha256(b"key", c), "binary")) == hmac.new(b"key", b"message", hashlib.sha256).digest()


@given(st.integers(0, 2**40))
def test_code_has_eight_digits(counter):
    assert len(hotp(b"secret", counter)) == 8


def test_code_is_used_once():
    v = Verifier(b"secret")
    code = hotp(b"secret", 10)
    assert v.verify("a", code, 10 * STEP) and not v.verify("a", code, 10 * STEP) and v.verify("b", code, 11 * STEP) and not v.verify("c", code, 13 * STEP)


def test_requests(spark):
    bodies = [('{"payload":5,"payload_id":"x"}', None), ('{"payload":"a","payload":"b","payload_id":"x"}', ("b", "x")), ('{"payload":{"payload":"a"},"payload_id":"x"}', None), ('{"payload":"a","payload_id":"1"}', ("a", "1")), ('{"payload":"a"}', None), ("x", None), (None, None), ('{"payload":"\\u0430","payload_id":"2","n":{"payload":"z"}}', ("а", "2"))]
    df = spark.createDataFrame([(i, b) for i, (b, _) in enumerate(bodies)], "i int, b string").select("i", requests.parse_request(F.col("b")).alias("r"))
    assert {r.i: r.r and tuple(r.r) for r in df.collect()} == {i: want for i, (_, want) in enumerate(bodies)}


def test_find_string(spark):
    bodies = [('{"k":"a"}', "a"), ('{"k":5}', None), ('{"n":{"k":"a"}}', None), ("x", None), (None, None), ('{"k":"5","z":1}', "5"), ('{"k":5,"k":"a"}', "a"), ('{"k":"a","k":"b"}', "a"), ('{"k":{"k":"x"},"j":"y","k":"z"}', "z"), ("[1]", None), ('{"k":null}', None)]
    df = spark.createDataFrame([(i, b) for i, (b, _) in enumerate(bodies)], "i int, b string").select("i", requests.find_string(F.col("b"), "k").alias("k"))
    assert {r.i: r.k for r in df.collect()} == {i: want for i, (_, want) in enumerate(bodies)}


def test_profiles(spark, tmp_path):
    (tmp_path / "p.yaml").write_text("systems:\n  crm:\n    enabled: true\n    mask_mode: token\n    pii_types: [fio, card, nonsense]\n    irreversible: [cvv]\nlimits:\n  ttl: 9\n")
    p = requests.load_profiles(spark, str(tmp_path / "p.yaml"))["crm"]
    assert p.kinds == ("fio", "card") and p.mask_mode == "token" and p.irreversible == ("cvv",)
    assert list(requests.load_profiles(spark, str(tmp_path / "none.yaml"))) == ["default"]


def test_replay(spark):
    rows = [("a", 1, "x"), ("a", 2, "x"), ("a", 3, "y"), ("b", 1, None)]
    got = process.replay(spark.createDataFrame(rows, "payload_id string, seq long, payload string")).orderBy("payload_id", "seq").collect()
    assert [(r.action, r.answer) for r in got] == [("mask", "x"), ("mask", "x"), ("restore", "x"), ("mask", None)]
    kept = process.replay(spark.createDataFrame(rows, "payload_id string, seq long, payload string"), demask=False).orderBy("payload_id", "seq").collect()
    assert [(r.action, r.answer) for r in kept] == [("mask", "x"), ("mask", "x"), ("echo", "y"), ("mask", None)]


def test_stream_equals_replay(spark, tmp_path):
    rows = [("a", 1, "x"), ("b", 1, "q"), ("a", 2, "x"), ("a", 3, "y")]
    spark.createDataFrame(rows, "payload_id string, seq long, payload string").coalesce(1).write.parquet(str(tmp_path / "in"))
    # a processing-time timeout asks for batches without data for ever, which availableNow waits for
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    source = spark.readStream.schema("payload_id string, seq long, payload string").parquet(str(tmp_path / "in"))
    q = process.process_stream(source).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got = {(r.payload_id, r.seq): (r.action, r.payload) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r.payload_id, r.seq): (r.action, r.answer) for r in process.replay(spark.createDataFrame(rows, "payload_id string, seq long, payload string")).collect()}
    assert got == want
