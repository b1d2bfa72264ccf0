import hashlib
import ipaddress
import random

from pyspark.sql import functions as F

from textloom.functions import vocab
from textloom.operators import indicators
from textloom.operators.indicators import entities


def found(spark, text):
    rows = entities(spark.createDataFrame([("a", text)], "artifact_id string, text string")).collect()
    return {(r.type, r.value, r.trust) for r in rows}, rows


def test_kinds_and_trust(spark):
    text = "go https://a.example.com/x. or http://localhost:80/y, 10.1.2.3 8.8.8.8 http://u@127.0.0.1:3/ 010.1.1.1 $HOME ./a/b.txt"
    got, _ = found(spark, text)
    assert {
        ("NETWORK_DESTINATION", "https://a.example.com/x", "EXTERNAL"),
        ("NETWORK_DESTINATION", "http://localhost:80/y,", "UNKNOWN"),
        ("NETWORK_DESTINATION", "10.1.2.3", "UNKNOWN"),
        ("NETWORK_DESTINATION", "8.8.8.8", "EXTERNAL"),
        ("NETWORK_DESTINATION", "http://u@127.0.0.1:3/", "UNKNOWN"),
        ("NETWORK_DESTINATION", "010.1.1.1", "EXTERNAL"),
        ("ENVIRONMENT_VARIABLE", "HOME", "UNKNOWN"),
        ("FILE", "./a/b.txt", "UNKNOWN"),
    } - {("NETWORK_DESTINATION", "http://localhost:80/y,", "UNKNOWN")} <= got
    assert ("NETWORK_DESTINATION", "http://localhost:80/y", "UNKNOWN") in got


def test_domains_and_files_need_a_sign(spark):
    got, _ = found(spark, "Next.js and foo.bar and yarn.lock; read notes.md then `x.py` at bare.example.org https://in.example.com/a")
    assert {v for _, v, _ in got} == {"notes.md", "x.py", "bare.example.org", "https://in.example.com/a"}


def test_identity(spark):
    _, rows = found(spark, "8.8.8.8")
    digest = hashlib.sha256(b"NETWORK_DESTINATION\x008.8.8.8\x000\x007").hexdigest()[:12]
    assert [r.id for r in rows] == [f"static.network_destination.{digest}"]


HOSTS = [
    "::1", "::", "fe80::1", "febf::", "fec0::1", "fc00::1", "fdff::", "fe00::1", "2001:db8::1", "0:0:0:0:0:0:0:1", "1::2::3", ":::", "1:2:3", "::2", "0::0", "fe80:0:0:0:0:0:0:1", "10.1.2.3", "11.1.2.3", "172.16.0.1", "172.32.0.1",
    "192.168.1.1", "169.254.9.9", "0.1.2.3", "127.0.0.1", "127.0.0.256", "010.1.1.1", "1.2.3", "localhost", "a.localhost", "localhost.a",
]


def test_local_addresses(spark):
    rows = [(v, f"http://[{v}]:8/x" if ":" in v else f"http://{v}:8/x") for v in HOSTS]
    df = spark.createDataFrame(rows, "v string, u string")
    for r in df.select("v", indicators.local_destination(F.col("v")).alias("bare"), indicators.local_destination(F.col("u")).alias("url")).collect():
        try:
            address = ipaddress.ip_address(r.v)
            want = any(address in ipaddress.ip_network(n) for n in vocab.LOCAL_NETWORKS)
        except ValueError:
            want = r.v in ("localhost", "a.localhost")
        assert (r.bare, r.url) == (want, want), r.v


def test_containment_equals_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for i in range(60):
        spans = [(rng.choice(["url", "domain", "explicit_file_reference", "ip_address"]), *sorted(rng.sample(range(40), 2))) for _ in range(rng.randrange(40))]
        rows.append((i, spans))
    df = spark.createDataFrame(rows, "i int, a array<struct<kind:string,start:int,end:int>>")
    for r in df.select("i", indicators.covered(F.col("a")).alias("m")).collect():
        spans = rows[r.i][1]
        for m in r.m:
            wide = [(s, e) for k, s, e in spans if k in ("url", "explicit_file_reference")]
            if m.it.kind in ("domain", "ip_address"):
                assert m.inside == any(s <= m.it.start and e >= m.it.end for s, e in wide)
