import pytest
from pyspark.sql import functions as F

from maskwright.functions import keys
from maskwright.operators import mapping as M
from maskwright.operators.nested import pseudonymize_nested, restore_nested, with_parsed
from maskwright.sources import files, sidecar
from maskwright.streaming import proxy

SECRET = keys.Secret("00112233445566778899aabbccddeeff" * 2)
OTHER = keys.Secret("ffeeddccbbaa99887766554433221100" * 2)


@pytest.fixture(scope="module")
def entries(spark):
    return spark.createDataFrame([("hmac", None, "9f4b5081", "max.mueller@firma.de", "EMAIL"), ("hmac", None, "5cd3e8f0-2", "Älpha", "TERM")], M.SCHEMA)


def test_mapping_file_round_trip(spark, entries, tmp_path):
    f = sidecar.save_mapping(entries, SECRET, tmp_path / sidecar.sidecar_path("a.txt"), "k1")
    got = sidecar.load_mapping(spark, f, SECRET, "k1")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, entries.collect()), key=str)
    blob = f.read_bytes()
    assert blob[4] == 2 and blob != sidecar.encode(entries, SECRET, "k1") and "max.mueller".encode() not in blob
    with pytest.raises(sidecar.WrongKeyError):
        sidecar.decode(spark, blob, OTHER)
    with pytest.raises(sidecar.WrongKeyError):
        sidecar.decode(spark, blob[:-1] + bytes([blob[-1] ^ 1]), SECRET)
    with pytest.raises(sidecar.WrongKeyError):
        sidecar.decode(spark, blob[:6] + b"k2" + blob[8:], SECRET)
    for bad in (b"XXXX" + blob[4:], blob[:10], blob[:4] + b"\x63" + blob[5:]):
        with pytest.raises(sidecar.MappingError):
            sidecar.decode(spark, bad, SECRET)
    with pytest.raises(sidecar.MappingError):
        sidecar.decode(spark, blob, SECRET, "other")
    with pytest.raises(sidecar.MappingError):
        sidecar.header("x" * 256)


def test_run_over_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_bytes("x a@b.de\r\ny Foo\rz".encode())
    (tmp_path / "in" / "b.md").write_text("`a@b.de` a@b.de", "utf-8")
    (tmp_path / "terms").write_text("# note\n\n Foo \n", "utf-8")
    options = files.RunOptions(output=str(tmp_path / "out"), denylist=str(tmp_path / "terms"))
    r = files.run(spark, str(tmp_path / "in"), SECRET, options)
    got = {x.path.rsplit("/", 1)[1]: x.text for x in spark.read.parquet(str(tmp_path / "out" / "documents")).collect()}
    email = f"[[EMAIL_{keys.full_token(SECRET, 'a@b.de')[:8]}]]"
    assert got == {"a.txt": f"x {email}\ny [[TERM_{keys.full_token(SECRET, 'Foo')[:8]}]]\nz", "b.md": f"`a@b.de` {email}"}
    assert r.mapping.count() == 2 and spark.read.parquet(str(tmp_path / "out" / "report")).agg(F.sum("n_replaced")).first()[0] == 3
    (tmp_path / "in" / "c.txt").write_bytes(b"\xff\xfe")
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_text(spark, str(tmp_path / "in")).collect()
    with pytest.raises(PermissionError):
        files.confined("/etc/passwd", str(tmp_path))
    assert files.confined(str(tmp_path / "x"), str(tmp_path)) and files.confined("/etc/passwd", "*")


def test_nested_leaves(spark):
    kind = "doc_id long, x struct<a:string,n:int,l:array<string>,m:map<string,struct<s:string,b:boolean>>>, y array<int>"
    row = (1, ("to a@b.de", 3, ["c@d.de", None, "a@b.de"], {"a@b.de": ("x c@d.de", True)}), [1])
    d = spark.createDataFrame([row, (2, None, None)], kind)
    r = pseudonymize_nested(d, SECRET, ["x", "y"])
    t = {v: f"[[EMAIL_{keys.full_token(SECRET, v)[:8]}]]" for v in ("a@b.de", "c@d.de")}
    x, none = r.documents.orderBy("doc_id").collect()
    assert x.x.a == f"to {t['a@b.de']}" and x.x.n == 3 and x.x.l == [t["c@d.de"], None, t["a@b.de"]] and none.x is None
    assert x.x.m["a@b.de"].s == f"x {t['c@d.de']}" and x.x.m["a@b.de"].b and x.y == [1]
    assert restore_nested(r.documents, r.mapping, ["x"]).orderBy("doc_id").first() == d.orderBy("doc_id").first()
    j = spark.createDataFrame([(1, '{"k":"a@b.de","n":1}')], "doc_id long, p string")
    out = with_parsed(j, "p", "k string, n int", lambda df: pseudonymize_nested(df, SECRET, ["p"]).documents)
    assert out.first().p == f'{{"k":"{t["a@b.de"]}","n":1}}'


def test_stream(spark, tmp_path):
    kind = "id long, direction string, kind string, text string"
    rows = [(1, "response", "text", "a@b.de"), (2, "request", "text", "[[EMAIL_x]]"), (3, "response", "image", "a@b.de"), (4, "response", "text", None), (5, None, "text", "a@b.de")]
    spark.createDataFrame(rows, kind).coalesce(1).write.parquet(str(tmp_path / "in"))
    where = [str(tmp_path / x) for x in ("map", "out", "cp")]

    def run(trusted=False):
        proxy.start(spark.readStream.schema(kind).parquet(str(tmp_path / "in")), SECRET, *where, trusted=trusted).awaitTermination(120)
        return {x.id: x.text for x in spark.read.parquet(where[1]).collect()}

    token = f"[[EMAIL_{keys.full_token(SECRET, 'a@b.de')[:8]}]]"
    assert run() == {1: token, 2: "[[EMAIL_x]]", 3: "a@b.de", 4: None, 5: "a@b.de"}
    assert proxy.load_mapping(spark, where[0]).count() == 1
    spark.createDataFrame([(6, "request", "text", f"hi {token}"), (7, "response", "text", "a@b.de c@d.de")], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = run(trusted=True)
    assert got[6] == "hi a@b.de" and got[7].startswith(token) and proxy.load_mapping(spark, where[0]).count() == 2


def test_stream_fails_closed(spark, tmp_path, monkeypatch):
    def broken(*_, **__):
        raise RuntimeError("x")

    monkeypatch.setattr(proxy, "pseudonymize", broken)
    d = spark.createDataFrame([(1, "response", "text", "a@b.de")], "id long, direction string, kind string, text string")
    with pytest.raises(RuntimeError):
        proxy.batch(d, SECRET, str(tmp_path))
    assert proxy.batch(d, SECRET, str(tmp_path), fail_open=True).first().text == "a@b.de"
