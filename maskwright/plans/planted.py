"""Queries over texts planted in rows of the driver's tables: formats, phones, persons, terms, nested values, files,
sequential numbers and the proxy, each with the DuckDB SQL of what must come out."""

from __future__ import annotations

import os
import tempfile

import pyarrow as pa
from pyspark.sql import functions as F

from ..functions import detectors as D
from ..operators import mapping as M
from ..operators.nested import pseudonymize_nested, restore_nested
from ..operators.pseudonymize import pseudonymize, restore
from ..sources import files, formats
from ..streaming import proxy
from .queries import _LIST, _TOKEN, _VALUES, DEMO, _documents, _emails, _hmac, _t


def _suppliers(spark, sf, *text):
    """doc_id, text: the parts joined, None standing for the supplier's number."""
    parts = [F.col("s_suppkey").cast("string") if t is None else F.lit(t) for t in text]
    return _t(spark, sf, "supplier").select(F.col("s_suppkey").alias("doc_id"), F.concat(*parts).alias("text"))


def _folder(spark, name):
    """A new folder under the shared one, or a temporary one where none is set."""
    return f"{spark.conf.get('spark.checkpoint.dir', None) or tempfile.mkdtemp(prefix='maskwright-')}/{name}-{os.urandom(6).hex()}"


def _formatted(spark, sf, head, tail, kind):
    return pseudonymize(_suppliers(spark, sf, head, None, tail), DEMO, format=kind).documents.select("doc_id", "text", F.size("replaced").alias("n_replaced"))


def mail_documents(spark, sf):
    """A quoted line, and a signature after a sign-off; the header's address stays."""
    head = "From: a@b.de\nSubject: x\nMIME-Version: 1.0\nContent-Type: text/plain; charset=\"utf-8\"\nContent-Transfer-Encoding: 7bit\n\nHallo,\n> user"
    return _formatted(spark, sf, head, "@firma.de\nViele Gruesse\nEva eva@firma.de\n", "eml").withColumn("text", F.substring_index("text", "\n\n", -1))


def markdown_documents(spark, sf):
    return _formatted(spark, sf, "# a\n`x@firma.de` user", "@firma.de\n```\nc@firma.de\n```\n", "md")


def xml_documents(spark, sf):
    return _formatted(spark, sf, "<a b='x@firma.de'>user", "@firma.de<!-- y@firma.de --><c/>z@firma.de</a>", "xml")


def html_mail_text(spark, sf):
    """Text of HTML without style sheets, with character references decoded."""
    d = _suppliers(spark, sf, "<html><style>a@b.de</style><p>user", None, "&#64;firma.de</p></html>")

    def texts(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([formats.html_to_text(x).strip() for x in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return d.mapInArrow(texts, "doc_id long, text string")


def planted_phones(spark, sf):
    """National and international forms; digits with a letter before them, too few digits, and no country's plan."""
    area = F.lpad((F.col("s_suppkey") % 10000).cast("string"), 4, "1")
    d = _t(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("doc_id"),
        F.concat(F.lit("Tel. 040 12"), area, F.lit(", +49 (40) 34"), area, F.lit("; x0401234567, +49 1, +999 123456789, 0049 30 56"), area).alias("text"),
    )
    return d.select("doc_id", F.explode(D.phone_spans(F.col("text"))).alias("s")).select("doc_id", F.col("s.start").alias("start_at"), F.col("s.text").alias("phone"))


def persons(spark, sf):
    """An injected model's names above its threshold; blank texts and offsets outside of a text give none."""

    def model():
        return lambda text: [(0, text.index(" "), 0.9), (0, 3, 0.2), (5, 999, 0.9), (4, 4, 0.9)]

    text = F.when(F.col("s_suppkey") % 2 == 0, F.concat("s_name", F.lit(" hat Zeit"))).otherwise(F.lit("  "))
    d = _t(spark, sf, "supplier").select(F.col("s_suppkey").alias("doc_id"), text.alias("text"))
    return pseudonymize(d, DEMO, [D.person_detector(model)]).documents.select("doc_id", "text")


def overlapping_terms(spark, sf):
    """A list with a repeat and with a term inside another: the longer one wins."""
    d = _suppliers(spark, sf, "Alpha Beta GmbH ", None, " Alpha")
    r = pseudonymize(d, DEMO, D.build_detectors(["Alpha", "Alpha Beta GmbH", "Alpha", ""])[-1:])
    return r.documents.select("doc_id", "text", F.array_join(F.transform("replaced", lambda x: x["text"]), "|").alias("terms"))


def composed_handles(spark, sf):
    """A letter that composing changes: the token is that of the composed handle, in a text and in a nested column alike."""
    d = _suppliers(spark, sf, "an @m\u212bller", None, " bitte")
    flat = pseudonymize(d, DEMO).documents.select("doc_id", "text")
    nested = pseudonymize_nested(d.select("doc_id", F.struct("text").alias("x")), DEMO, ["x"]).documents
    return flat.join(nested.select("doc_id", F.col("x.text").alias("nested")), "doc_id")


def nested_roundtrip(spark, sf):
    d = _t(spark, sf, "documents").select("doc_id", F.struct(F.array("text", F.lit("a@firma.de")).alias("t"), F.col("n_chars")).alias("x"))
    r = pseudonymize_nested(d, DEMO, ["x"], _emails())
    back = restore_nested(r.documents, r.mapping, ["x"])
    return back.select("doc_id", F.col("x.t")[0].alias("text"), F.col("x.t")[1].alias("mail"), F.col("x.n_chars").alias("n_chars"))


def _sequential(spark, sf, **more):
    return pseudonymize(_t(spark, sf, "documents").select("doc_id", "text"), DEMO, _emails(), sequential=True, **more)


def sequential_roundtrip(spark, sf):
    r = _sequential(spark, sf)
    return restore(r.documents.select("doc_id", "text"), r.mapping)


def sequential_again(spark, sf):
    """With a mapping that knows the values, they keep their numbers, and none is added."""
    return _sequential(spark, sf, mapping=_sequential(spark, sf).mapping).mapping.select(F.col("scope").cast("long").alias("doc_id"), "token", "original")


def last_numbers(spark, sf):
    return M.last_numbers(_sequential(spark, sf).mapping).select(F.col("scope").cast("long").alias("doc_id"), "entity_type", "last")


def known_values(spark, sf):
    """A mapping that holds all values already: its tokens are used, and it doesn't grow."""
    held = _documents(spark, sf).mapping.withColumn("token", F.concat(F.lit("0000"), F.substring("token", 5, 4)))
    return pseudonymize(_t(spark, sf, "documents").select("doc_id", "text"), DEMO, _emails(), mapping=held).mapping.select("original", "token", "entity_type")


def first_seen_type(spark, sf):
    """A value found as two types has the type of its first sighting."""
    c = _t(spark, sf, "customer").select(F.col("c_name").alias("original"), F.explode(F.array(F.lit(0), F.lit(1))).alias("seen"), "c_custkey")
    kind = F.when((F.col("seen") + F.col("c_custkey")) % 2 == 0, F.lit("TERM")).otherwise(F.lit("HANDLE"))
    return M.allocate(c.select("original", kind.alias("entity_type"), "seen"), DEMO).select("original", "entity_type")


def files_run(spark, sf):
    """Texts written as a file, read, pseudonymised with a term list, written, and read back."""
    base = _folder(spark, "files")
    _t(spark, sf, "nation").select(F.concat(F.lit("mail n"), F.col("n_nationkey").cast("string"), F.lit("@firma.de an Alpha")).alias("text")).repartition(1).write.text(f"{base}/in")
    spark.createDataFrame([("# names",), (" Alpha ",), ("",)], "t string").coalesce(1).write.text(f"{base}/terms")
    files.run(spark, f"{base}/in/*.txt", DEMO, files.RunOptions(output=f"{base}/out", denylist=f"{base}/terms", format="text"))
    n = F.broadcast(spark.read.parquet(f"{base}/out/report").select("n_replaced"))  # a row per file, of which there is one
    return spark.read.parquet(f"{base}/out/documents").select(F.explode(F.split("text", "\n")).alias("text")).where("text <> ''").join(n)


def proxy_messages(spark, sf):
    """Trusted requests get originals back, responses get tokens, and other kinds pass."""
    folder = _folder(spark, "proxy")
    m = _suppliers(spark, sf, "user", None, "@firma.de").select(F.col("doc_id").alias("id"), F.lit("response").alias("direction"), F.lit("text").alias("kind"), "text")
    back = proxy.batch(m, DEMO, folder, _emails()).withColumn("direction", F.lit("request"))
    other = m.withColumn("kind", F.when(F.col("id") % 2 == 0, F.lit("image")).otherwise(F.lit("meta")))
    return proxy.batch(back.unionByName(other), DEMO, folder, _emails(), trusted=True).select(F.col("id").alias("doc_id"), "direction", "kind", "text")


QUERIES = {
    f.__name__: f
    for f in (
        mail_documents, markdown_documents, xml_documents, html_mail_text, planted_phones, persons, overlapping_terms, composed_handles, nested_roundtrip, sequential_roundtrip,
        sequential_again, last_numbers, known_values, first_seen_type, files_run, proxy_messages,
    )
}

_SEQUENTIAL = (
    f"WITH d AS (SELECT doc_id, {_LIST} AS l FROM documents), e AS (SELECT doc_id, unnest(l) AS original, unnest(range(len(l))) AS i FROM d), "
    "f AS (SELECT doc_id, original, min(i) AS i FROM e GROUP BY ALL), q AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n, original FROM f) "
)


def _mark(value: str, kind: str = "EMAIL") -> str:
    return f"'[[{kind}_' || left({_hmac(value)}, 8) || ']]'"


_USER = _mark("'user' || s_suppkey || '@firma.de'")
_AREA = "lpad(CAST(s_suppkey % 10000 AS VARCHAR), 4, '1')"
_HANDLE = _mark("nfc_normalize('@m' || chr(8491) || 'ller' || s_suppkey)", "HANDLE")
_NL = "chr(10)"

ORACLE = {
    "mail_documents": f"SELECT s_suppkey AS doc_id, 'Hallo,' || {_NL} || '> ' || {_USER} || {_NL} || 'Viele Gruesse' || {_NL} || 'Eva ' || {_mark("'eva@firma.de'")} || {_NL} AS text, 2 AS n_replaced FROM supplier",
    "markdown_documents": f"SELECT s_suppkey AS doc_id, '# a' || {_NL} || '`x@firma.de` ' || {_USER} || {_NL} || '```' || {_NL} || 'c@firma.de' || {_NL} || '```' || {_NL} AS text, 1 AS n_replaced FROM supplier",
    "xml_documents": (
        f"SELECT s_suppkey AS doc_id, '<a b=' || chr(39) || {_mark("'x@firma.de'")} || chr(39) || '>' || {_USER} || '<!-- y@firma.de --><c/>' || {_mark("'z@firma.de'")} || '</a>' AS text, 3 AS n_replaced FROM supplier"
    ),
    "html_mail_text": "SELECT s_suppkey AS doc_id, 'user' || s_suppkey || '@firma.de' AS text FROM supplier",
    "planted_phones": (
        f"SELECT s_suppkey AS doc_id, 5 AS start_at, '040 12' || {_AREA} AS phone FROM supplier UNION ALL "
        f"SELECT s_suppkey, 17, '+49 (40) 34' || {_AREA} FROM supplier UNION ALL SELECT s_suppkey, 70, '0049 30 56' || {_AREA} FROM supplier"
    ),
    "persons": f"SELECT s_suppkey AS doc_id, CASE WHEN s_suppkey % 2 = 0 THEN {_mark('s_name', 'PERSON')} || ' hat Zeit' ELSE '  ' END AS text FROM supplier",
    "overlapping_terms": (
        f"SELECT s_suppkey AS doc_id, {_mark("'Alpha Beta GmbH'", 'TERM')} || ' ' || s_suppkey || ' ' || {_mark("'Alpha'", 'TERM')} AS text, 'Alpha Beta GmbH|Alpha' AS terms FROM supplier"
    ),
    "composed_handles": f"SELECT s_suppkey AS doc_id, 'an ' || {_HANDLE} || ' bitte' AS text, 'an ' || {_HANDLE} || ' bitte' AS nested FROM supplier",
    "nested_roundtrip": "SELECT doc_id, text, 'a@firma.de' AS mail, n_chars FROM documents",
    "sequential_roundtrip": "SELECT doc_id, text FROM documents",
    "sequential_again": f"{_SEQUENTIAL} SELECT doc_id, CAST(n AS VARCHAR) AS token, original FROM q",
    "last_numbers": f"{_SEQUENTIAL} SELECT doc_id, 'EMAIL' AS entity_type, CAST(max(n) AS INTEGER) AS last FROM q GROUP BY doc_id",
    "known_values": f"WITH {_VALUES} SELECT original, '0000' || substr({_TOKEN}, 5) AS token, 'EMAIL' AS entity_type FROM v",
    "first_seen_type": "SELECT DISTINCT c_name AS original, CASE WHEN c_custkey % 2 = 0 THEN 'TERM' ELSE 'HANDLE' END AS entity_type FROM customer",
    "files_run": f"SELECT 'mail ' || {_mark("'n' || n_nationkey || '@firma.de'")} || ' an ' || {_mark("'Alpha'", 'TERM')} AS text, 50 AS n_replaced FROM nation",
    "proxy_messages": (
        "SELECT s_suppkey AS doc_id, 'request' AS direction, 'text' AS kind, 'user' || s_suppkey || '@firma.de' AS text FROM supplier UNION ALL "
        f"SELECT s_suppkey, 'response', CASE WHEN s_suppkey % 2 = 0 THEN 'image' ELSE 'meta' END, CASE WHEN s_suppkey % 2 = 0 THEN 'user' || s_suppkey || '@firma.de' ELSE {_USER} END FROM supplier"
    ),
}
