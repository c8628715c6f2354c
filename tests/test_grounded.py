import json
import uuid
from datetime import date

import pytest
from pyspark.sql import functions as F

from foralia.operators import context, corpus, gazette, legal_chunks, manuals, rulings, temporal
from foralia.sources import catalogues, snapshots


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "x string").select(expression(F.col("x"))).first()[0]


@pytest.mark.parametrize(("block", "want"), [("a19", "art. 19"), ("A81BIS", "art. 81 bis"), ("dadecimoctava", "DA decimoctava"), ("dt", "DT"), ("df1", "DF 1"), ("preambulo", "preambulo"), ("a1x", "a1x")])
def test_article_label(spark, block, want):
    assert one(spark, block, legal_chunks.article_label) == want


@pytest.mark.parametrize(("block", "title", "want"), [("ss3", "x", "subseccion"), ("s4", "x", "seccion"), ("t2", "Capítulo I", "titulo"), ("tarifa", "Capítulo I", "capitulo"), ("zz", "SUBSECCIÓN 1ª", "subseccion"), ("zz", "Anexo", "otro"), ("l1", None, "libro")])
def test_structural_kind(spark, block, title, want):
    df = spark.createDataFrame([(block, title)], "b string, t string")
    assert df.select(legal_chunks.structural_kind(F.col("b"), F.col("t"))).first()[0] == want


def test_point_id(spark):
    for ident in ("norma::BOE-A-2006-20764::a19::v2007-01-01", "", "ñ"):
        assert one(spark, ident, corpus.point_id) == str(uuid.uuid5(uuid.NAMESPACE_URL, ident))


@pytest.mark.parametrize(("text", "want"), [("Hechos. F A L L O estimamos", "F A L L O estimamos"), ("FALLAMOS\nque sí", "FALLAMOS\nque sí"), ("x Parte dispositiva: no", "Parte dispositiva: no"), ("nada", None), (None, None)])
def test_verdict_part(spark, text, want):
    assert one(spark, text, rulings.verdict_part) == want


def test_merged_references(spark):
    df = spark.createDataFrame([(["Ley 35/2006", " LEY  35/2006 ", ""], "Según la Ley 35/2006 y la Orden 3/2020."), (None, None)], "d array<string>, b string")
    assert [r[0] for r in df.select(manuals.merged_references(F.col("d"), F.col("b"))).collect()] == [["Ley 35/2006", "Orden 3/2020"], []]


def test_required_day(spark):
    rows = spark.createDataFrame([(1, date(2020, 1, 1)), (2, None)], "q int, devengo_date date")
    got = temporal.required_day(rows, mode="warn", today=F.lit(date(2024, 5, 5))).orderBy("q").collect()
    assert [(r["devengo_date"], r["explicit"]) for r in got] == [(date(2020, 1, 1), True), (date(2024, 5, 5), False)]
    assert temporal.required_day(rows.where("q = 1")).first()["explicit"]
    with pytest.raises(Exception, match="required in strict mode"):
        temporal.required_day(rows).collect()


def test_filter_warnings(spark):
    rows = spark.createDataFrame([("q", f"c{k}", "disclaimer" if k else "accepted") for k in range(8)], "query_id string, chunk_id string, verdict string")
    got = temporal.filter_warnings(rows, ["query_id"]).collect()
    assert [(r["n"], r["shown"]) for r in got] == [(7, ["c1", "c2", "c3", "c4", "c5"])]


def test_summaries_in_both_formats(spark):
    item = {"identificador": "BOE-A-1", "titulo": "T", "url_pdf": {"texto": "u"}}
    as_json = json.dumps({"data": {"sumario": {"metadatos": {"fecha_publicacion": "20240130"}, "diario": {"seccion": {"nombre": "S", "departamento": {"nombre": "D", "item": item}}}}}})
    as_xml = '<sumario><meta><fecha>20240128</fecha></meta><diario><seccion num="1" nombre="S"><departamento nombre="D"><item id="BOE-A-2"><titulo>T</titulo><urlPdf>u</urlPdf></item></departamento></seccion></diario></sumario>'
    rows = spark.createDataFrame([(1, "  \n" + as_json), (2, as_xml), (3, "plain"), (4, "{broken"), (5, None)], "k int, payload string")
    items, refused = gazette.parse_summaries(rows)
    assert sorted((r["k"], r["identificador"], r["departamento"], r["titulo"]) for r in items.collect()) == [(1, "BOE-A-1", "D", "T"), (2, "BOE-A-2", "D", "T")]
    assert sorted(r["k"] for r in refused.collect()) == [3, 4, 5]


def test_rulings_from_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    files = {"a/x.json": {"ecli": "ECLI:ES:TS:2024:1", "fecha": "2024-01-02", "other": 1}, "y.json": {"organo": "TS"}, "list.json": [1]}
    for name, content in files.items():
        (tmp_path / name).write_text(json.dumps(content))
    (tmp_path / "broken.json").write_text("{")
    good, bad = catalogues.load_rulings(spark, str(tmp_path), "sentencia")
    assert [(r["ecli"], r["fecha"]) for r in good.collect()] == [("ECLI:ES:TS:2024:1", date(2024, 1, 2))]
    assert bad.count() == 2


def test_snapshots(spark, tmp_path):
    path = "file://" + str(tmp_path / "snapshots")
    row = lambda boe, block, digest: (boe, date(2024, 1, 1), date(2024, 1, 1), block, digest)
    assert snapshots.load(spark, path).count() == 0
    snapshots.save(path, spark.createDataFrame([row("A", "a1", "AB" * 32), row("A", "a2", "cd" * 32), row("B", "a1", "ef" * 32)], snapshots.BLOCKS))
    snapshots.save(path, spark.createDataFrame([row("A", "a1", "00" * 32)], snapshots.BLOCKS))
    assert sorted((r["boe_id"], r["article_id"], r["hash"]) for r in snapshots.load(spark, path).collect()) == [("A", "a1", "00" * 32), ("B", "a1", "ef" * 32)]
    with pytest.raises(Exception, match="broken snapshot: C a9"):
        snapshots.save(path, spark.createDataFrame([row("C", "a9", "nothex")], snapshots.BLOCKS))
    assert snapshots.load(spark, path).count() == 2
    (tmp_path / "snapshots" / "part-broken.parquet").write_text("x")
    with pytest.raises(Exception):
        snapshots.load(spark, path).collect()


def test_retrieve(spark):
    vector = [1.0, 0.0]
    chunks = spark.createDataFrame(
        [("c1", "norma", "impuesto de la renta", vector, "irpf", None, None, "BOE-A-1", "art. 7"), ("c2", "manual", "renta y ahorro", [0.5, 0.5], "irpf", None, None, None, None), ("c3", "norma", "renta vieja", vector, "iva", None, date(2000, 1, 1), "BOE-A-2", None)],
        "chunk_id string, source_type string, text string, embedding array<double>, impuesto string, effective_from date, effective_to date, boe_id string, articulo string",
    )
    queries = spark.createDataFrame([(1, " renta ", vector), (2, "  ", vector)], "query_id int, text string, embedding array<double>")
    got = context.retrieve(chunks, queries, families=["norma"], day=F.lit(date(2024, 1, 1))).collect()
    assert [(r["query_id"], r["place"], r["chunk_id"], r["hint"]) for r in got] == [(1, 1, "c1", "art. 7 (BOE-A-1)")]
    assert got[0]["rendered"] == "[FUENTE 1] Norma — BOE-A-1, art. 7\nBOE-ID: BOE-A-1\nPinpoint: art. 7\nImpuesto: IRPF\nimpuesto de la renta"
    for wrong in ({"top": 0}, {"top": True}, {"families": []}, {"families": ["x"]}, {"tax": " "}):
        with pytest.raises(ValueError):
            context.retrieve(chunks, queries, **wrong)


def test_applicable_versions_deals_rows_by_input_not_by_compressed_bytes(spark):
    from foralia import plans
    from foralia.runtime import FOLD_PARTS

    found = plans.queries()["applicable_versions"](spark, "/root/testdata/sf0.001")
    assert found.rdd.getNumPartitions() >= FOLD_PARTS
