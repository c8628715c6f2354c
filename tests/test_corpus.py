from datetime import date

import pytest
from pyspark.sql import functions as F

from foralia.operators import catalog, corpus, gazette, ingest


def test_chunks_of_all_families_share_a_schema(spark):
    normas = spark.createDataFrame([("N", "ley", "Título")], "boe_id string, kind string, title string")
    versions = spark.createDataFrame([("N", date(2020, 1, 1), None, "vigente", None), ("N", date(2010, 1, 1), date(2019, 12, 31), "vigente", "nota")], "norma_boe_id string, effective_from date, effective_to date, status string, notes string")
    rulings = spark.createDataFrame([("E", "TS", "TS", None, "x", None, "Desestima", None, date(2024, 1, 2), None)], "ecli string, organo string, tribunal_codigo string, sala string, fallo_sentido string, resumen string, fallo_texto string, ratio_decidendi string, fecha date, numero_resolucion string")
    dgt = spark.createDataFrame([("V1", date(2024, 1, 2), "Dietas", "¿?", "", "y" * 2000, "IRPF")], "numero string, fecha_salida date, asunto string, cuestion_planteada string, criterio string, contestacion_completa string, impuesto string")
    teac = spark.createDataFrame([("00/1/2023", "teac", "unifica_criterio", "estima", "IVA", "Asunto", "Criterio.", date(2023, 1, 1))], "numero string, organo string, tipo string, sentido string, impuesto string, asunto string, criterio string, fecha date")
    manual = spark.createDataFrame([("m1", "T", "C", "renta")], "chunk_id string, titulo string, contenido string, fuente string")
    every = corpus.corpus_chunks(corpus.norm_chunks(normas, versions), corpus.ruling_chunks(rulings), corpus.tax_office_chunks(dgt), corpus.tribunal_chunks(teac), corpus.manual_chunks(manual))
    got = {r["chunk_id"]: r for r in every.collect()}
    assert set(got) == {"norma::N::v2020-01-01", "norma::N::v2010-01-01", "sentencia::E", "consulta_dgt::V1", "resolucion_teac::00/1/2023", "manual::m1"}
    assert got["norma::N::v2020-01-01"]["text"] == "Título" and got["norma::N::v2010-01-01"]["text"] == "Título\n\nnota"
    assert got["sentencia::E"]["text"] == "TS  (2024-01-02)\n\nFallo: Desestima" and got["sentencia::E"]["tier"] == 20
    assert got["consulta_dgt::V1"]["text"].endswith("Contestación: " + "y" * 1500) and got["resolucion_teac::00/1/2023"]["tier"] == 21
    assert got["manual::m1"]["tier"] is None and got["resolucion_teac::00/1/2023"]["doctrine_weight"] == "binding"


def test_index_upsert_and_delete(spark):
    schema = "chunk_id string, text string, embedding array<double>"
    old = spark.createDataFrame([("a", "x", [1.0, 0.0]), ("b", "y", [0.0, 1.0])], schema)
    new = spark.createDataFrame([("b", "z", [1.0, 1.0]), ("c", "w", [0.5, 0.5])], schema)
    after = corpus.index_chunks(old, new, 2)
    assert {r["chunk_id"]: r["text"] for r in after.collect()} == {"a": "x", "b": "z", "c": "w"}
    assert corpus.delete_chunks(after, new).count() == 1
    with pytest.raises(Exception, match="wrong dimension"):
        corpus.index_chunks(old, new, 3).collect()


SUMMARY = """<sumario><meta><fechaInv>2024-01-30</fechaInv></meta><diario><seccion num="1" nombre="I"><departamento nombre="Ministerio de Hacienda"><epigrafe nombre="Ley"><item id="BOE-A-2024-1"><titulo>Ley 7/2024, de 1.º de Marzo, del IVA</titulo><urlPdf>/p</urlPdf></item></epigrafe></departamento>
<departamento nombre="Otro"><item id="BOE-A-2024-2"><titulo>Anuncio</titulo></item><item id="BOE-A-2024-3"><titulo>Otro</titulo></item></departamento></seccion></diario></sumario>"""


def test_xml_summaries_become_norms(spark):
    rows = gazette.flatten_xml(spark.createDataFrame([(1, SUMMARY), (2, "<broken")], "id int, payload string"))
    got = rows.orderBy("identificador").collect()
    assert [(r["identificador"], r["departamento"], r["epigrafe"], r["fecha"]) for r in got] == [("BOE-A-2024-1", "Ministerio de Hacienda", "Ley", date(2024, 1, 30)), ("BOE-A-2024-2", "Otro", None, date(2024, 1, 30)), ("BOE-A-2024-3", "Otro", None, date(2024, 1, 30))]
    built = gazette.build_norms(ingest.classify(rows)).collect()
    assert [(r["boe_id"], r["kind"], r["enacted_at"], r["effective_from"]) for r in built] == [("BOE-A-2024-1", "ley", date(2024, 3, 1), date(2024, 1, 31))]


def test_enacted_at_falls_back(spark):
    rows = [("Ley 1/2023, de 30 de febrero", date(2024, 1, 1)), ("Orden de 5 de junio", date(2024, 6, 5)), ("sin fecha", date(2024, 1, 1))]
    df = spark.createDataFrame([(t, date(2024, 1, 1)) for t, _ in rows], "t string, d date")
    assert [r[0] for r in df.select(gazette.enacted_at(F.col("t"), F.col("d"))).collect()] == [w for _, w in rows]


def test_document_body_and_hash(spark):
    xml = "<documento><metadatos><texto>m</texto></metadatos><analisis><texto>no</texto></analisis><texto><p>Uno &amp;</p>\n<p>dos</p></texto></documento>"
    r = spark.range(1).select(gazette.document_body(F.lit(xml)).alias("b"), gazette.document_hash(F.lit("<documento><texto> </texto></documento>")).alias("h")).first()
    assert r["b"] == "Uno & dos"


def test_eligibility_and_seeds(spark):
    normas = spark.createDataFrame([("BOE-A-1",), ("BOE-A-2",), ("BOE-A-3",), ("BOCM-1",)], "boe_id string")
    versions = spark.createDataFrame([("BOE-A-1", date(2020, 1, 1), None, "vigente"), ("BOE-A-2", date(2020, 1, 1), None, "derogada"), ("BOCM-1", date(2020, 1, 1), None, "vigente")], "norma_boe_id string, effective_from date, effective_to date, status string")
    got = {r["boe_id"]: r["skip_reason"] for r in gazette.eligible(normas, versions, F.lit(date(2024, 1, 1))).collect()}
    assert got == {"BOE-A-1": None, "BOE-A-2": "status_derogada", "BOE-A-3": "no_version", "BOCM-1": "not_state"}
    pinned = spark.createDataFrame([("N", "a1", date(2024, 1, 1), "h1"), ("N", "a1", date(1990, 1, 1), "h1"), ("N", "a2", date(2024, 1, 1), "h")], "boe_id string, article_id string, day date, content_hash string")
    texts = spark.createDataFrame([("N", "a1", date(2000, 1, 1), None, "h1")], "boe_id string, article_id string, effective_from date, effective_to date, text_hash string")
    assert sorted((r["article_id"], r["day"].year, r["ok"]) for r in gazette.verify_seeds(pinned, texts).collect()) == [("a1", 1990, True), ("a1", 2024, True), ("a2", 2024, False)]


def test_catalogue_searches(spark):
    schema = "id string, name string, description string, tax_year int, region string, scope string, category string, sources array<struct<title:string>>"
    rows = [("m1", "Alquiler", "d", 2024, "Madrid", "autonomico", "deduccion", [("Ley X",)]), ("e1", "Maternidad", None, 2024, None, "estatal", "deduccion", None), ("g1", "Otra", "alquiler joven", 2023, "Galicia", "autonomico", "reduccion", [])]
    df = spark.createDataFrame(rows, schema)
    ids = lambda d: sorted(r["id"] for r in d.collect())
    assert ids(catalog.rule_catalog(df, region="madrid")) == ["e1", "m1"] and ids(catalog.rule_catalog(df, tax_year=2023)) == ["g1"]
    assert ids(catalog.search_rules(df, " ALQUILER ")) == ["g1", "m1"] and ids(catalog.search_rules(df, "ley x")) == ["m1"]
    assert [r["truncated"] for r in catalog.search_rules(df, "a", 1).collect()] == [True]
