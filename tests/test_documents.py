import json
import os
import re
from datetime import date

import pytest
from pyspark.sql import functions as F

from foralia.functions import ids
from foralia.functions import text as tx
from foralia.operators import calendar, chunking, citations, doctrine, drift, ingest, legal_xml, manuals, retrieval, rulings, vat
from foralia.sources import catalogues, documents, store
from foralia.streaming import incremental


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "x string").select(expression(F.col("x"))).first()[0]


@pytest.mark.parametrize(("function", "raw", "want"), [
    (ids.ecli, " ecli:es:ts:2024:1234.S2 ", "ECLI:ES:TS:2024:1234"), (ids.ecli, "ECLI:FR:X:2024:1", None), (ids.ruling_number, "V123-2024", "V0123-24"), (ids.ruling_number, "v12345-24", "V12345-24"),
    (ids.ruling_number, "C0001-24", None), (ids.claim_number, "0/12345/23", "00/12345/2023"), (ids.claim_number, "28/123456/2024/1/02", "28/123456/2024/01/02"), (ids.claim_number, "R.G. 77/2022", "00/00077/2022"),
    (ids.claim_number, "nada", None), (ids.written_date, "a 3 de Marzo de 2024.", date(2024, 3, 3)), (ids.written_date, "05/11/2023", date(2023, 11, 5)), (ids.written_date, "31 de febrero de 2024", None),
    (ids.gazette_date, "20240130", date(2024, 1, 30)), (ids.gazette_date, "30/01/2024", date(2024, 1, 30)), (tx.fold_accents, "Señor ÁÉÜ", "senor aeu"), (tx.fold_any, "ấ Ž", "a z"),
    (tx.decode_entities, "a&amp;b &#8364; &lt;x&gt; &zz;", "a&b € <x> &zz;"), (tx.subject_key, "Dietas, de  Manutención IRPF", "dietas de manutención irpf"),
])
def test_scalars(spark, function, raw, want):
    assert one(spark, raw, function) == want


@pytest.mark.parametrize(("function", "raw", "want"), [
    (ids.ruling_number, "V123456-24", "V123456-24"), (ids.ruling_number, "v 000123456789 - 2024", "V123456789-24"), (ids.ruling_number, "V-24", None),
    (ids.claim_number, "R.G. 12345678/23", "00/12345678/2023"), (ids.claim_number, "28/12345678/2024", "28/12345678/2024"),
])
def test_numbers_of_any_length(spark, function, raw, want):
    assert one(spark, raw, function) == want


def test_parsed_values_are_read_once(spark):
    """Lambdas that name a parsed value do not parse it again: a plan's text holds each reading once."""
    df = spark.createDataFrame([("Asunto: uno\nOtro\nAsunto: dos",)], "x string")

    def readings(expression, pattern):
        out = df.select(expression(F.col("x")).alias("r"))
        return out._jdf.queryExecution().analyzed().toString().count(pattern)

    assert readings(lambda x: tx.header_fields(x, {"asunto": "asunto"}), "split(") == 1
    assert readings(lambda x: tx.split_sections(x, {"a": "Asunto"}), "split(") == 1
    assert readings(lambda x: tx.last_with_marker(tx.paragraphs(x), "z"), "split(") == 1
    assert readings(lambda x: tx.decode_entities(F.upper(x)), "upper(") == 1
    assert readings(lambda x: rulings.detect_tax(F.lit(""), F.upper(x)), "upper(") == 1
    assert one(spark, "Asunto: uno\nOtro\nAsunto: dos", lambda x: tx.header_fields(x, {"asunto": "asunto"})) == {"asunto": "dos"}
    assert one(spark, "&#8364;&#128512;x&#0;&#55296;&#1114112;&#12", tx.decode_entities) == "€😀x\0&#55296;&#1114112;&#12"


def test_small_files_are_parsed_by_all_cores(spark):
    rows = spark.createDataFrame([(1, "<p>x</p>")], "id int, html string").coalesce(1)
    assert rulings.parse(rows, {"asunto": "asunto"}, {"a": "Asunto"}).rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism


def test_filters_do_not_repeat_the_reading_of_versions(spark):
    xml = '<bloque id="a1" tipo="precepto"><version fecha_vigencia="20100101"><p>Uno &#8364;</p></version><version fecha_vigencia="x"><p>Dos</p></version><version fecha_vigencia="20200101"><p> </p></version></bloque>'
    found = legal_xml.article_versions(spark.createDataFrame([(1, xml)], "k int, xml string"), ["k"])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("</p>, 0") == 1 and "Python" not in plan
    assert [(r["effective_from"], r["text"]) for r in found.collect()] == [(date(2010, 1, 1), "Uno €")]


def test_small_catalogues_do_not_shuffle_citations(spark):
    """All citations of a law would meet in one task; and answers are searched once for each of verify and ground."""
    texts = spark.createDataFrame([(1, "art. 7 de la LIRPF"), (2, "nada"), (3, "BOE-A-2006-1")], "id int, text string")
    norms = spark.createDataFrame([("BOE-A-2006-20764",)], "boe_id string")
    versions = spark.createDataFrame([("BOE-A-2006-20764", date(2007, 1, 1), None, "vigente")], "norma_boe_id string, effective_from date, effective_to date, status string")
    pins = citations.documented(spark.createDataFrame([("BOE-A-2006-20764", "art. 7")], "boe_id string, article string"))
    issues = citations.verify(texts, "id", F.lit(date(2024, 1, 1)), norms, versions, pins, this_year=2024)
    plan = issues._jdf.queryExecution().executedPlan().toString()
    assert plan.split("ArrowEvalPython")[0].count("BroadcastHashJoin") == 2
    assert {(r["id"], r["verdict"]) for r in citations.verdicts(issues, "id", texts).collect()} == {(1, "safe"), (2, "safe"), (3, "block")}
    contexts = spark.createDataFrame([(1, ["la lirpf, art. 7 "]), (3, ["x"])], "id int, bodies array<string>")
    grounded = citations.ground(texts, contexts, "id", text="text")
    found = citations.grounding(issues, "id", spark.createDataFrame([(1, "c"), (4, "d")], "id int, chunk_id string"), grounded)
    assert found._jdf.queryExecution().executedPlan().toString().count("search(") == 2
    assert {(r["id"], r["verdict"], *r["problems"]) for r in found.collect()} == {(1, "safe"), (3, "block", "BLOCKED_NOT_IN_CONTEXT 0"), (4, "safe")}


def test_article_key(spark):
    rows = [("art. 81 bis 2", ("81", "bis")), ("Artículo 7", ("7", None)), ("a57", ("57", None)), ("boe:da-4", None)]
    df = spark.createDataFrame([(a,) for a, _ in rows], "a string").select(ids.article_key(F.col("a")).alias("k"))
    assert [r["k"] and tuple(r["k"]) for r in df.collect()] == [w for _, w in rows]


RULING = """<table><tr><td>Núm. Consulta</td><td>V0123-24</td></tr><tr><td>Fecha salida</td><td>5 de febrero de 2024</td></tr><tr><td>Normativa</td><td>Ley 35/2006 art. 7, LIRPF art. 17</td></tr>
<tr><td>Asunto</td><td>Dietas &amp; viajes</td></tr></table><p>Descripción de hechos: un viaje.</p><p>Cuestión planteada: ¿tributa?</p><p>Contestación completa: El art. 9 RIRPF regula.</p>
<p></p><p>En consecuencia, las dietas quedan exentas con los límites que marca el reglamento del impuesto.</p><p></p><p>Lo que comunico con efectos vinculantes.</p>"""


def test_tax_office_ruling(spark):
    df = spark.createDataFrame([(1, RULING), (2, "<p>vacío</p>"), (3, None)], "id int, html string")
    got = {r["id"]: r for r in rulings.tax_office(df).collect()}
    r = got[1]
    assert (r["numero"], r["fecha_salida"], r["impuesto"], r["asunto"], r["outcome"]) == ("V0123-24", date(2024, 2, 5), "IRPF", "Dietas & viajes", "ok")
    assert r["cuestion_planteada"].startswith("Cuestión planteada") and r["criterio"].startswith("En consecuencia")
    assert r["normativa"][:2] == ["Ley 35/2006 art. 7", "LIRPF art. 17"] and "art. 9 RIRPF" in r["normativa"]
    assert got[2]["outcome"] == got[3]["outcome"] == "no_number"


def test_court_and_tribunal(spark):
    html = "<p>ECLI: ECLI:ES:TS:2024:99</p><p>Sala: Tercera</p><p>Fecha: 01/02/2024</p><p>Fundamentos de derecho</p><p></p><p>Fijamos como criterio interpretativo que la renta no se integra en la base del ejercicio.</p><p></p><p>FALLO</p><p>Estimamos parcialmente el recurso.</p>"
    r = rulings.court(spark.createDataFrame([(html,)], "html string")).first()
    assert (r["ecli"], r["organo"], r["sala"], r["fallo_sentido"], r["outcome"]) == ("ECLI:ES:TS:2024:99", "TS", "Tercera", "estima_parcial", "ok")
    assert r["ratio_decidendi"].startswith("Fijamos")
    html = "<p>Número de resolución: 00/12345/2023</p><p>Fecha: 3 de mayo de 2023</p><p>Asunto: IVA. Unificación de criterio</p><p>Criterio:</p><p>El IVA no se devuelve.</p><p>Fallo</p><p>Acuerda DESESTIMAR.</p>"
    r = rulings.tribunal(spark.createDataFrame([(html,)], "html string")).first()
    assert (r["numero"], r["organo"], r["tipo"], r["sentido"], r["impuesto"], r["outcome"]) == ("00/12345/2023", "teac", "unifica_criterio", "desestima", "IVA", "ok")


def test_citations_have_places_and_norms(spark):
    text = "Según el art. 81 bis de la LIRPF y BOE-A-2014-12328, la DGT en V123-24 y el TEAC (R.G. 5/22) opinan; STS 12/2020."
    r = citations.associate(citations.extract(spark.createDataFrame([(text,), (None,)], "text string"))).collect()
    got = r[0]["citations"]
    assert all(text[c["start"] : c["stop"]] == c["raw"] for c in got)
    assert [(c["kind"], c["boe_id"], c["canonical"]) for c in got] == [
        ("article", "BOE-A-2006-20764", None), ("alias", "BOE-A-2006-20764", None), ("boe_state", "BOE-A-2014-12328", None),
        ("jurisprudence", None, "V0123-24"), ("jurisprudence", None, "00/00005/2022"), ("jurisprudence", None, None),
    ]
    assert r[1]["citations"] == []
    assert citations.find("el 30/01/2024", dates_as_claims=False) == [] and len(citations.find("el 30/01/2024")) == 1


def test_verify_and_ground(spark):
    texts = spark.createDataFrame([(1, "art. 7 LIRPF"), (2, "art. 8 LIRPF"), (3, "BOE-A-2099-1"), (4, "Ley 9/1999"), (5, "LIS"), (6, "sin citas")], "id int, text string")
    normas = spark.createDataFrame([("BOE-A-2006-20764",), ("BOE-A-2014-12328",)], "boe_id string")
    versions = spark.createDataFrame([("BOE-A-2006-20764", date(2007, 1, 1), None, "vigente"), ("BOE-A-2014-12328", date(2015, 1, 1), None, "derogada")], "norma_boe_id string, effective_from date, effective_to date, status string")
    pins = citations.documented(spark.createDataFrame([("BOE-A-2006-20764", "art. 7")], "boe_id string, article string"))
    issues = citations.verify(texts, "id", F.lit(date(2024, 1, 1)), normas, versions, pins)
    assert {(r["id"], r["code"]) for r in issues.where("code is not null").collect()} == {(2, "ARTICLE_NOT_IN_CORPUS"), (3, "SUSPICIOUS_YEAR"), (4, "UNRESOLVED_LAW"), (5, "NOT_IN_FORCE")}
    assert dict(map(tuple, citations.verdicts(issues, "id", texts).collect())) == {1: "safe", 2: "block", 3: "block", 4: "warn", 5: "block", 6: "safe"}
    got = citations.ground(spark.createDataFrame([(1, "art. 7 y V0001-24")], "id int, answer string"), spark.createDataFrame([(1, ["El ART. 7 dice"])], "id int, bodies array<string>"), "id")
    assert [r["grounded"] for r in got.orderBy("place").collect()] == [True, False]


def test_retrieval_against_plain_python(spark):
    import math

    docs = ["el perro come", "el gato come pescado pescado", "nada", "", "pescado"]
    chunks = spark.createDataFrame([(k, t, [float(k), 1.0]) for k, t in enumerate(docs)], "chunk_id int, text string, embedding array<double>")
    queries = spark.createDataFrame([(1, "pescado el pescado", [1.0, 0.0]), (2, "zzz", [0.0, 0.0])], "query_id int, text string, embedding array<double>")
    bags = [re.findall(r"\w+", t) for t in docs]
    avg = sum(map(len, bags)) / len(bags)
    score = lambda b: sum(math.log((5 - df + 0.5) / (df + 0.5) + 1) * b.count(t) * 2.5 / (b.count(t) + 1.5 * (0.25 + 0.75 * len(b) / avg)) for t in ["pescado", "el", "pescado"] for df in [sum(t in x for x in bags)] if t in b)
    want = {k: score(b) for k, b in enumerate(bags) if score(b) > 0}
    got = {r["chunk_id"]: r["score"] for r in retrieval.bm25(chunks, queries).collect()}
    assert got == pytest.approx(want)
    near = [(r["query_id"], r["chunk_id"]) for r in retrieval.dense(chunks, queries, 2).orderBy("query_id", "rank").collect()]
    assert near == [(1, 4), (1, 3), (2, 0), (2, 1)]
    both = retrieval.hybrid(chunks, queries, top=3).where("query_id = 1").orderBy("rank").collect()
    assert both[0]["chunk_id"] == 4 and all(r["score"] <= 2 / 61 for r in both)
    assert retrieval.hybrid(chunks, queries, min_score=0.5).count() == 0
    v = spark.range(1).select(retrieval.dense_vector(retrieval.hash_embedding(F.lit("hola hola mundo")), 1024).alias("v")).first()["v"]
    assert v[475] == pytest.approx(2 / math.sqrt(5)) and sum(x * x for x in v) == pytest.approx(1)
    assert retrieval.build_context(both_rows(spark, both, docs)).first()["context"].startswith("[1] norma | 4\npescado\n\n[2]")


def both_rows(spark, found, docs):
    return spark.createDataFrame([(r["query_id"], r["rank"], "norma", str(r["chunk_id"]), docs[r["chunk_id"]]) for r in found], "query_id int, rank int, source_type string, chunk_id string, text string")


def test_doctrine(spark):
    rows = [("1", "TC", None, "x", "a"), ("2", "TS", "3", "x", "Dietas IRPF"), ("3", "TS", "3", "x", "dietas irpf"), ("4", "TS", "4", "x", "dietas irpf"), ("5", "XX", "4", "x", None)]
    df = doctrine.ruling_weights(spark.createDataFrame(rows, "id string, organo string, sala string, fallo_sentido string, resumen string")).withColumn("tier", doctrine.court_tier(F.col("organo")))
    assert {r["id"]: (r["weight"], r["tier"]) for r in df.collect()} == {"1": ("binding", 10), "2": ("consolidated", 20), "3": ("consolidated", 20), "4": ("isolated", 20), "5": ("isolated", 40)}
    rows = [("1", "teac", "ordinaria"), ("2", "tear", "ordinaria"), ("3", "teac", "unifica_criterio")]
    df = doctrine.tribunal_weights(spark.createDataFrame([(*r, "IVA", "estima", "a") for r in rows], "id string, organo string, tipo string, impuesto string, sentido string, asunto string"))
    assert {r["id"]: r["weight"] for r in df.collect()} == {"1": "consolidated", "2": "isolated", "3": "binding"}


def test_classify_and_breakdown(spark):
    rows = [(1, "Ministerio de Hacienda", "Orden", "Modelo 100"), (2, "Jefatura del Estado", "Ley", "administrativa"), (3, "Jefatura del Estado", "Ley", "del IVA"), (4, "Ministerio de Hacienda", "Anuncios", "IVA"), (5, "Ministerio de Hacienda", "Ley", "Fiscalía"), (6, None, None, None)]
    got = {r["id"]: (r["relevance"], r["kind"]) for r in ingest.classify(spark.createDataFrame(rows, "id int, departamento string, epigrafe string, titulo string")).collect()}
    assert got == {1: ("fiscal", "orden_ministerial"), 2: ("no_fiscal", "ley"), 3: ("probable", "ley"), 4: ("no_fiscal", None), 5: ("no_fiscal", "ley"), 6: ("no_fiscal", None)}
    assert {r["c"]: r["n"] for r in ingest.breakdown(spark.createDataFrame([("a",), ("a",), ("z",)], "c string"), "c", ["a", "b"]).collect()} == {"a": 2, "b": 0}


def test_upserts_on_disk_are_idempotent(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    rows = lambda *x: spark.createDataFrame(list(x), "k int, content_hash string, year int")
    outcome = lambda df: {r["outcome"]: r["n"] for r in df.collect()}
    assert outcome(store.upsert(path, rows((1, "a", 1), (2, "b", 2), (1, "z", 3)), ["k"], partition_by=["year"])) == {"added": 2}
    assert outcome(store.upsert(path, rows((1, "a", 1), (2, "c", 2)), ["k"], partition_by=["year"])) == {"duplicate": 1, "conflict": 1}
    assert sorted(map(tuple, spark.read.parquet(path).select("k", "content_hash").collect())) == [(1, "a"), (2, "c")]
    store.append_log(f"{path}-log", rows((1, "a", 1), (2, "b", 2)))
    store.append_log(f"{path}-log", rows((3, "c", 3)))
    assert [r["k"] for r in store.recent(spark, f"{path}-log", "year", 2).collect()] == [3, 2]


def test_texts_are_searched_once(spark):
    found = citations.extract(spark.createDataFrame([("Ley 35/2006",)], "text string")).select(F.explode("citations"))
    assert found._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def test_an_upsert_that_died_leaves_the_old_table(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = lambda *xs: spark.createDataFrame(xs, "k long, content_hash string")
    store.upsert(path, rows((1, "a")), ["k"])
    os.rename(path, path + store.OLD)
    os.mkdir(path + store.NEW)
    assert [r["k"] for r in store.current(spark, path).collect()] == [1]
    store.upsert(path, rows((2, "b")), ["k"])
    assert {r["k"] for r in store.current(spark, path).collect()} == {1, 2}
    assert sorted(x.name for x in tmp_path.iterdir()) == ["store"]


def test_stream_upsert(spark, tmp_path):
    source, path = str(tmp_path / "in"), f"file://{tmp_path}/out"
    schema = "k int, content_hash string"
    for batch in ([(1, "a"), (2, "b")], [(2, "b"), (3, "c")]):
        spark.createDataFrame(batch, schema).write.mode("append").parquet(source)
        incremental.stream_upsert(spark.readStream.schema(schema).parquet(source), path, str(tmp_path / "cp"), ["k"]).awaitTermination(120)
    assert sorted(map(tuple, spark.read.parquet(path).select("k", "content_hash").collect())) == [(1, "a"), (2, "b"), (3, "c")]


def test_drift_and_impact(spark):
    prev = spark.createDataFrame([("N", "a1", "x"), ("N", "a2", "y"), ("N", "a3", "z")], "boe_id string, block string, hash string")
    now = spark.createDataFrame([("N", "a1", "x"), ("N", "a2", "Y"), ("N", "a4", "w"), ("M", "a1", "q")], "boe_id string, block string, hash string")
    got = {(r["block"], r["kind"]) for r in drift.bootstrap_or_drift(prev, now, "boe_id", ["block"]).collect()}
    assert got == {("a2", "modified"), ("a3", "removed"), ("a4", "added")}
    carriers = spark.createDataFrame([("r1", [("N", "art. 2")]), ("r2", [("N", "artículo 2 bis"), ("N", "a2")])], "id string, sources array<struct<boe_id:string,article:string>>")
    index = drift.impact_index(carriers)
    asked = spark.createDataFrame([("N", ("2", None)), ("N", ("9", None))], "boe_id string, article struct<number:string,suffix:string>")
    hits = {r["article"]["number"]: r["carriers"] for r in drift.analyze_impact(asked.where("article.number = '9'"), index).collect()}
    assert hits == {"9": []}
    assert {(r["article"]["number"], r["article"]["suffix"]): r["carriers"] for r in index.collect()} == {("2", None): ["r1", "r2"], ("2", "bis"): ["r2"]}
    a = drift.fingerprint(prev, prev.columns).first()[0]
    assert a == drift.fingerprint(prev.repartition(7), prev.columns).first()[0] != drift.fingerprint(now, now.columns).first()[0]


XML = """<r><bloque id="t1" tipo="encabezado" titulo="TÍTULO I"><version/></bloque><bloque id="a1" tipo="precepto" titulo="Artículo 1">
<version fecha_vigencia="20070101" fecha_vigencia_fin="20141231"><p class="articulo">Artículo 1.</p><p class="parrafo">Viejo &amp; <b>bueno</b></p></version>
<version fecha_vigencia="20150101"><p class="parrafo">Nuevo</p><p class="nota_pie">Redactado por BOE-A-2014-12327</p></version><version><p>sin fecha</p></version></bloque></r>"""


def test_legal_xml(spark):
    df = spark.createDataFrame([("N", XML)], "boe_id string, xml string")
    v = legal_xml.article_versions(df, ["boe_id"]).orderBy("effective_from")
    assert [(r["text"], r["effective_to"], r["modified_by"]) for r in v.collect()] == [("Artículo 1.\nViejo & bueno", date(2014, 12, 31), None), ("Nuevo", None, "BOE-A-2014-12327")]
    assert legal_xml.block_hashes(v, ["boe_id"], F.lit(date(2010, 1, 1))).first()["hash"] == v.first()["text_hash"]
    assert legal_xml.block_hashes(v, ["boe_id"], F.lit(date(2000, 1, 1))).count() == 0


def test_clauses_context_and_packing(spark):
    got = one(spark, "Artículo 7. Son: \n1. Uno: a) x. b) y.\n2. Dos.", lambda x: chunking.clauses(x))
    assert [r["number"] for r in got] == [None, "1", "1.a)", "1.b)", "2"]
    parts = [" ".join(["w"] * n) for n in (10, 20, 50, 3, 120, 70, 40)]
    def slow(ps, target, most):
        out, buf, n = [], [], 0
        for p in ps:
            k = len(p.split())
            if k > most and not buf:
                out.append(p)
            elif buf and n + k > most:
                out.append("\n\n".join(buf))
                buf, n = [p], k
            else:
                buf, n = [*buf, p], n + k
                if n >= target:
                    out.append("\n\n".join(buf))
                    buf, n = [], 0
        return out + (["\n\n".join(buf)] if buf else [])

    df = spark.createDataFrame([(parts,)], "p array<string>")
    for target, most in ((60, 100), (400, 800), (1, 2)):
        assert df.select(chunking.greedy_pack(F.col("p"), target, most)).first()[0] == slow(parts, target, most)


def test_manual_pages_and_faqs(spark, tmp_path):
    text = "Portada del manual\nCapítulo 1. Rentas\nTexto de ren-\ndimientos.\n\nOtro párrafo.\fSección 1. Trabajo\nSueldos.\nCapítulo 2. Ahorro\nIntereses."
    (tmp_path / "m.txt").write_text(text)
    files = documents.whole_files(spark, str(tmp_path))
    assert [r["name"] for r in files.collect()] == ["m"]
    got = manuals.manual_chunks(manuals.pages(files)).orderBy("pos").collect()
    assert [(r["title"], r["capitulo"], r["seccion"], r["page_number"]) for r in got] == [(None, None, None, 1), ("Capítulo 1. Rentas",) * 2 + (None, 1), ("Sección 1. Trabajo", "Capítulo 1. Rentas", "Sección 1. Trabajo", 2), ("Capítulo 2. Ahorro",) * 2 + (None, 2)]
    assert "rendimientos" in got[1]["content"]
    html = "<p>Pregunta: ¿Uno?</p><p>Respuesta: Sí.</p><p>Normativa: Ley 1/2000; Ley 2/2000</p><p>Pregunta: ¿Dos?</p><p>Respuesta: No.</p>"
    got = manuals.faqs(spark.createDataFrame([(1, html)], "id int, html string"), ["id"]).orderBy("pos").collect()
    assert [(r["question"], r["answer"], r["norms"]) for r in got] == [("¿Uno?", "Sí.", ["Ley 1/2000", "Ley 2/2000"]), ("¿Dos?", "No.", [])]


def test_catalogues_quarantine_and_uniqueness(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"scales": [
        {"id": "ok", "tax_year": 2024, "scope": "estatal", "component": "general", "brackets": [{"up_to": 1, "rate": 0.1}, {"up_to": None, "rate": 0.2}], "effective_from": "2024-01-01"},
        {"id": "bad", "tax_year": 2024, "scope": "autonomico", "component": "general", "brackets": [{"up_to": 5, "rate": 0.1}, {"up_to": 2, "rate": 1.2}], "effective_from": "2024-01-01"},
    ]}))
    good, bad = catalogues.load_scales(spark, str(tmp_path))
    assert [r["id"] for r in good.collect()] == ["ok"] and bad.first()["problems"] == ["rates", "not increasing", "no region"]
    (tmp_path / "t.json").write_text((tmp_path / "s.json").read_text())
    with pytest.raises(ValueError, match="duplicate"):
        catalogues.load_scales(spark, str(tmp_path))


def test_fetched_documents_turn_failures_into_rows(spark):
    def fetch(ident):
        if ident == "b":
            raise OSError("gone")
        return ident * 2

    documents.register_fetcher(spark, fetch)
    got = {r["id"]: (r["payload"], r["error"]) for r in spark.read.format("fetched").option("ids", "a,b,c").load().collect()}
    assert got == {"a": ("aa", None), "b": (None, "OSError: gone"), "c": ("cc", None)}


def test_calendar_and_vat(spark):
    events = spark.createDataFrame([("100", "annual_jun_30", ["p"]), ("111", "quarterly_20", ["a"])], "code string, schedule string, applicable_to array<string>")
    got = calendar.upcoming(events, F.lit(date(2024, 6, 28)), 2024, 30, ["p", "a"]).collect()
    assert [(r["code"], r["deadline"], r["period"], r["days_left"]) for r in got] == [("100", date(2024, 7, 1), "Ejercicio 2023", 3), ("111", date(2024, 7, 22), "2T 2024", 24)]
    r = calendar.fiscal_years(spark, F.lit(date(2024, 5, 1))).first()
    assert (r["in_progress"], r["closed"], r["declarable"], r["campaign_open"]) == (2024, 2023, 2023, True)
    ops = spark.createDataFrame([("a", "Entrega de pan común", ["harina"])], "code string, description string, keywords array<string>")
    assert vat.lookup(ops, F.lit("PAN comun harina")).count() == 1 and vat.lookup(ops, F.lit("pan vino")).count() == 0
    q = vat.vat_quota(spark.createDataFrame([("a", 10.05), ("x", 5.0)], "code string, base double"), spark.createDataFrame([("a", 0.1), ("x", None)], "code string, rate double"))
    assert {r["code"]: r["quota"] for r in q.collect()} == {"a": 1.01, "x": None}
