"""Rulings of three families: header, sections, tax, criterion, outcome."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foralia.functions import ids, text as tx
from foralia.runtime import materialize, spread

# Header labels, folded, and their canonical names.
TAX_OFFICE_LABELS = {
    "num consulta": "numero", "numero consulta": "numero", "numero de consulta": "numero", "n consulta": "numero", "organo": "organo", "organo sg": "organo",
    "fecha salida": "fecha_salida", "fecha de salida": "fecha_salida", "fecha entrada": "fecha_entrada", "fecha de entrada": "fecha_entrada",
    "normativa": "normativa", "materia": "materia", "asunto": "asunto", "cuestion": "cuestion",
}
COURT_LABELS = {"materia": "materia", "ecli": "ecli", "organo": "organo", "sala": "sala", "seccion": "seccion", "fecha": "fecha", "ponente": "ponente", "numero de resolucion": "numero", "numero de recurso": "recurso", "resumen": "resumen"}
TRIBUNAL_LABELS = {"organo": "organo", "sala": "sala", "sede": "sede", "criterio": "criterio", "numero de resolucion": "numero", "numero": "numero", "unidad resolutoria": "unidad", "fecha": "fecha", "fecha de resolucion": "fecha", "asunto": "asunto", "materia": "materia", "normativa": "normativa", "impuesto": "impuesto"}
# Headings that start sections.
TAX_OFFICE_SECTIONS = {"hechos": r"Descripci[óo]n\s+(?:de\s+)?(?:los\s+)?hechos\b", "cuestion": r"Cuesti[óo]n\s+planteada\b", "contestacion": r"Contestaci[óo]n\s+(?:completa|vinculante)?\b"}
COURT_SECTIONS = {"antecedentes": r"Antecedentes\s+de\s+hecho\b", "fundamentos": r"Fundamentos\s+(?:de|jur[íi]dicos)\b", "fallo": r"Fallo\b|Parte\s+dispositiva\b"}
TRIBUNAL_SECTIONS = {"antecedentes": r"Antecedentes\s+de\s+hecho\b", "fundamentos": r"Fundamentos\s+de\s+derecho\b", "criterio": r"Criterio\s*:?\s*$", "fallo": r"Fallo\b|Acuerda\b"}
# Phrases of each tax, from the most to the least specific, then words that count only whole.
TAX_PHRASES = (
    ("IRNR", ("impuesto sobre la renta de no residentes", "irnr", "ley 5/2004", "no residentes")),
    ("IRPF", ("impuesto sobre la renta de las personas fisicas", "irpf", "ley 35/2006")),
    ("IS", ("impuesto sobre sociedades", "ley 27/2014")),
    ("IVA", ("impuesto sobre el valor anadido", "ley 37/1992")),
    ("IP", ("impuesto sobre el patrimonio", "ley 19/1991")),
    ("ISD", ("impuesto sobre sucesiones y donaciones", "ley 29/1987")),
    ("ITP_AJD", ("transmisiones patrimoniales", "actos juridicos documentados", "rdleg 1/1993", "real decreto legislativo 1/1993")),
    ("IIVTNU", ("incremento de valor de los terrenos", "iivtnu", "plusvalia municipal")),
    ("IBI", ("impuesto sobre bienes inmuebles", "ibi")),
    ("IAE", ("impuesto sobre actividades economicas", "iae")),
    ("LGT", ("ley general tributaria", "ley 58/2003", "procedimiento tributario")),
)
TAX_WORDS = (("IVA", ("iva",)), ("IS", ("is",)), ("IP", ("ip",)), ("ISD", ("isd",)), ("IRPF", ("irpf",)), ("IRNR", ("irnr",)), ("IIVTNU", ("iibtnu", "iivtnu")), ("IBI", ("ibi",)), ("IAE", ("iae",)), ("LGT", ("lgt",)), ("ITP_AJD", ("itp", "ajd")))
# Turns of phrase that introduce a conclusion.
CONCLUSIONS = r"(?iu)\besta\s+Direcci[óo]n\s+General\s+(?:considera|entiende|interpreta|concluye)\b|\bse\s+concluye\s+que\b|\ben\s+consecuencia\b|\bpor\s+(?:lo\s+)?tanto\b|\bdebe\s+concluirse\s+que\b|\bcabe\s+concluir\s+que\b"
OUTCOMES = (("estima_parcial", r"(?iu)\bestima(?:mos|r)?\s+(?:en\s+parte|parcialmente)|\bestimaci[óo]n\s+parcial"), ("desestima", r"(?iu)\bdesestim"), ("inadmite", r"(?iu)\binadmi"), ("estima", r"(?iu)\bestim"), ("archivo", r"(?iu)\barchiv"))


# Matters that are about taxes, tax phrases and acronyms in a ruling's text, all folded.
TAX_MATTERS = (
    "tributari", "fiscal", "impuesto", "irpf", "impuesto sobre la renta", "iva", "impuesto sobre el valor anadido", "impuesto sobre sociedades", "impuesto sobre el patrimonio",
    "sucesiones", "donaciones", "transmisiones patrimoniales", "actos juridicos documentados", "hacienda publica", "haciendas locales", "aeat", "tasa fiscal", "ibi", "iibtnu",
    "plusvalia", "recaudacion", "inspeccion tributaria", "infraccion tributaria", "sancion tributaria",
)
TAX_BODY = (
    "impuesto sobre la renta de las personas fisicas", "impuesto sobre sociedades", "impuesto sobre el valor anadido", "impuesto sobre el patrimonio", "ley general tributaria",
    "agencia estatal de administracion tributaria", "direccion general de tributos", "tribunal economico administrativo", "obligacion tributaria", "deuda tributaria",
    "liquidacion tributaria", "comprobacion limitada", "regularizacion tributaria", "infraccion tributaria", "sancion tributaria", "rendimientos del trabajo",
    "rendimientos de actividades economicas", "ganancia patrimonial", "minimo personal y familiar",
)
TAX_ACRONYMS = ("irpf", "iva", "isd", "iibtnu", "ibi", "ivtm", "icio", "iae", "irnr", "aeat", "lgt")


def _ladder(text: Column, tests, hit) -> Column:
    out = F.lit(None).cast("string")
    for name, values in reversed(tests):
        test = F.lit(False)
        for v in values:
            test = test | hit(text, v)
        out = F.when(test, F.lit(name)).otherwise(out)
    return out


def detect_tax(header: Column, body: Column) -> Column:
    """By phrases in the header, phrases in the body, whole words in the header, whole words in the body; else OTRO."""
    folded = F.struct(tx.normalize(F.coalesce(header, F.lit(""))).alias("head"), tx.normalize(F.coalesce(body, F.lit(""))).alias("rest"))
    phrase, word = lambda t, p: F.contains(t, F.lit(p)), tx.word_in
    ladders = lambda x: [_ladder(x[part], tests, hit) for tests, hit in ((TAX_PHRASES, phrase), (TAX_WORDS, word)) for part in ("head", "rest")]
    return tx.once(folded, lambda x: F.coalesce(*ladders(x), F.lit("OTRO")))


def outcome(text: Column, chars: int, from_end: bool = False) -> Column:
    """The first outcome named in the first (or last) `chars` characters."""
    part = F.right(F.trim(text), F.lit(chars)) if from_end else F.left(text, F.lit(chars))
    return tx.once(part, lambda named: _ladder(named, [(name, (p,)) for name, p in OUTCOMES], lambda t, p: t.rlike(p)))


def criterion(section: Column, limit: int = 1500) -> Column:
    return tx.max_chars(tx.last_with_marker(tx.paragraphs(section), CONCLUSIONS), limit)


def norms_cited(plain: Column, header: Column) -> Column:
    """Norms of the header, then those found in the text; each once, case aside, in order."""
    head = F.filter(F.transform(F.split(F.coalesce(header, F.lit("")), "[\n,]+"), lambda x: F.trim(x)), lambda x: F.length(x) > 5)
    law = r"(?iu)\b(?:Ley|LO|Ley\s+Org[áa]nica|Real\s+Decreto(?:\s+Legislativo|\s+Ley)?|Orden)\s+\d+/\d{2,4}(?:[^.\n]*?\bart(?:[íi]culo|\.)?\s*[\d.]+(?:\s*\.?\s*[a-z]\))?)?"
    alias = r"(?iu)\bart(?:[íi]culo|\.)?\s*[\d.]+(?:\s*\.?\s*[a-z]\))?\s+(?:LIRPF|LIS|LIVA|LGT|LISD|LIP|LIRNR|TRLITP|RIRPF|RIS|RIVA)\b"
    found = lambda p: F.filter(F.transform(F.regexp_extract_all(plain, F.lit(p), F.lit(0)), lambda x: tx.collapse(x)), lambda x: F.length(x) <= 200)
    return tx.dedupe_by(F.concat(head, found(law), found(alias)), lambda x: F.lower(x))


def parse(raw: DataFrame, labels: dict[str, str], sections: dict[str, str], html: str = "html") -> DataFrame:
    """Adds plain, header map and sections map."""
    plain = spread(raw, 4).withColumn("plain", tx.html_to_text(F.coalesce(html, F.lit(""))))
    return plain.withColumn("header", tx.header_fields(F.col("plain"), labels)).withColumn("sections", tx.split_sections(F.col("plain"), sections))


def _get(c: str, key: str) -> Column:
    return F.try_element_at(F.col(c), F.lit(key))


def _listed(values) -> Column:
    return F.array(*(F.lit(v) for v in values))


def classify(header: Column, plain: Column) -> Column:
    """struct<relevance, keywords> of a court ruling: `fiscal` by its matter or the tax section of the chamber, `probable` by tax
    phrases and acronyms of its text, else `no_fiscal`; keywords are those that decided, in the lists' order."""
    field = lambda name: tx.normalize(F.coalesce(F.try_element_at(header, F.lit(name)), F.lit("")))
    named = lambda text, words: F.filter(_listed(words), lambda w: F.contains(text, w))
    chamber = F.coalesce(F.nullif(field("sala"), F.lit("")), field("organo"))
    tax_section = (F.contains(chamber, F.lit("tercera")) | F.contains(chamber, F.lit("contencioso"))) & F.contains(field("seccion"), F.lit("segunda"))
    acronyms = lambda body: F.array_intersect(_listed(TAX_ACRONYMS), F.regexp_extract_all(body, F.lit(r"(?U)\b(?:" + "|".join(TAX_ACRONYMS) + r")\b"), F.lit(0)))
    words = tx.once(tx.normalize(F.coalesce(plain, F.lit(""))), lambda body: F.concat(named(body, TAX_BODY), acronyms(body)))
    none, as_struct = F.expr("cast(array() as array<string>)"), lambda name, keys: F.struct(F.lit(name).alias("relevance"), keys.alias("keywords"))
    by_text = tx.once(words, lambda w: F.when(F.size(w) > 0, as_struct("probable", w)).otherwise(as_struct("no_fiscal", none)))
    matters = tx.once(field("materia"), lambda matter: named(matter, TAX_MATTERS))
    return tx.once(matters, lambda m: F.when(F.size(m) > 0, as_struct("fiscal", m)).when(tax_section, as_struct("fiscal", none)).otherwise(by_text))


def court_organ(code: Column) -> Column:
    """TC, TSJ, TS, AN or AP of a court's code; null for a code of no known court."""
    c = F.upper(F.trim(code))
    return F.when(c.rlike(r"^TC\d*$"), "TC").when(c.startswith("TSJ"), "TSJ").when(c.startswith("TS"), "TS").when(c == "AN", "AN").when(c.startswith("AP"), "AP")


def tribunal_organ(header: Column, number: Column) -> Column:
    """teac, teal or tear by the organ that the header names, else by the number: 00 is the central tribunal's."""
    named = F.lower(F.coalesce(*(F.nullif(F.try_element_at(header, F.lit(k)), F.lit("")) for k in ("organo", "unidad", "sala")), F.lit("")))
    known = F.when(F.contains(named, F.lit("central")), "teac").when(F.contains(named, F.lit("local")), "teal").when(F.contains(named, F.lit("regional")), "tear")
    return F.coalesce(known, F.when(F.left(number, F.lit(2)) == "00", "teac").otherwise("tear"))


def verdict_part(plain: Column) -> Column:
    """From the first FALLO (letters may be spaced), else FALLAMOS, else PARTE DISPOSITIVA to the end; null without any."""
    return F.coalesce(*(F.nullif(F.regexp_extract(plain, rf"(?isU)({p}\b.+)\z", 1), F.lit("")) for p in (r"F\s*A\s*L\s*L\s*O", "FALLAMOS", r"PARTE\s+DISPOSITIVA")))


def tax_office(raw: DataFrame) -> DataFrame:
    """Binding rulings, one row each with `outcome`: ok, or why it is refused; nothing is thrown."""
    p = parse(raw, TAX_OFFICE_LABELS, TAX_OFFICE_SECTIONS)
    number, day = ids.ruling_number(_get("header", "numero")), ids.written_date(_get("header", "fecha_salida"))
    answer = F.coalesce(_get("sections", "contestacion"), F.col("plain"))
    head = F.concat_ws(" ", _get("header", "normativa"), _get("header", "asunto"))
    why = F.when(number.isNull(), "no_number").when(day.isNull(), "no_date").otherwise("ok")
    return p.select(
        *raw.columns, number.alias("numero"), day.alias("fecha_salida"), ids.written_date(_get("header", "fecha_entrada")).alias("fecha_entrada"), detect_tax(head, F.col("plain")).alias("impuesto"),
        _get("header", "asunto").alias("asunto"), _get("sections", "cuestion").alias("cuestion_planteada"), answer.alias("contestacion_completa"), criterion(answer).alias("criterio"),
        norms_cited(F.col("plain"), _get("header", "normativa")).alias("normativa"), F.sha2("plain", 256).alias("content_hash"), why.alias("outcome"),
    )


def court(raw: DataFrame) -> DataFrame:
    """Court rulings with outcome of the verdict, the reasoning's key paragraph and relevance; corpus.ruling_chunks takes those that are ok.

    `organo` is the kind of court that `tribunal_codigo`, the ECLI's code, stands for.
    """
    p = parse(raw, COURT_LABELS, COURT_SECTIONS)
    ident, day = ids.ecli(_get("header", "ecli")), ids.written_date(_get("header", "fecha"))
    verdict = F.coalesce(_get("sections", "fallo"), verdict_part(F.col("plain")), F.col("plain"))
    reasons = tx.paragraphs(F.coalesce(_get("sections", "fundamentos"), F.col("plain")))
    markers = [r"(?iu)\bdoctrina\b", r"(?iu)\bcriterio\b", r"(?iu)\bfijamos\b|\bdeclaramos\b", r"(?iu)\ben\s+consecuencia\b"]
    key = tx.once(reasons, lambda ps: F.coalesce(tx.first_by_marker(ps, markers), F.try_element_at(F.filter(ps, lambda x: F.length(x) > 50), F.lit(-1))))
    code = F.nullif(F.regexp_extract(ident, r"^ECLI:ES:([^:]+)", 1), F.lit(""))
    why = F.when(ident.isNull(), "no_ecli").when(court_organ(code).isNull(), "no_court").when(day.isNull(), "no_date").otherwise("ok")
    judged = classify(F.col("header"), F.col("plain"))
    return p.select(
        *raw.columns, ident.alias("ecli"), code.alias("tribunal_codigo"), court_organ(code).alias("organo"), _get("header", "sala").alias("sala"), _get("header", "seccion").alias("seccion"), day.alias("fecha"),
        _get("header", "numero").alias("numero_resolucion"), F.coalesce(outcome(verdict, 1500), F.lit("otro")).alias("fallo_sentido"), verdict.alias("fallo_texto"), tx.max_chars(key, 1200).alias("ratio_decidendi"),
        _get("header", "resumen").alias("resumen"), judged["relevance"].alias("relevance"), judged["keywords"].alias("keywords"), F.sha2("plain", 256).alias("content_hash"), why.alias("outcome"),
    )


def tribunal(raw: DataFrame) -> DataFrame:
    """Economic-administrative resolutions; the kind is read from the header before the body."""
    p = parse(raw, TRIBUNAL_LABELS, TRIBUNAL_SECTIONS)
    number, day = ids.claim_number(_get("header", "numero")), ids.written_date(_get("header", "fecha"))
    kinds = [("unifica_criterio", (r"(?iu)unificaci[óo]n\s+de\s+criterio|unifica\s+criterio",)), ("extiende_efectos", (r"(?iu)extensi[óo]n\s+de\s+efectos|extiende\s+efectos",)), ("procedimiento_especial", (r"(?iu)procedimiento\s+especial",))]
    head, match = F.left("plain", F.lit(1500)), lambda t, v: t.rlike(v)
    kind = F.coalesce(_ladder(head, kinds, match), _ladder(F.col("plain"), kinds, match), F.lit("ordinaria"))
    organ = tribunal_organ(F.col("header"), number)
    seat = F.coalesce(*(F.nullif(_get("header", k), F.lit("")) for k in ("sede", "organo", "unidad", "sala")))
    why = F.when(number.isNull(), "no_number").when(day.isNull(), "no_date").otherwise("ok")
    return p.select(
        *raw.columns, number.alias("numero"), organ.alias("organo"), seat.alias("sede"), day.alias("fecha"), kind.alias("tipo"), F.coalesce(outcome(F.col("plain"), 2000, True), F.lit("otro")).alias("sentido"),
        detect_tax(F.concat_ws(" ", _get("header", "normativa"), _get("header", "materia"), _get("header", "asunto")), F.col("plain")).alias("impuesto"), _get("header", "asunto").alias("asunto"),
        F.coalesce(tx.max_chars(_get("sections", "criterio"), 1500), criterion(F.col("plain"))).alias("criterio"), norms_cited(F.col("plain"), _get("header", "normativa")).alias("normativa"), F.sha2("plain", 256).alias("content_hash"), why.alias("outcome"),
    )


def chunks_of(courts: DataFrame, offices: DataFrame, tribunals: DataFrame) -> DataFrame:
    """Corpus chunks of the three families straight from raw pages (html); pages whose outcome is not ok have none.

    Pages are parsed once into a table: filters on what was parsed would otherwise be pushed below the parsing and repeat it.
    """
    from foralia.operators import corpus

    ok = lambda rows: materialize(rows, "rulings").where("outcome = 'ok'")
    relevant = ok(court(courts)).where("relevance <> 'no_fiscal'")
    return corpus.corpus_chunks(corpus.ruling_chunks(relevant), corpus.tax_office_chunks(ok(tax_office(offices))), corpus.tribunal_chunks(ok(tribunal(tribunals))))
