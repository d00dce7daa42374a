"""Queries of the redaction engine over the bundled tables, and their SQL.

Test values for shapes the tables lack are built from integer keys, alike in
both engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


from . import oracle
from .catalog import BALANCED, FULL, LABELS, RULES, SOFT, level_of
from .functions import text as fx
from .operators import language, registry, spans, splice, structure, tabular, units
from .plans.anonymize import Anonymizer, anonymize_texts


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.document_units(units.spread(_table(spark, sf_dir, "documents").select("doc_id", "text")))


def units_with_context(spark, sf_dir):
    return _units(spark, sf_dir).select("doc_id", F.col("unit_seq").cast("long").alias("unit_seq"), "text", "context")


def units_distinct(spark, sf_dir):
    rows = units.split_lines(_table(spark, sf_dir, "documents")).withColumn("context", F.lit(""))
    return units.distinct_units(rows).select("doc_id", F.col("unit_seq").cast("long").alias("unit_seq"), F.col("times").cast("long").alias("times"), F.length("text").cast("long").alias("n_chars"))


def _rule_matches(spark, sf_dir, kind):
    rules = [(k, r) for k, r in enumerate(RULES) if r.kind == kind]
    rows = _units(spark, sf_dir).withColumn("s", F.explode(spans.detect(fx.guarded(F.col("text")), F.col("context"), FULL, rules)))
    return rows.select("doc_id", F.col("unit_seq").cast("long").alias("unit_seq"), F.col("s.start").cast("long").alias("start"), F.col("s.text").alias("value"))


def detect_email(spark, sf_dir):
    return _rule_matches(spark, sf_dir, "EMAIL").select("doc_id", "unit_seq", "value")


def detect_ip(spark, sf_dir):
    return _rule_matches(spark, sf_dir, "IP").select("doc_id", "unit_seq", "value")


def detect_card(spark, sf_dir):
    return _rule_matches(spark, sf_dir, "CARD").select("doc_id", "unit_seq", F.regexp_replace("value", "[^0-9]", "").alias("digits"))


def detect_url(spark, sf_dir):
    rules = [(k, r) for k, r in enumerate(RULES) if r.kind == "URL" and r.level == BALANCED]
    rows = _table(spark, sf_dir, "pages").withColumn("s", F.explode(spans.detect(fx.guarded(F.col("url")), F.lit(""), FULL, rules)))
    return rows.select("page_id", F.col("s.text").alias("value"))


def spans_by_kind_level(spark, sf_dir):
    """One detection with all rules; each level keeps the spans of its own rules before overlaps are resolved."""
    found = _units(spark, sf_dir).select(fx.once(spans.detect(fx.guarded(F.col("text")), F.col("context"), FULL)).alias("f")).where(F.size("f") > 0)
    kinds = lambda rank: F.transform(spans.resolve_overlaps(spans.at_level(F.col("f"), rank)), lambda s: s["kind"])
    each = found.select(F.explode(F.array(*(F.struct(F.lit(n).alias("level"), kinds(level_of(n)).alias("kinds")) for n in ("soft", "balanced", "full")))).alias("e"))
    return each.select("e.level", F.explode("e.kinds").alias("kind")).groupBy("kind", "level").agg(F.count("*").alias("n")).select("kind", "n", "level")


_CUSTOMER_KEYS = "SELECT c_custkey AS k FROM customer"
_DNI_SQL = "substr('TRWAGMYFPDXBNJZSQVHLCKE', CAST((k * 7919 % 100000000) % 23 AS INT) + 1, 1)"


def _keys(spark, sf_dir):
    return _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))


def _eight(k):
    return F.lpad((k * 7919 % 100_000_000).cast("string"), 8, "0")


def valid_dni(spark, sf_dir):
    """Every other key gets its right letter."""
    k = F.col("k")
    right = F.substring(F.lit("TRWAGMYFPDXBNJZSQVHLCKE"), ((k * 7919 % 100_000_000) % 23).cast("int") + 1, F.lit(1))
    value = F.concat(_eight(k), F.when(k % 2 == 0, right).otherwise("A"))
    return _keys(spark, sf_dir).select("k", value.alias("value")).withColumn("valid", fx.valid_dni(F.col("value")))


def valid_nie(spark, sf_dir):
    k = F.col("k")
    value = F.concat(F.substring(F.lit("XYZ"), (k % 3).cast("int") + 1, F.lit(1)), F.lpad((k * 104_729 % 10_000_000).cast("string"), 7, "0"), F.substring(F.lit("TRWAGMYFPDXBNJZSQVHLCKE"), (k % 23).cast("int") + 1, F.lit(1)))
    return _keys(spark, sf_dir).select("k", value.alias("value")).withColumn("valid", fx.valid_nie(F.col("value")))


def valid_rut(spark, sf_dir):
    k = F.col("k")
    value = F.concat(_eight(k), F.lit("-"), F.substring(F.lit("0123456789K"), (k % 11).cast("int") + 1, F.lit(1)))
    return _keys(spark, sf_dir).select("k", value.alias("value")).withColumn("valid", fx.valid_rut(F.col("value")))


def valid_cif(spark, sf_dir):
    k = F.col("k")
    value = F.concat(F.substring(F.lit("ABCDEFGHJNPQRSUVW"), (k % 17).cast("int") + 1, F.lit(1)), F.lpad((k * 104_729 % 10_000_000).cast("string"), 7, "0"), F.when(k % 2 == 0, (k % 10).cast("string")).otherwise(F.substring(F.lit("JABCDEFGHI"), (k % 10).cast("int") + 1, F.lit(1))))
    return _keys(spark, sf_dir).select("k", value.alias("value")).withColumn("valid", fx.valid_cif(F.col("value")))


def valid_iban(spark, sf_dir):
    k = F.col("k")
    value = F.concat(F.lit("ES"), F.lpad((k % 97).cast("string"), 2, "0"), F.lpad((k * 7919).cast("string"), 20, "0"))
    return _keys(spark, sf_dir).select("k", value.alias("value")).withColumn("valid", fx.valid_iban(F.col("value")))


def valid_luhn(spark, sf_dir):
    k = F.col("k")
    value = F.concat(F.lit("4"), F.lpad((k * 7919).cast("string"), 15, "0"))
    return _keys(spark, sf_dir).select("k", value.alias("value")).withColumn("valid", fx.valid_luhn(F.col("value")))


def detect_lang(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return docs.select("doc_id", language.vote(F.col("text"), "es").alias("lang"))


def entity_first_seen(spark, sf_dir):
    rows = _rule_matches(spark, sf_dir, "EMAIL").unionByName(_rule_matches(spark, sf_dir, "IP"))
    kinds = rows.withColumn("kind", F.when(F.col("value").contains("@"), "EMAIL").otherwise("IP")).withColumnRenamed("value", "text")
    out = registry.number_entities(kinds, "en")
    return out.select("doc_id", "kind", "key", F.col("n").cast("long").alias("n"), "marker")


def anonymize_documents(spark, sf_dir):
    return anonymize_texts(units.spread(_table(spark, sf_dir, "documents").select("doc_id", "text")), Anonymizer("balanced", "en"))


def anonymize_conversations(spark, sf_dir):
    rows = _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("unit_seq"), "text")
    return Anonymizer("balanced", "en").transform(units.with_previous(rows)).select("doc_id", F.col("unit_seq").cast("long").alias("unit_seq"), "redacted", F.col("replaced").cast("long").alias("replaced"))


def job_stats(spark, sf_dir):
    out = Anonymizer("balanced", "en").stats(_units(spark, sf_dir))
    return out.select("doc_id", "total_occurrences", "total_distinct", F.array_join("labels", ",").alias("labels"), F.to_json("by_kind").alias("by_kind"), "engine", "doc_lang", "level", F.to_json("warnings").alias("warnings"))


def idempotent_rerun(spark, sf_dir):
    """Documents that a second run would change: none."""
    once = anonymize_documents(spark, sf_dir).withColumnRenamed("redacted", "text")
    again = anonymize_texts(once, Anonymizer("balanced", "en"))
    return once.join(again, "doc_id").agg(F.count_if(F.col("text") != F.col("redacted")).alias("changed"))


_SHAPES = [
    "password: hunter%d2, api_key = abcdef%d0123456789xyz", "bearer sk_live_abcdefgh%d12345678 AKIA%dABCDEFGHIJKLMNOP", "user: ana%d login=bob.%d", "SIN-2025-%d and 2024-ABC-%d",
    "Contract N. VD-2019-%d / invoice # FA-%d77", "Paid $ 2.850.%d or 1.500 euros, %d EUR", "born 12/03/19%d", "calle Mayor %d, piso 3", "/etc/app/%d.conf and C:\\data\\%d srv-db%d.local",
    "call +34 612 345 678 or phone 612345678 %d", "12.345.678-5 RUT 12345678-5 %d", "diagnóstico J45.%d 1234 BCD", "database: prod_%d", "www.example%d.com https://x%d.org/a?b=%d",
]

#: Texts and contexts for each rule: what it takes, and what lacks its context, its check digit or a piece of its shape.
_RULE_CASES = [
    ("[NAME_%d] and (CP_1) not [name_1]", ""), ("RUT 12.345.678-5 or 12.345.%d-K", ""), ("id 12345678-5 and 1234%d-K", "the RUT is"), ("id 12345678-5", "none"), ("12345678Z, 12345678 - A, 00000%dT", ""),
    ("X1234567L Y0000%dZ X-1234567-A", ""), ("A58818501 A58818502 B 1234%d 5", ""), ("passport AAA123%d", ""), ("AAA123%d", "no pass"), ("NUSS 28-12%d456", ""), ("28-12%d456", ""), ("ssn? 123-45-6%d and 123-4-6789", ""),
    ("ES91 2100 0418 4502 0005 1332, ES92 2100 0418 4502 0005 1332", ""), ("card 4111 1111 1111 1111 then 4539578763621486 4111111111111%d", ""), ("Password : 'p%dxyz', clave=abc", ""), ("api-key abc.def_%d-0123456789 x", ""),
    ("sk_test_abcdefghijklm%d pk_live_short", ""), ("AKIA%dABCDEFGHIJKLM AKIAshort", ""), ("ghp_abcdefghijklmnopq%d ghx_abcdefghijklmnopqrst", ""), ("eyJhbGciOi.eyJzdWIiOi%d.SflKxwRJSM eyJ.a.b", ""), ("Usuario: \"ana.%d\" login = x", ""),
    ("a.b+c%d@mail.example.org @x.org a@b", ""), ("see http://x.org/a_%d?b=(c) or https://y.io", ""), ("WWW.Example-%d.com/path www.x", ""), ("+56 9 1234 5%d and 0056912345%d", ""), ("+34 612.345.%d or 712 345%d", ""), ("llamar al 612345%d", ""),
    ("612345%d", "nothing here"), ("+1 415-555-2%d and +44 20 7946 0%d", ""), ("10.0.0.%d 10.0.0.12:8080 256.1.1.1", ""), ("on \\\\host%d\\share\\x", ""), ("D:\\data\\f%d.txt", ""), ("/var/log/%d.log x/etc/no //etc/no", ""), ("nas-%d.local db.internal x.com", ""),
    ("srv-app%d host", ""), ("schema: sales_%d", ""), ("Contrato n. AB-%d/X", ""), ("Factura #F-%d12 boleta x", ""), ("ABC-2024-X%d9 ABC-24-X", ""), ("2024-ABC-%dZ", ""), ("n° cliente: AB%d-1", ""), ("US$ 1.%d,50 M or $99 and x$5", ""),
    ("pay 1.%d euros, 25,50 USD 1234 EUR", ""), ("12/03/1%d", "date of birth"), ("12-3-%d", "no"), ("12 de marzo de 1%d", "nacido"), ("5/6/2%d", ""), ("avda. Larga del Sol 1%d, oficina 3", ""), ("28%d", "codigo postal"), ("zip 28%d and 28%d", ""),
    ("morbilidad J45.%d and K%d", ""), ("J45.1", "none"), ("1%d BCD and 1234 AEI", ""),
]


def _shape_texts(spark, sf_dir, cases):
    """One of the cases for each customer, with the key's last three digits put in: doc_id, unit_seq, text, context."""
    k = F.col("k")
    which = (k % len(cases)).cast("int")
    put = lambda column: F.replace(F.get(F.array(*map(F.lit, column)), which), F.lit("%d"), F.lpad((k % 1000).cast("string"), 3, "0"))
    texts, contexts = zip(*cases, strict=True)
    return _keys(spark, sf_dir).select(k.alias("doc_id"), F.lit(0).cast("long").alias("unit_seq"), put(texts).alias("text"), put(contexts).alias("context"))


def _shape_sql(cases):
    put = lambda column: "replace(CASE k % " + str(len(cases)) + " " + " ".join(f"WHEN {i} THEN {oracle.quoted(x)}" for i, x in enumerate(column)) + " END, '%d', lpad(CAST(k % 1000 AS VARCHAR), 3, '0'))"
    texts, contexts = zip(*cases, strict=True)
    return f"units AS (SELECT k AS doc_id, CAST(0 AS BIGINT) AS unit_seq, {put(texts)} AS text, {put(contexts)} AS context FROM ({_CUSTOMER_KEYS}))"


def _long(*names):
    return [F.col(f"s.{n}").cast("long").alias(n) for n in names]


def _shape_query(kinds):
    def query(spark, sf_dir):
        rows = _shape_texts(spark, sf_dir, [(t, "") for t in _SHAPES])
        found = Anonymizer("full", "en").spans(rows).select("doc_id", F.explode("spans").alias("s")).where(F.col("s.kind").isin(kinds))
        return found.select("doc_id", *_long("start", "end", "priority"), "s.kind", "s.text")

    return query


def rule_matches(spark, sf_dir):
    """Every rule of the catalogue over its cases, before overlaps are resolved."""
    rows = _shape_texts(spark, sf_dir, _RULE_CASES)
    found = rows.select("doc_id", F.explode(spans.detect(fx.guarded(F.col("text")), F.col("context"), FULL)).alias("s"))
    return found.select("doc_id", *_long("rule", "start", "end", "priority"), "s.kind", "s.text")


def rule_cases_redacted(spark, sf_dir):
    """The cases of all rules, redacted at the full level."""
    rows = _shape_texts(spark, sf_dir, _RULE_CASES)
    return Anonymizer("full", "es").transform(rows).select("doc_id", "redacted", F.col("replaced").cast("long").alias("replaced"))


_CONTEXT_RULES = ["PHONE", "POSTAL_CODE", "BIRTHDATE", "PASSPORT", "SSN"]
_GATED = [(t, c) for t in ("612345%d", "28%d1", "12/03/1%d", "AAA123%d", "28-12%d456") for c in ("", "telefono", "codigo postal", "fecha nac", "passport", "seguridad social")]


def context_gate(spark, sf_dir):
    """Rules that need a word near the value: with the word in the context beside it, and without."""
    rules = [(k, r) for k, r in enumerate(RULES) if r.kind in _CONTEXT_RULES and r.context]
    rows = _shape_texts(spark, sf_dir, _GATED)
    found = rows.select("doc_id", F.explode(spans.detect(fx.guarded(F.col("text")), F.col("context"), FULL, rules)).alias("s"))
    return found.select("doc_id", *_long("rule", "start", "end"), "s.kind")


def ctx_prev_row(spark, sf_dir):
    """Values whose word stands in the unit before: keys in order, a word in every third."""
    k = F.col("k")
    text = F.when(k % 3 == 0, "telefono de contacto").when(k % 3 == 1, F.concat(F.lit("612345"), F.lpad((k % 1000).cast("string"), 3, "0"))).otherwise(F.concat(F.lit("712345"), F.lpad((k % 1000).cast("string"), 3, "0")))
    rows = units.with_previous(_keys(spark, sf_dir).select(F.floor(k / 30).alias("doc_id"), k.alias("unit_seq"), text.alias("text")))
    rules = [(n, r) for n, r in enumerate(RULES) if r.context == "phone"]
    found = rows.select("doc_id", "unit_seq", F.explode(spans.detect(fx.guarded(F.col("text")), F.col("context"), FULL, rules)).alias("s"))
    return found.select("doc_id", "unit_seq", F.col("s.text").alias("value"))


def overlap_resolution(spark, sf_dir):
    """Intervals of line items by order, disjoint by quantity, then length, then start."""
    line = _table(spark, sf_dir, "lineitem")
    start = (F.col("l_partkey") % 97).cast("int")
    span = F.struct(start.alias("start"), (start + F.col("l_quantity").cast("int")).alias("end"), F.lit("X").alias("kind"), F.lit("x").alias("text"), F.col("l_linenumber").alias("priority"), F.lit("regex").alias("source"), F.lit(0).alias("rule"))
    grouped = line.groupBy("l_orderkey").agg(F.collect_list(span).cast(spans.SPANS).alias("s"))
    kept = grouped.select("l_orderkey", F.explode(spans.resolve_overlaps(F.col("s"))).alias("s"))
    return kept.select("l_orderkey", *_long("start", "end", "priority"))


def splice_segments(spark, sf_dir):
    """Whole texts in segments of 40, with a span across the first border: joined again, they are the spliced text."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    parts = F.greatest(F.ceil(F.length("text") / 40), F.lit(1)).cast("int")
    wanted = F.array(F.struct(F.lit(30).alias("start"), F.lit(50).alias("end"), F.lit("[X_1]").alias("marker")), F.struct(F.lit(90).alias("start"), F.lit(95).alias("end"), F.lit("[X_2]").alias("marker")))
    rows = docs.withColumn("segments", F.transform(F.sequence(F.lit(0), parts - 1), lambda i: F.substring(F.col("text"), i * 40 + 1, F.lit(40)))).withColumn("edits", splice.normalize(wanted, F.length("text")))
    out = rows.select("doc_id", fx.once(splice.splice_segments(F.col("segments"), F.col("edits"))).alias("s"), splice.splice(F.col("text"), F.col("edits")).alias("whole"))
    return out.select("doc_id", F.array_join("s", "").alias("joined"), F.get("s", F.lit(0)).alias("first"), F.get("s", F.lit(1)).alias("second"), "whole")


def sheet_name_safe(spark, sf_dir):
    return _table(spark, sf_dir, "nation").select("n_nationkey", fx.sheet_title(F.concat(F.lit("[NAME_1] of the sheets of "), F.col("n_name"))).alias("title"))


def line_padding(spark, sf_dir):
    old = F.col("text")
    return _table(spark, sf_dir, "documents").select("doc_id", structure.extra_breaks(old, F.lit("[PARAGRAPH CONTENT 1]"), F.lit(24)).alias("breaks"))


def _order_cells(spark, sf_dir):
    """Orders as a worksheet for each customer: a header row, then key, status, price."""
    orders = _table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    from pyspark.sql import Window

    row = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) + 1
    cell = lambda col, dtype, s, d: F.struct(F.lit(col).alias("col"), F.lit(dtype).alias("dtype"), s.cast("string").alias("s"), d.cast("double").alias("d"))
    none = F.lit(None)
    body = orders.withColumn("row", row).select(
        F.col("o_custkey").alias("doc_id"), F.lit(1).alias("sheet_ord"), "row",
        F.explode(F.array(cell(1, "n", none, F.col("o_orderkey")), cell(2, "s", F.col("o_orderstatus"), none), cell(3, "n", none, F.col("o_totalprice")), cell(4, "s", F.col("o_orderpriority"), none))).alias("c"),
    )
    heads = orders.select("o_custkey").distinct().select(
        F.col("o_custkey").alias("doc_id"), F.lit(1).alias("sheet_ord"), F.lit(1).alias("row"), F.explode(F.array(*(cell(k, "s", F.lit(n), none) for k, n in enumerate(("order", "status", "total price", "priority"), 1)))).alias("c")
    )
    return body.unionByName(heads).select("doc_id", "sheet_ord", "row", "c.*")


def tabular_numeric_mask(spark, sf_dir):
    out = tabular.number_markers(units.with_headers(_order_cells(spark, sf_dir)), level_of("balanced"), "en")
    return out.select("doc_id", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col("n").cast("long").alias("n"), "marker")


def header_row(spark, sf_dir):
    return units.header_rows(_order_cells(spark, sf_dir)).select("doc_id", F.col("header_row").cast("long").alias("header_row"))


def structure_cells(spark, sf_dir):
    out = structure.cell_labels(_order_cells(spark, sf_dir), "en")
    return out.select("doc_id", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "label")


#: Tags inside a block, which go, and a block up to the next tag.
_INLINE = r"</?(?:a|b|br|em|i|span|strong|u)(?:\s[^>]*)?/?>"
_ELEMENT = r"<(h1|p|li|header|footer)(?:\s[^>]*)?>([^<]*)"


def structure_html(spark, sf_dir):
    """Pages' headings, paragraphs, items, header and footer as document elements."""
    pages = _table(spark, sf_dir, "pages")
    whole = F.regexp_extract_all(F.regexp_replace("html", _INLINE, ""), F.lit(_ELEMENT), F.lit(0))
    rows = pages.select(F.col("page_id").alias("doc_id"), F.posexplode(whole).alias("seq", "e"))
    tag, text = F.regexp_extract("e", _ELEMENT, 1), F.regexp_extract("e", _ELEMENT, 2)
    elements = rows.select(
        "doc_id", "seq", F.when(tag.isin("header", "footer"), tag).otherwise("body").alias("part"), F.when(tag == "h1", "Heading1").when(tag == "li", "ListParagraph").otherwise("Normal").alias("style"),
        F.lit(False).alias("has_num"), F.lit(None).cast("int").alias("table_row"), F.lit(None).cast("int").alias("table_col"), text.alias("text"),
    )
    return structure.word_labels(elements, "en").select("doc_id", F.col("seq").cast("long").alias("seq"), "label")


def noise_filter(spark, sf_dir):
    names = _table(spark, sf_dir, "part").select("p_partkey", F.initcap("p_name").alias("surface"))
    return names.select("p_partkey", language.is_noise(F.col("surface"), F.lit("ORG")).alias("noise"))


def _people(spark, sf_dir):
    """Names made of keys, several to a document: full, shorter, surname alone."""
    k = F.col("k")
    first, last = F.concat(F.lit("Ana"), F.substring(F.lit("bcdfghjklm"), (k % 10).cast("int") + 1, F.lit(1))), F.concat(F.lit("Correa"), F.substring(F.lit("bcdfghjklmn"), (k % 11).cast("int") + 1, F.lit(1)))
    surface = F.when(k % 3 == 0, F.concat_ws(" ", first, F.lit("Maria"), last)).when(k % 3 == 1, F.concat_ws(" ", first, last)).otherwise(F.concat(F.lit("Dr. "), first, F.lit(" "), last))
    return _keys(spark, sf_dir).select(F.floor(k / 6).alias("doc_id"), (k % 6).cast("int").alias("unit_seq"), surface.alias("surface"), last.alias("last"))


def alias_registry(spark, sf_dir):
    """Persons of a document folded to their markers, and surnames found again by the gazetteer."""
    people = _people(spark, sf_dir)
    text = F.concat(F.col("surface"), F.lit(" wrote about "), F.col("last"), F.lit("."))
    rows = people.select("doc_id", "unit_seq", text.alias("text"), F.lit("").alias("context"))
    found = people.select("doc_id", "unit_seq", F.lit(0).alias("start"), F.length("surface").alias("end"), F.lit("PER").alias("label"), F.col("surface").alias("text"))
    return Anonymizer("balanced", "en", found).transform(rows).select("doc_id", "unit_seq", "redacted", "replaced")


def _sights(spark, sf_dir):
    """Each person of :func:`_people` as a place where it was seen."""
    return _people(spark, sf_dir).select("doc_id", "unit_seq", F.lit(0).alias("start"), F.lit("PERSON").alias("kind"), F.col("surface").alias("text"))


def token_owners(spark, sf_dir):
    """Name tokens of five letters and more that one person key of a document owns."""
    people = _sights(spark, sf_dir).select("doc_id", fx.entity_key(F.col("text"), F.col("kind")).alias("person"))
    return registry.token_owners(people)


def gazetteer_topk(spark, sf_dir):
    """The three longest known names of each document, the first seen first among equals."""
    return registry.longest(registry.known_names(_sights(spark, sf_dir)), 3, "first").select("doc_id", "term", F.col("place").cast("long").alias("place"))


def gazetteer_scan(spark, sf_dir):
    """Known names and surnames of a document, found in units that spell them otherwise."""
    people = _people(spark, sf_dir)
    keys = _sights(spark, sf_dir).select("doc_id", fx.entity_key(F.col("text"), F.col("kind")).alias("person"))
    known = registry.gazetteer(_sights(spark, sf_dir), keys).withColumnRenamed("doc_id", "d")
    text = F.concat(F.upper("surface"), F.lit(", x"), F.col("last"), F.lit(" and "), F.col("last"), F.lit("."))
    rows = people.select("doc_id", "unit_seq", text.alias("text")).join(known, F.col("doc_id") == F.col("d"))
    found = rows.select("doc_id", "unit_seq", F.explode(registry.gazetteer_spans(F.col("text"), F.col("names"), F.col("kinds"), F.col("surnames"))).alias("s"))
    return found.select("doc_id", F.col("unit_seq").cast("long").alias("unit_seq"), *_long("start", "end"), "s.kind", "s.text")


def kind_counts(spark, sf_dir):
    """Distinct entities of each kind in each document."""
    found = Anonymizer("balanced", "en").replacements(_units(spark, sf_dir)).where("n is not null")
    return found.groupBy("doc_id", "kind").agg(F.max("n").cast("long").alias("n"))


def labels_in_order(spark, sf_dir):
    """Each document's markers in the order of first sight."""
    found = Anonymizer("balanced", "es").replacements(_units(spark, sf_dir))
    first = found.groupBy("doc_id", "marker").agg(F.min(F.struct("unit_seq", "start")).alias("at"))
    return first.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "marker"))), lambda x: x["marker"]), ",").alias("labels"))


QUERIES = {
    f.__name__: f
    for f in (
        units_with_context, units_distinct, detect_email, detect_ip, detect_card, detect_url, spans_by_kind_level, valid_dni, valid_nie, valid_rut, valid_cif, valid_iban, valid_luhn, detect_lang, entity_first_seen,
        anonymize_documents, anonymize_conversations, job_stats, idempotent_rerun, overlap_resolution, splice_segments, sheet_name_safe, line_padding, tabular_numeric_mask, header_row, structure_cells, structure_html,
        noise_filter, alias_registry, token_owners, rule_matches, rule_cases_redacted, context_gate, ctx_prev_row, gazetteer_topk, gazetteer_scan, kind_counts, labels_in_order,
    )
}
_FAMILIES = {
    "secrets_rules": ["CREDENTIAL", "API_KEY", "TOKEN", "USERNAME"], "reference_rules": ["REFERENCE", "CONTRACT", "INVOICE", "HEALTH_CODE", "PLATE", "NATIONAL_ID"],
    "amount_date_rules": ["AMOUNT", "BIRTHDATE", "PHONE"], "address_path_host_rules": ["ADDRESS", "PATH", "HOSTNAME", "DATABASE", "URL", "POSTAL_CODE"],
}
QUERIES |= {name: _shape_query(kinds) for name, kinds in _FAMILIES.items()}

_LINES = """lines AS (
  SELECT doc_id, i - 1 AS unit_seq, parts[i] AS text
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)
  WHERE regexp_matches(parts[i], '[^ \\t\\n\\x0B\\f\\r]'))"""
#: Non-ASCII letters as an ASCII one of the same length, so that both engines see the same word borders.
_SHADOW = "regexp_replace(text, '[À-ÖØ-öø-ɏ]', 'x', 'g')"
_CARD = "regexp_replace(m, '[^0-9]', '', 'g')"
_CELLS = """cells AS (
  SELECT o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) + 1 AS row FROM orders)"""


def _digit_sum(value: str, places: str, weight: str) -> str:
    return f"list_sum(list_transform(range({places}), lambda i: CAST(substr({value}, CAST(i AS INT) + 1, 1) AS INT) * ({weight})))"


ORACLES: dict[str, str] = {
    "units_with_context": f"WITH {_LINES} SELECT doc_id, unit_seq, text, coalesce(lag(substr(text, 1, 90)) OVER (PARTITION BY doc_id ORDER BY unit_seq), '') AS context FROM lines",
    "units_distinct": f"WITH {_LINES} SELECT doc_id, min(unit_seq) AS unit_seq, count(*) AS times, length(text) AS n_chars FROM lines GROUP BY doc_id, text",
    "detect_email": f"WITH {_LINES} SELECT doc_id, unit_seq, unnest(regexp_extract_all({_SHADOW}, '\\b[\\w.+-]+@[\\w-]+(?:\\.[\\w-]+)+\\b')) AS value FROM lines",
    "detect_ip": f"WITH {_LINES} SELECT doc_id, unit_seq, unnest(regexp_extract_all({_SHADOW}, '\\b(?:(?:25[0-5]|2[0-4]\\d|1\\d\\d|[1-9]?\\d)\\.){{3}}(?:25[0-5]|2[0-4]\\d|1\\d\\d|[1-9]?\\d)(?::\\d{{1,5}})?\\b')) AS value FROM lines",
    "detect_card": f"""WITH {_LINES}, found AS (SELECT doc_id, unit_seq, unnest(regexp_extract_all({_SHADOW}, '\\b(?:\\d[ -]?){{13,19}}\\b')) AS m FROM lines),
digits AS (SELECT doc_id, unit_seq, {_CARD} AS digits FROM found),
sums AS (SELECT *, list_sum(list_transform(range(length(digits)), lambda i:
  CASE WHEN i % 2 = 0 THEN CAST(substr(digits, CAST(length(digits) - i AS INT), 1) AS INT)
       WHEN CAST(substr(digits, CAST(length(digits) - i AS INT), 1) AS INT) >= 5 THEN CAST(substr(digits, CAST(length(digits) - i AS INT), 1) AS INT) * 2 - 9
       ELSE CAST(substr(digits, CAST(length(digits) - i AS INT), 1) AS INT) * 2 END)) AS total FROM digits)
SELECT doc_id, unit_seq, digits FROM sums WHERE length(digits) BETWEEN 13 AND 19 AND total % 10 = 0""",
    "detect_url": "SELECT page_id, unnest(regexp_extract_all(url, '\\bhttps?://[^\\s<>\"''\\)\\]]+')) AS value FROM pages",
    "valid_dni": f"""WITH v AS (SELECT k, lpad(CAST(k * 7919 % 100000000 AS VARCHAR), 8, '0') || CASE WHEN k % 2 = 0 THEN {_DNI_SQL} ELSE 'A' END AS value FROM ({_CUSTOMER_KEYS}))
SELECT k, value, substr('TRWAGMYFPDXBNJZSQVHLCKE', CAST(CAST(substr(value, 1, 8) AS BIGINT) % 23 AS INT) + 1, 1) = substr(value, 9, 1) AS valid FROM v""",
    "valid_nie": f"""WITH v AS (SELECT k, substr('XYZ', CAST(k % 3 AS INT) + 1, 1) || lpad(CAST(k * 104729 % 10000000 AS VARCHAR), 7, '0') || substr('TRWAGMYFPDXBNJZSQVHLCKE', CAST(k % 23 AS INT) + 1, 1) AS value FROM ({_CUSTOMER_KEYS}))
SELECT k, value, substr('TRWAGMYFPDXBNJZSQVHLCKE', CAST(CAST(translate(substr(value, 1, 1), 'XYZ', '012') || substr(value, 2, 7) AS BIGINT) % 23 AS INT) + 1, 1) = substr(value, 9, 1) AS valid FROM v""",
    "valid_rut": f"""WITH v AS (SELECT k, lpad(CAST(k * 7919 % 100000000 AS VARCHAR), 8, '0') AS d, substr('0123456789K', CAST(k % 11 AS INT) + 1, 1) AS c FROM ({_CUSTOMER_KEYS})),
s AS (SELECT *, 11 - {_digit_sum("reverse(d)", "8", "i % 6 + 2")} % 11 AS r FROM v)
SELECT k, d || '-' || c AS value, c = CASE r WHEN 11 THEN '0' WHEN 10 THEN 'K' ELSE CAST(r AS VARCHAR) END AS valid FROM s""",
    "valid_cif": f"""WITH v AS (SELECT k, substr('ABCDEFGHJNPQRSUVW', CAST(k % 17 AS INT) + 1, 1) AS f, lpad(CAST(k * 104729 % 10000000 AS VARCHAR), 7, '0') AS d,
  CASE WHEN k % 2 = 0 THEN CAST(k % 10 AS VARCHAR) ELSE substr('JABCDEFGHI', CAST(k % 10 AS INT) + 1, 1) END AS l FROM ({_CUSTOMER_KEYS})),
s AS (SELECT *, (10 - list_sum(list_transform(range(7), lambda i: CASE WHEN i % 2 = 1 THEN CAST(substr(d, CAST(i AS INT) + 1, 1) AS INT)
  ELSE CAST(substr(d, CAST(i AS INT) + 1, 1) AS INT) * 2 // 10 + CAST(substr(d, CAST(i AS INT) + 1, 1) AS INT) * 2 % 10 END)) % 10) % 10 AS c FROM v)
SELECT k, f || d || l AS value, CASE WHEN f IN ('P', 'Q', 'R', 'S', 'N', 'W') THEN l = substr('JABCDEFGHI', CAST(c AS INT) + 1, 1)
  WHEN f IN ('A', 'B', 'E', 'H') THEN l = CAST(CAST(c AS INT) AS VARCHAR) ELSE l = CAST(CAST(c AS INT) AS VARCHAR) OR l = substr('JABCDEFGHI', CAST(c AS INT) + 1, 1) END AS valid FROM s""",
    "valid_iban": f"""WITH v AS (SELECT k, lpad(CAST(k % 97 AS VARCHAR), 2, '0') AS c, lpad(CAST(k * 7919 AS VARCHAR), 20, '0') AS b FROM ({_CUSTOMER_KEYS}))
SELECT k, 'ES' || c || b AS value, CAST(b || '1428' || c AS HUGEINT) % 97 = 1 AS valid FROM v""",
    "valid_luhn": f"""WITH v AS (SELECT k, '4' || lpad(CAST(k * 7919 AS VARCHAR), 15, '0') AS value FROM ({_CUSTOMER_KEYS}))
SELECT k, value, list_sum(list_transform(range(16), lambda i: CASE WHEN i % 2 = 1 THEN CAST(substr(value, CAST(i AS INT) + 1, 1) AS INT)
  WHEN CAST(substr(value, CAST(i AS INT) + 1, 1) AS INT) >= 5 THEN CAST(substr(value, CAST(i AS INT) + 1, 1) AS INT) * 2 - 9 ELSE CAST(substr(value, CAST(i AS INT) + 1, 1) AS INT) * 2 END)) % 10 = 0 AS valid FROM v""",
    "detect_lang": f"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(substr(text, 1, 20000)), '[a-záéíóúüñ]+') AS w FROM documents),
n AS (SELECT doc_id, len(w) AS n, len(list_filter(w, lambda x: list_contains({language.STOP_ES}, x))) AS es, len(list_filter(w, lambda x: list_contains({language.STOP_EN}, x))) AS en FROM w)
SELECT doc_id, CASE WHEN n < 20 OR es + en = 0 THEN 'es' WHEN es >= en * 1.15 THEN 'es' WHEN en > es * 1.15 THEN 'en' ELSE 'es' END AS lang FROM n""",
    "sheet_name_safe": "SELECT n_nationkey, substr(translate('[NAME_1] of the sheets of ' || n_name, '[]', '()'), 1, 31) AS title FROM nation",
    "line_padding": "SELECT doc_id, CAST(greatest(0, greatest(1, ceil(length(text) / 80.0)) - 1) AS BIGINT) AS breaks FROM documents",
    "splice_segments": """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n FROM documents),
s AS (SELECT *, CASE WHEN n >= 95 THEN substr(t, 1, 30) || '[X_1]' || substr(t, 51, 40) || '[X_2]' || substr(t, 96) WHEN n >= 50 THEN substr(t, 1, 30) || '[X_1]' || substr(t, 51) ELSE t END AS whole FROM d)
SELECT doc_id, whole AS joined, CASE WHEN n >= 50 THEN substr(t, 1, 30) || '[X_1]' ELSE substr(t, 1, 40) END AS first,
  CASE WHEN n >= 50 THEN substr(t, 51, 30) WHEN n > 40 THEN substr(t, 41) END AS second, whole FROM s""",
    "header_row": "SELECT DISTINCT o_custkey AS doc_id, CAST(1 AS BIGINT) AS header_row FROM orders",
    "tabular_numeric_mask": f"WITH {_CELLS} SELECT doc_id, row, CAST(3 AS BIGINT) AS col, row - 1 AS n, '[VALUE_' || (row - 1) || ']' AS marker FROM cells",
    "structure_cells": f"""WITH {_CELLS}
SELECT doc_id, row, CAST(c AS BIGINT) AS col, CASE c WHEN 1 THEN '[NUMERIC VALUE ' || (2 * (row - 1) - 1) || ']' WHEN 3 THEN '[NUMERIC VALUE ' || (2 * (row - 1)) || ']' ELSE '[DATA ROW-' || row || ' COL-' || c || ']' END AS label
FROM cells, (SELECT unnest([1, 2, 3, 4]) AS c)
UNION ALL SELECT DISTINCT o_custkey, CAST(1 AS BIGINT), CAST(c AS BIGINT), '[HEADER COL-' || c || ']' FROM orders, (SELECT unnest([1, 2, 3, 4]) AS c)""",
    "idempotent_rerun": "SELECT CAST(0 AS BIGINT) AS changed",
}


_BALANCED = oracle.rules_of(level=BALANCED)
_PEOPLE = f"""people AS (SELECT k // 6 AS doc_id, k % 6 AS unit_seq, last, CASE k % 3 WHEN 0 THEN first || ' Maria ' || last WHEN 1 THEN first || ' ' || last ELSE 'Dr. ' || first || ' ' || last END AS surface
  FROM (SELECT k, 'Ana' || substr('bcdfghjklm', CAST(k % 10 AS INT) + 1, 1) AS first, 'Correa' || substr('bcdfghjklmn', CAST(k % 11 AS INT) + 1, 1) AS last FROM ({_CUSTOMER_KEYS}))),
terms AS (SELECT doc_id, surface AS term, min(unit_seq) AS first FROM people GROUP BY doc_id, surface)"""
_OWNED = f"""tokens AS (SELECT DISTINCT doc_id, key, unnest(string_split(key, ' ')) AS token FROM (SELECT doc_id, {oracle.key("surface")} AS key FROM people)),
owned AS (SELECT doc_id, token FROM tokens WHERE length(token) >= 5 GROUP BY doc_id, token HAVING count(DISTINCT key) = 1)"""
_PLAIN_HTML = f"regexp_replace(html, {oracle.quoted(_INLINE)}, '', 'g')"


def _redaction(units_sql):
    return f"WITH RECURSIVE {units_sql}, {oracle.raw(_BALANCED)}, {oracle.chosen()}, {oracle.numbered()}"


def _levels():
    parts = []
    for name, rank in (("soft", SOFT), ("balanced", BALANCED), ("full", FULL)):
        parts.append((name, f"raw_{name} AS (SELECT * FROM raw WHERE lvl <= {rank}), {oracle.chosen(f'raw_{name}', f'spans_{name}')}"))
    counts = " UNION ALL ".join(f"SELECT kind, count(*) AS n, '{name}' AS level FROM spans_{name} GROUP BY kind" for name, _ in parts)
    return f"WITH RECURSIVE {oracle.lines()}, {oracle.raw(oracle.rules_of())}, {', '.join(p for _, p in parts)} {counts}"


_VOTE = f"""voted AS (SELECT doc_id, CASE WHEN n < 20 OR es + en = 0 THEN 'en' WHEN es >= en * 1.15 THEN 'es' WHEN en > es * 1.15 THEN 'en' ELSE 'en' END AS lang FROM (
  SELECT doc_id, len(w) AS n, len(list_filter(w, lambda x: list_contains({language.STOP_ES}, x))) AS es, len(list_filter(w, lambda x: list_contains({language.STOP_EN}, x))) AS en
  FROM (SELECT doc_id, regexp_extract_all(lower(substr(string_agg(text, ' ' ORDER BY unit_seq), 1, 20000)), '[a-záéíóúüñ]+') AS w FROM units GROUP BY doc_id)))"""
_WORDS = "list_filter(regexp_split_to_array(lower(strip_accents(trim(surface))), '[^0-9a-z_]+'), lambda w: length(w) > 1 AND NOT list_contains({particles}, w))".format(particles=language.NOISE_PARTICLES)

ORACLES |= {
    "spans_by_kind_level": _levels(),
    "anonymize_documents": f"""{_redaction(oracle.lines())}, {oracle.REDACTED}
SELECT d.doc_id, w.redacted FROM documents d LEFT JOIN (
  SELECT l.doc_id, string_agg(coalesce(r.redacted, l.text), chr(10) ORDER BY l.unit_seq) AS redacted
  FROM lines l LEFT JOIN redacted r ON l.doc_id = r.doc_id AND l.unit_seq = r.unit_seq GROUP BY l.doc_id) w ON d.doc_id = w.doc_id""",
    "anonymize_conversations": f"""{_redaction("units AS (SELECT conv_id AS doc_id, CAST(turn AS BIGINT) AS unit_seq, text, coalesce(lag(substr(text, 1, 90)) OVER (PARTITION BY conv_id ORDER BY turn), '') AS context FROM conversations)")}, {oracle.REDACTED}
SELECT u.doc_id, u.unit_seq, coalesce(r.redacted, u.text) AS redacted, coalesce(r.replaced, 0) AS replaced FROM units u LEFT JOIN redacted r ON u.doc_id = r.doc_id AND u.unit_seq = r.unit_seq""",
    "entity_first_seen": f"""WITH RECURSIVE {oracle.lines()}, {oracle.raw(oracle.rules_of(["EMAIL", "IP"]))}, {oracle.numbered("raw")}
SELECT DISTINCT doc_id, kind, key, n, marker FROM numbered""",
    "job_stats": f"""{_redaction(oracle.lines())}, {_VOTE},
each AS (SELECT n.doc_id, n.kind, n.marker, min({{'u': n.unit_seq, 's': n.s}}) AS place, count(*) AS times, count(DISTINCT {{'t': u.text, 'c': u.context, 's': n.s}}) AS own
  FROM numbered n JOIN units u ON n.doc_id = u.doc_id AND n.unit_seq = u.unit_seq GROUP BY n.doc_id, n.kind, n.marker),
kinds AS (SELECT doc_id, '{{' || string_agg('"' || kind || '":' || n, ',' ORDER BY kind) || '}}' AS by_kind FROM (SELECT doc_id, kind, count(*) AS n FROM each GROUP BY doc_id, kind) GROUP BY doc_id),
totals AS (SELECT doc_id, CAST(sum(times) AS BIGINT) AS total_occurrences, CAST(sum(own) AS BIGINT) AS total_distinct, string_agg(marker, ',' ORDER BY place) AS labels FROM each GROUP BY doc_id)
SELECT v.doc_id, coalesce(t.total_occurrences, 0) AS total_occurrences, coalesce(t.total_distinct, 0) AS total_distinct, t.labels, k.by_kind, 'regex-only' AS engine, v.lang AS doc_lang, 'balanced' AS level,
  '[{{"code":"recogniser_missing"}}]' AS warnings FROM voted v LEFT JOIN totals t ON v.doc_id = t.doc_id LEFT JOIN kinds k ON v.doc_id = k.doc_id""",
    "kind_counts": f"{_redaction(oracle.lines())} SELECT doc_id, kind, count(DISTINCT key) AS n FROM numbered GROUP BY doc_id, kind",
    "labels_in_order": f"""WITH RECURSIVE {oracle.lines()}, {oracle.raw(_BALANCED)}, {oracle.chosen()}, {oracle.numbered().replace(oracle.marker("kind", "n"), oracle.marker("kind", "n", "es"))}
SELECT doc_id, string_agg(marker, ',' ORDER BY place) AS labels FROM (SELECT doc_id, marker, min({{'u': unit_seq, 's': s}}) AS place FROM numbered GROUP BY doc_id, marker) GROUP BY doc_id""",
    "rule_matches": f"WITH {_shape_sql(_RULE_CASES)}, {oracle.raw(oracle.rules_of())} SELECT doc_id, CAST(rule AS BIGINT) AS rule, s AS start, e AS end, CAST(priority AS BIGINT) AS priority, kind, value AS text FROM raw",
    "rule_cases_redacted": f"""WITH RECURSIVE {_shape_sql(_RULE_CASES)}, {oracle.raw(oracle.rules_of())}, {oracle.chosen()}, {oracle.numbered().replace(oracle.marker("kind", "n"), oracle.marker("kind", "n", "es"))}, {oracle.REDACTED}
SELECT u.doc_id, coalesce(r.redacted, u.text) AS redacted, coalesce(r.replaced, 0) AS replaced FROM units u LEFT JOIN redacted r ON u.doc_id = r.doc_id""",
    "context_gate": f"WITH {_shape_sql(_GATED)}, {oracle.raw([(k, r) for k, r in oracle.rules_of(_CONTEXT_RULES) if r.context])} SELECT doc_id, CAST(rule AS BIGINT) AS rule, s AS start, e AS end, kind FROM raw",
    "ctx_prev_row": f"""WITH v AS (SELECT k, k // 30 AS doc_id, CASE k % 3 WHEN 0 THEN 'telefono de contacto' WHEN 1 THEN '612345' || lpad(CAST(k % 1000 AS VARCHAR), 3, '0') ELSE '712345' || lpad(CAST(k % 1000 AS VARCHAR), 3, '0') END AS text FROM ({_CUSTOMER_KEYS})),
p AS (SELECT *, lag(text) OVER (PARTITION BY doc_id ORDER BY k) AS before FROM v)
SELECT doc_id, k AS unit_seq, text AS value FROM p WHERE k % 3 <> 0 AND before = 'telefono de contacto'""",
    "overlap_resolution": f"""WITH RECURSIVE raw AS (SELECT l_orderkey, l_partkey % 97 AS s, l_partkey % 97 + CAST(l_quantity AS BIGINT) AS e, 'X' AS kind, 'x' AS value, CAST(l_linenumber AS BIGINT) AS priority, 0 AS rule FROM lineitem), {oracle.chosen(partition="l_orderkey")}
SELECT l_orderkey, s AS start, e AS end, priority FROM spans""",
    "structure_html": f"""WITH found AS (SELECT page_id AS doc_id, unnest(regexp_extract_all({_PLAIN_HTML}, {oracle.quoted(_ELEMENT)})) AS e, generate_subscripts(regexp_extract_all({_PLAIN_HTML}, {oracle.quoted(_ELEMENT)}), 1) - 1 AS seq FROM pages),
parts AS (SELECT doc_id, seq, regexp_extract(e, {oracle.quoted(_ELEMENT)}, 1) AS tag, regexp_extract(e, {oracle.quoted(_ELEMENT)}, 2) AS text FROM found),
n AS (SELECT doc_id, seq, tag, row_number() OVER (PARTITION BY doc_id, tag ORDER BY seq) AS n FROM parts WHERE regexp_matches(text, '[^ \\t\\n\\x0B\\f\\r]'))
SELECT doc_id, seq, CASE WHEN tag = 'header' THEN '{LABELS["header"][1]}' WHEN tag = 'footer' THEN '{LABELS["footer"][1]}' WHEN tag = 'h1' AND n = 1 THEN '{LABELS["doc_title"][1]}'
  WHEN tag = 'h1' THEN replace('{LABELS["section_title"][1]}', '{{n}}', CAST(n - 1 AS VARCHAR)) WHEN tag = 'li' THEN replace('{LABELS["list_item"][1]}', '{{n}}', CAST(n AS VARCHAR)) ELSE replace('{LABELS["paragraph"][1]}', '{{n}}', CAST(n AS VARCHAR)) END AS label FROM n""",
    "noise_filter": f"""WITH p AS (SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ') AS surface FROM part), w AS (SELECT *, {_WORDS} AS w FROM p)
SELECT p_partkey, NOT regexp_matches(surface, '\\p{{L}}') OR regexp_matches(surface, '^\\P{{L}}*\\p{{Ll}}') OR len(w) = 0 OR (len(w) = 1 AND surface = upper(surface)) OR len(list_filter(w, lambda x: NOT list_contains({language.generic_words()}, x))) = 0 AS noise FROM w""",
    "token_owners": f"WITH {_PEOPLE}, {_OWNED} SELECT doc_id, token FROM owned",
    "gazetteer_topk": f"WITH {_PEOPLE} SELECT doc_id, term, place FROM (SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY length(term) DESC, first, term) AS place FROM terms) WHERE place <= 3",
    "gazetteer_scan": f"""WITH {_PEOPLE}, {_OWNED}, u AS (SELECT doc_id, unit_seq, last, upper(surface) || ', x' || last || ' and ' || last || '.' AS text FROM people),
hits AS (SELECT u.doc_id, unit_seq, strpos(lower(text), lower(term)) - 1 AS start, length(term) AS n FROM u JOIN terms t ON u.doc_id = t.doc_id AND starts_with(text, upper(term) || ',')
  UNION ALL SELECT u.doc_id, unit_seq, strpos(text, 'Dr. ') + 3, length(term) FROM u JOIN terms t ON u.doc_id = t.doc_id AND starts_with(text, 'DR. ' || upper(term) || ',') AND NOT starts_with(text, upper(term)) AND NOT EXISTS (SELECT 1 FROM terms x WHERE x.doc_id = u.doc_id AND starts_with(text, upper(x.term) || ','))
  UNION ALL SELECT u.doc_id, unit_seq, length(text) - 1 - length(last), length(last) FROM u JOIN owned o ON u.doc_id = o.doc_id AND lower(last) = o.token)
SELECT h.doc_id, h.unit_seq, CAST(h.start AS BIGINT) AS start, CAST(h.start + h.n AS BIGINT) AS end, 'PERSON' AS kind, substr(u.text, CAST(h.start AS BIGINT) + 1, CAST(h.n AS BIGINT)) AS text
FROM hits h JOIN u ON h.doc_id = u.doc_id AND h.unit_seq = u.unit_seq""",
} | {
    name: f"WITH RECURSIVE {_shape_sql([(t, '') for t in _SHAPES])}, {oracle.raw(oracle.rules_of())}, {oracle.chosen()} SELECT doc_id, s AS start, e AS end, CAST(priority AS BIGINT) AS priority, kind, value AS text FROM spans WHERE kind IN ({', '.join(map(oracle.quoted, kinds))})"
    for name, kinds in _FAMILIES.items()
}
