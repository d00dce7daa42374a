"""Levels, kinds, marker names, labels, contexts and detection rules."""

from __future__ import annotations

from dataclasses import dataclass

SOFT, BALANCED, FULL = 1, 2, 3
LEVELS = {"soft": SOFT, "balanced": BALANCED, "full": FULL}
LANGUAGES = ("es", "en")
MODES = ("structure", "pii")


def level_of(name: str | None) -> int:
    """The level's rank; an unknown name counts as balanced."""
    return LEVELS.get((name or "").lower(), BALANCED)


def language_of(name: str | None) -> str:
    return name if name in LANGUAGES else "es"


# Marker names by kind, Spanish and English.
MARKERS = {
    "PERSON": ("NOMBRE", "NAME"), "ORG": ("ORGANIZACION", "ORGANIZATION"), "LOC": ("UBICACION", "LOCATION"), "ADDRESS": ("DIRECCION", "ADDRESS"),
    "POSTAL_CODE": ("CP", "ZIP"), "EMAIL": ("EMAIL", "EMAIL"), "PHONE": ("TELEFONO", "PHONE"), "NATIONAL_ID": ("ID_NACIONAL", "NATIONAL_ID"),
    "TAX_ID": ("ID_FISCAL", "TAX_ID"), "PASSPORT": ("PASAPORTE", "PASSPORT"), "SSN": ("NUM_SEGURIDAD_SOCIAL", "SSN"), "BIRTHDATE": ("FECHA_NACIMIENTO", "BIRTH_DATE"),
    "IBAN": ("IBAN", "IBAN"), "CARD": ("TARJETA", "CARD"), "AMOUNT": ("IMPORTE", "AMOUNT"), "CONTRACT": ("CONTRATO", "CONTRACT"), "INVOICE": ("FACTURA", "INVOICE"),
    "REFERENCE": ("REFERENCIA", "REFERENCE"), "USERNAME": ("USUARIO", "USERNAME"), "CREDENTIAL": ("CREDENCIAL", "CREDENTIAL"), "API_KEY": ("CLAVE_API", "API_KEY"),
    "TOKEN": ("TOKEN", "TOKEN"), "IP": ("IP", "IP"), "HOSTNAME": ("HOST", "HOSTNAME"), "URL": ("URL", "URL"), "PATH": ("RUTA", "PATH"), "DATABASE": ("BBDD", "DATABASE"),
    "PLATE": ("MATRICULA", "PLATE"), "HEALTH_CODE": ("DATO_SALUD", "HEALTH_DATA"), "NUMBER": ("VALOR", "VALUE"),
}

# Layout labels, Spanish and English.
LABELS = {
    "doc_title": ("[TÍTULO DEL DOCUMENTO]", "[DOCUMENT TITLE]"), "section_title": ("[TÍTULO SECCIÓN {n}]", "[SECTION TITLE {n}]"),
    "subtitle": ("[SUBTÍTULO {s}.{n}]", "[SUBTITLE {s}.{n}]"), "paragraph": ("[CONTENIDO PÁRRAFO {n}]", "[PARAGRAPH CONTENT {n}]"),
    "list_item": ("[ELEMENTO LISTA {n}]", "[LIST ITEM {n}]"), "table_cell_word": ("[CELDA TABLA FILA-{r} COL-{c}]", "[TABLE CELL ROW-{r} COL-{c}]"),
    "text_box": ("[CUADRO DE TEXTO {n}]", "[TEXT BOX {n}]"), "header": ("[ENCABEZADO]", "[HEADER]"), "footer": ("[PIE DE PÁGINA]", "[FOOTER]"),
    "slide_title": ("[TÍTULO DIAPOSITIVA {n}]", "[SLIDE TITLE {n}]"), "slide_subtitle": ("[SUBTÍTULO DIAPOSITIVA {n}]", "[SLIDE SUBTITLE {n}]"),
    "body_text": ("[TEXTO CUERPO {n}]", "[BODY TEXT {n}]"), "shape_label": ("[ETIQUETA FORMA {n}]", "[SHAPE LABEL {n}]"),
    "table_cell_pptx": ("[CELDA TABLA DIAP-{s} FILA-{r} COL-{c}]", "[TABLE CELL SLIDE-{s} ROW-{r} COL-{c}]"),
    "presenter_note": ("[NOTA PRESENTADOR DIAP-{n}]", "[PRESENTER NOTE SLIDE-{n}]"), "slide_footer": ("[PIE DIAPOSITIVA]", "[SLIDE FOOTER]"),
    "sheet_name": ("(NOMBRE HOJA {n})", "(SHEET NAME {n})"), "header_col": ("[CABECERA COL-{n}]", "[HEADER COL-{n}]"), "data_cell": ("[DATO FILA-{r} COL-{c}]", "[DATA ROW-{r} COL-{c}]"),
    "numeric_value": ("[VALOR NUMÉRICO {n}]", "[NUMERIC VALUE {n}]"), "formula": ("[FÓRMULA {n}]", "[FORMULA {n}]"), "chart_title": ("[TÍTULO GRÁFICO {n}]", "[CHART TITLE {n}]"),
}

#: Existing markers, of any number of digits.
MARKER = r"\[[A-ZÁÉÍÓÚÑ_]{2,40}_\d+\]|\([A-ZÁÉÍÓÚÑ_]{2,40}_\d+\)"
SKIP = "__SKIP__"
GAZETTEER_PRIORITY, NER_PRIORITY = 45, 40
CONTEXT_WINDOW, CONTEXT_CARRY, GAZETTEER_TERMS, LANGUAGE_SAMPLE, HEADER_ROWS = 70, 90, 400, 20_000, 8

# Words that must stand near a value, or head its column.
CONTEXTS = {
    "rut": r"\bR\.?U\.?[TN]\b|\brol\s+unico\b",
    "passport": r"\bpasaporte\b|\bpassport\b",
    "ssn": r"seguridad\s+social|afiliad|\bAf\.|\bAFP\b|\bNAF\b|\bNUSS\b|\bSSN\b|\bfonasa\b|\bisapre\b|previsi[oó]n|\bcotizante\b",
    "birth": r"naci[dmó]|f\.?\s?nac\b|fecha\s+nac|\bDOB\b|born|date\s+of\s+birth",
    "contract": r"contrato|contract|expediente|acuerdo|p[oó]liza|policy|protocolo",
    "invoice": r"factura|invoice|albar[aá]n|pedido|presupuesto|\bPO\b|boleta",
    "phone": r"tel[eé]fono|\btel\b|m[oó]vil|celular|\bfono\b|phone|contacto|whatsapp|llamar",
    "postal": r"\bC\.?P\.?\b|c[oó]digo\s+postal|\bzip\b|postal\s+code",
    "database": r"base\s+de\s+datos|database|esquema|schema|instancia|dbname|initial\s+catalog",
    "health": r"diagn[oó]stic|\bCIE-?10\b|patolog|morbilidad",
}
SENSITIVE_HEADER = (
    r"salario|sueldo|remunerac|haber|l[ií]quido|bruto|neto|renta|ingreso|importe|monto|precio|tarifa|coste|costo|presupuesto|prima|bonific|"
    r"comisi[oó]n|honorario|deuda|saldo|capital|patrimonio|edad|\bage\b|peso|altura|\bimc\b|\brut\b|\bdni\b|\bnif\b|\bnie\b|c[eé]dula|identidad|pasaporte|"
    r"tel[eé]fono|m[oó]vil|celular|phone|contacto|afiliado|seguridad\s+social|cuenta|iban|tarjeta|salary|amount|price|budget|wage|income|revenue"
)


@dataclass(frozen=True)
class RuleSpec:
    """A detection rule.  ``pattern`` is a Java expression without flags; ``group``: the span is capture
    group 1, which stands last in the pattern; ``check`` names a validator, ``required`` says that failing it drops the span."""

    kind: str
    pattern: str
    priority: int
    level: int
    ignore_case: bool = False
    group: bool = False
    context: str | None = None
    check: str | None = None
    required: bool = True

    @property
    def regex(self) -> str:
        return ("(?iU)" if self.ignore_case else "(?U)") + self.pattern


_DNI = "[TRWAGMYFPDXBNJZSQVHLCKE]"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_NUMBER = r"\d{1,3}(?:[.,\s]\d{3})*(?:[.,]\d{1,2})?\s?"
_LABELLED = r"\b[\s\w.º°-]{0,18}?[:\s#]\s*((?-i:[A-Z0-9][A-Z0-9/_.-]{4,}))"
_DATE = r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b"

# The rules in order (the order breaks ties).
RULES = [
    RuleSpec(SKIP, MARKER, 999, SOFT),
    RuleSpec("NATIONAL_ID", r"\b\d{1,2}\.\d{3}\.\d{3}\s*-\s*[\dkK]\b", 100, SOFT, check="rut", required=False),
    RuleSpec("NATIONAL_ID", r"\b\d{7,8}\s*-\s*[\dkK]\b", 100, SOFT, context="rut", check="rut", required=False),
    RuleSpec("NATIONAL_ID", rf"\b\d{{8}}\s*-?\s*{_DNI}\b", 100, SOFT, check="dni", required=False),
    RuleSpec("NATIONAL_ID", rf"\b[XYZ]\s*-?\s*\d{{7}}\s*-?\s*{_DNI}\b", 100, SOFT, check="nie", required=False),
    RuleSpec("TAX_ID", r"\b[ABCDEFGHJNPQRSUVW]\s*-?\s*\d{7}\s*-?\s*[0-9A-J]\b", 100, SOFT, check="cif"),
    RuleSpec("PASSPORT", r"\b[A-Z]{2,3}\d{6}[A-Z]?\b", 100, SOFT, context="passport"),
    RuleSpec("SSN", r"\b\d{2,3}\s*-\s*\d{6,8}\b", 100, SOFT, context="ssn"),
    RuleSpec("SSN", r"\b\d{3}-\d{2}-\d{4}\b", 100, SOFT),
    RuleSpec("IBAN", r"\b[A-Z]{2}\d{2}(?:\s?[A-Z0-9]{4}){3,7}\b", 100, SOFT, check="iban"),
    RuleSpec("CARD", r"\b(?:\d[ -]?){13,19}\b", 100, SOFT, check="luhn"),
    RuleSpec("CREDENTIAL", r"\b(?:contrase[nñ]a|password|passwd|pwd|clave|secret)\b\s*[:=]\s*[\"']?([^\s\"',;]{4,})", 95, SOFT, ignore_case=True, group=True),
    RuleSpec("API_KEY", r"\b(?:api[_-]?key|access[_-]?token|bearer|authorization)\b\s*[:=]?\s*[\"']?([A-Za-z0-9._\-]{16,})", 95, SOFT, ignore_case=True, group=True),
    RuleSpec("API_KEY", r"\b(?:sk|pk|rk)_(?:live|test)_[A-Za-z0-9]{16,}\b", 95, SOFT),
    RuleSpec("API_KEY", r"\bAKIA[0-9A-Z]{16}\b", 95, SOFT),
    RuleSpec("API_KEY", r"\bgh[pousr]_[A-Za-z0-9]{20,}\b", 95, SOFT),
    RuleSpec("TOKEN", r"\bey[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\b", 95, SOFT),
    RuleSpec("USERNAME", r"\b(?:usuario|user(?:name)?|login|cuenta)\b\s*[:=]\s*[\"']?([A-Za-z0-9._@-]{3,})", 95, SOFT, ignore_case=True, group=True),
    RuleSpec("EMAIL", r"\b[\w.+-]+@[\w-]+(?:\.[\w-]+)+\b", 90, SOFT),
    RuleSpec("URL", r"\bhttps?://[^\s<>\"'\)\]]+", 90, BALANCED),
    RuleSpec("URL", r"\bwww\.[a-z0-9-]+(?:\.[a-z]{2,})+[^\s<>\"'\)\]]*", 90, FULL, ignore_case=True),
    RuleSpec("PHONE", r"(?:\+|00)\s?56\s?9\s?\d{4}\s?\d{4}\b", 85, SOFT),
    RuleSpec("PHONE", r"(?:(?:\+|00)\s?34[\s.-]?)?\b[6789]\d{2}[\s.-]\d{3}[\s.-]?\d{3}\b", 85, SOFT),
    RuleSpec("PHONE", r"\b[6789]\d{8}\b", 85, SOFT, context="phone"),
    RuleSpec("PHONE", r"\+\d{1,3}[\s.()-]?(?:\d[\s.()-]?){6,14}\d", 85, SOFT),
    RuleSpec("IP", rf"\b(?:{_OCTET}\.){{3}}{_OCTET}(?::\d{{1,5}})?\b", 80, BALANCED),
    RuleSpec("PATH", r"\\\\[A-Za-z0-9._-]+\\[^\s\"'<>|]+", 50, BALANCED),
    RuleSpec("PATH", r"\b[A-Za-z]:\\[^\s\"'<>|]{2,}", 50, BALANCED),
    RuleSpec("PATH", r"(?<![\w/])/(?:etc|var|opt|srv|home|usr|mnt|data)/[^\s\"'<>|]+", 50, BALANCED),
    RuleSpec("HOSTNAME", r"\b[a-z0-9][a-z0-9-]{1,30}\.(?:local|lan|internal|corp|intranet|int|priv)\b", 50, BALANCED, ignore_case=True),
    RuleSpec("HOSTNAME", r"\b(?:srv|server|host|node|db|app|web|vm|bbdd)[a-z0-9-]*\d{1,4}\b", 50, BALANCED, ignore_case=True),
    RuleSpec("DATABASE", r"(?:base\s+de\s+datos|database|esquema|schema|dbname|initial\s+catalog)\s*[:=]?\s*[\"']?([A-Za-z_][A-Za-z0-9_]{2,})", 50, BALANCED, ignore_case=True, group=True, context="database"),
    RuleSpec("CONTRACT", r"\b(?:contrato|contract|expediente|acuerdo|p[oó]liza|policy|protocolo)" + _LABELLED, 78, BALANCED, ignore_case=True, group=True, context="contract"),
    RuleSpec("INVOICE", r"\b(?:factura|invoice|albar[aá]n|pedido|presupuesto|boleta)" + _LABELLED, 78, BALANCED, ignore_case=True, group=True, context="invoice"),
    RuleSpec("REFERENCE", r"\b[A-Z]{2,5}-\d{4}-[A-Z0-9]{2,10}\b", 70, BALANCED),
    RuleSpec("REFERENCE", r"\b\d{4}-[A-Z]{2,5}-[A-Z0-9]{2,10}\b", 70, BALANCED),
    RuleSpec("REFERENCE", r"\bn[º°o]?\s*(?:af(?:iliado)?|cliente|socio|miembro|registro)\b[\s.:]*((?-i:[A-Z0-9][A-Z0-9/_.-]{3,}))", 78, BALANCED, ignore_case=True, group=True),
    RuleSpec("AMOUNT", r"(?<![\w.,])(?:US\$|\$|€|£|EUR|USD|CLP|UF|UTM)\s?" + _NUMBER + r"(?:[MKB](?!\w)|millones)?", 65, BALANCED, ignore_case=True),
    RuleSpec("AMOUNT", r"(?<![\w.,])" + _NUMBER + r"(?:€|EUR|euros?|USD|US\$|d[oó]lares|CLP|pesos|UF|UTM)\b", 65, BALANCED, ignore_case=True),
    RuleSpec("BIRTHDATE", _DATE, 60, BALANCED, context="birth"),
    RuleSpec("BIRTHDATE", r"\b\d{1,2}\s+de\s+[a-záéíóú]+\s+de\s+\d{4}\b", 60, BALANCED, ignore_case=True, context="birth"),
    RuleSpec("BIRTHDATE", _DATE, 60, FULL),
    RuleSpec(
        "ADDRESS",
        r"\b(?:c/|calle|avenida|avda?\.?|av\.|plaza|pl\.|paseo|psje\.?|pasaje|camino|ctra\.?|carretera|traves[ií]a|ronda|rda\.|pol[ií]gono)\s+[A-ZÁÉÍÓÚÑ]"
        r"[\wáéíóúñÁÉÍÓÚÑ'.\s-]{2,45}?\s*n?[º°]?\s*\d{1,5}(?:[.,]\d{3})?(?:\s*,\s*(?:dpto|depto|of|oficina|piso|casa|block)\.?\s*[\w-]{1,8})?",
        55, BALANCED, ignore_case=True,
    ),
    RuleSpec("POSTAL_CODE", r"\b\d{5}\b", 55, FULL, context="postal"),
    RuleSpec("HEALTH_CODE", r"\b[A-Z]\d{2}(?:\.\d{1,2})?\b", 70, BALANCED, context="health"),
    RuleSpec("PLATE", r"\b\d{4}\s?[BCDFGHJKLMNPRSTVWXYZ]{3}\b", 70, BALANCED),
]

# Optional rules for shapes that the catalogue above does not know.
EXTRA_RULES = [
    RuleSpec("PHONE", r"\+\d{1,3}\s\(\d{2,4}\)\s\d{3}-\d{4}\b", 85, SOFT),
    RuleSpec("TOKEN", r"\btoken\b\s*[:=]\s*[\"']?([A-Za-z0-9._\-]{16,})", 95, SOFT, ignore_case=True, group=True),
]


def active_rules(level: int, extra: bool = False) -> list[tuple[int, RuleSpec]]:
    """Rules of a level with their ordinals; the level is folded in when the plan is built."""
    return [(k, r) for k, r in enumerate(RULES + (EXTRA_RULES if extra else [])) if r.level <= level]
