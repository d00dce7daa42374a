"""The redaction plan: units → spans → entities → markers → text.

Whole texts are redacted within their rows: nothing moves, no id is needed, so
rows with a null or a repeated id are documents of their own.  Units that come
as rows of their own are numbered by document; a unit is known by its document
(null is one) and its text and context, so rows that repeat a place are
redacted each by its own text.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import GAZETTEER_TERMS, LANGUAGES, LEVELS, MODES, NER_PRIORITY, language_of, level_of
from ..functions.text import entity_key, guarded, marker, once
from ..operators import registry
from ..operators.language import accepted, detect_language
from ..operators.spans import SPANS, detect, resolve_overlaps
from ..operators.splice import REPLACEMENTS, splice, splice_segments
from ..operators.units import document_units, row_units

NAMES_SOURCE_RULE = 9_000


class RecogniserMissing(RuntimeError):
    """Raised if a name recogniser is required and none is given."""


def modes() -> dict[str, list[str]]:
    return {"modes": list(MODES), "levels": list(LEVELS), "languages": list(LANGUAGES)}


def _unit(text: str = "text", context: str = "context") -> Column:
    return F.md5(F.concat(F.coalesce(text, F.lit("")), F.lit("\x00"), F.coalesce(context, F.lit(""))))


def _same(left: DataFrame, right: DataFrame, columns: list[str], how: str = "left") -> DataFrame:
    """A join by equal columns in which null equals null; the columns of ``left`` stay."""
    other = right.select(*(F.col(c).alias(f"__r_{c}__") for c in columns), *(c for c in right.columns if c not in columns))
    on = [F.col(c).eqNullSafe(F.col(f"__r_{c}__")) for c in columns]
    return left.join(other, on, how).drop(*(f"__r_{c}__" for c in columns))


@dataclass(frozen=True)
class Anonymizer:
    """``level``: soft, balanced or full; ``language`` of the markers: es or en.

    ``names``: spans of a name recogniser (doc_id, unit_seq, start, end, label,
    text), from whatever model (see :mod:`redactra.operators.recogniser`);
    without it, a warning says so, or an error if ``require_names``.
    ``generic_terms``: further words that make no name alone.
    ``known_terms``: names and surnames of a document that are looked for in
    all of its units, the longest first; None for all of them.
    ``warnings``: codes of the recogniser's stage, passed on by :meth:`stats`.
    """

    level: str = "balanced"
    language: str = "es"
    names: DataFrame | None = None
    require_names: bool = False
    extra_rules: bool = False
    generic_terms: Iterable[str] = ()
    known_terms: int | None = GAZETTEER_TERMS
    warnings: tuple[dict, ...] = field(default=())

    def __post_init__(self) -> None:
        if self.names is None and self.require_names:
            raise RecogniserMissing("a name recogniser is required: pass its spans as names")

    @property
    def engine(self) -> str:
        return "names+regex" if self.names is not None else "regex-only"

    def _detect(self, text: Column, context: Column) -> Column:
        return detect(text, context, level_of(self.level), extra=self.extra_rules)

    def spans(self, units: DataFrame) -> DataFrame:
        """Units (doc_id, unit_seq, text, context) with ``spans``: disjoint, by start."""
        units = units.withColumn("__g__", guarded(F.col("text")))
        found = self._detect(F.col("__g__"), F.col("context"))
        if self.names is not None:
            units = _same(units.withColumn("__u__", _unit()), self._own_names(units), ["doc_id", "__u__"])
            found = F.concat(found, F.coalesce(F.col("__names__").cast(SPANS), F.array().cast(SPANS)))
        return units.withColumn("spans", once(resolve_overlaps(found))).drop("__g__", "__names__", "__u__")

    def _own_names(self, units: DataFrame) -> DataFrame:
        """doc_id, __u__, __names__: accepted names, for each text that a document holds."""
        kind = accepted(F.col("label"), F.col("text"), level_of(self.level), self.generic_terms)
        own = self.names.withColumn("kind", kind).where("kind is not null and end > start")
        span = F.struct(
            F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "kind", F.col("text").alias("text"),
            F.lit(NER_PRIORITY).alias("priority"), F.lit("ner").alias("source"), F.lit(NAMES_SOURCE_RULE).alias("rule"),
        )
        own = own.select("doc_id", F.col("unit_seq").cast("long").alias("unit_seq"), span.alias("__span__"))
        places = units.select("doc_id", F.col("unit_seq").cast("long").alias("unit_seq"), _unit().alias("__u__")).distinct()
        return _same(own, places, ["doc_id", "unit_seq"], "inner").groupBy("doc_id", "__u__").agg(F.sort_array(F.collect_set("__span__")).alias("__names__"))

    def replacements(self, units: DataFrame) -> DataFrame:
        """doc_id, unit_seq, unit, kind, n, marker, start, end, text: one row for each replacement of each row of ``units``."""
        spans = self.spans(units).select("doc_id", "unit_seq", "text", "context", _unit().alias("unit"), "spans")
        rows = self._by_rules(spans) if self.names is None else self._by_rules_and_names(spans)
        name = F.coalesce(marker(F.col("kind"), F.col("n"), language_of(self.language)), F.col("text"))
        return rows.select("doc_id", "unit_seq", "unit", "kind", F.when(F.col("key") != "", F.col("n")).alias("n"), name.alias("marker"), "start", "end", "text")

    @staticmethod
    def _exploded(spans: DataFrame) -> DataFrame:
        rows = spans.select("doc_id", "unit_seq", "unit", F.explode("spans").alias("s")).select("doc_id", "unit_seq", "unit", "s.*")
        return rows.withColumn("key", entity_key(F.col("text"), F.col("kind")))

    def _by_rules(self, spans: DataFrame) -> DataFrame:
        # windows over the spans alone, dealt out by document once: what was found is not worked out twice
        rows = self._exploded(spans).repartition("doc_id").withColumn("named", F.col("key") != "")
        first = F.min(F.struct("unit_seq", "start")).over(Window.partitionBy("doc_id", "kind", "key"))
        return rows.withColumn("first", first).withColumn("n", F.dense_rank().over(Window.partitionBy("doc_id", "kind", "named").orderBy("first"))).drop("first", "named")

    def _by_rules_and_names(self, spans: DataFrame) -> DataFrame:
        """As :meth:`_by_rules`, with aliases, and with known names looked for in every unit of their document.

        Entities are numbered in the order of first sight, those that only the
        search for known names shows after all others.
        """

        def sights(rows: DataFrame, step: int) -> DataFrame:
            # a text that a document repeats is seen once, at its first place
            own = rows.where("key <> ''").groupBy("doc_id", "unit", "start", "kind", "key", "text").agg(F.min("unit_seq").alias("unit_seq"))
            return own.withColumn("step", F.lit(step))

        spans = spans.persist(StorageLevel.MEMORY_AND_DISK)  # read by each of the passes
        first = sights(self._exploded(spans), 0)
        people = registry.fold_people(first.where("kind = 'PERSON'"))
        known = registry.gazetteer(first, people, self.known_terms)
        units = _same(spans, known, ["doc_id"])
        more = registry.gazetteer_spans(guarded(F.col("text")), F.col("names"), F.col("kinds"), F.col("surnames"))
        units = units.withColumn("more", once(more))
        final = F.when(F.size("more") > 0, resolve_overlaps(F.concat("spans", "more"))).otherwise(F.col("spans"))
        rows = self._exploded(units.withColumn("spans", once(final)))
        seen = first.unionByName(sights(rows, 1))
        numbers = registry.number_entities(seen.where("kind <> 'PERSON'"), self.language, ("step", "unit_seq", "start")).select("doc_id", "kind", "key", "n")
        people = registry.fold_people(seen.where("kind = 'PERSON'")).where("step = 1").select("doc_id", "unit", "start", F.lit("PERSON").alias("kind"), F.col("n").alias("person"))
        rows = _same(_same(rows, numbers, ["doc_id", "kind", "key"]), people, ["doc_id", "unit", "start", "kind"])
        return rows.withColumn("n", F.coalesce("n", "person"))

    def transform(self, units: DataFrame) -> DataFrame:
        """Units with ``redacted`` (and ``redacted_segments`` if there is a segments column) and ``replaced``."""
        found = self.replacements(units)
        edits = F.array_sort(F.collect_set(F.struct("start", "end", "marker"))).cast(REPLACEMENTS)
        each = found.groupBy("doc_id", F.col("unit").alias("__u__")).agg(edits.alias("__r__"))
        rows = _same(units.withColumn("__u__", _unit()), each, ["doc_id", "__u__"])
        put = F.when(F.col("__r__").isNull(), F.col("text")).otherwise(splice(F.col("text"), F.col("__r__")))
        rows = rows.withColumn("redacted", put).withColumn("replaced", F.coalesce(F.size("__r__"), F.lit(0)))
        if "segments" in units.columns:
            put = F.when(F.col("__r__").isNull(), F.col("segments")).otherwise(splice_segments(F.col("segments"), F.col("__r__")))
            rows = rows.withColumn("redacted_segments", put)
        return rows.drop("__r__", "__u__")

    def stats(self, units: DataFrame) -> DataFrame:
        """doc_id, total_occurrences, total_distinct, labels (in order), by_kind, engine, doc_lang, level, warnings."""
        found = self.replacements(units)
        first = found.groupBy("doc_id", "kind", "marker").agg(F.min(F.struct("unit_seq", "start")).alias("at"), F.count("*").alias("times"), F.count_distinct("unit", "start").alias("own"))
        per = first.groupBy("doc_id").agg(
            F.sum("times").alias("total_occurrences"), F.sum("own").alias("total_distinct"),
            F.transform(F.array_sort(F.collect_list(F.struct("at", "marker"))), lambda x: x["marker"]).alias("labels"), F.collect_list("kind").alias("__k__"),
        )
        kinds = F.array_sort(F.array_distinct("__k__"))
        counts = F.transform(kinds, lambda k: F.size(F.filter("__k__", lambda x: x == k)))
        per = per.withColumn("by_kind", F.map_from_arrays(kinds, counts)).drop("__k__")
        out = _same(detect_language(units, language_of(self.language)).withColumnRenamed("lang", "doc_lang"), per, ["doc_id"])
        out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("total_occurrences", "total_distinct")})
        codes = [*self.warnings, *([] if self.names is not None or self.warnings else [{"code": "recogniser_missing"}])]
        said = F.array(*(F.create_map(*(F.lit(x) for pair in w.items() for x in pair)) for w in codes))
        return out.withColumn("engine", F.lit(self.engine)).withColumn("level", F.lit(self.level)).withColumn("warnings", said.cast("array<map<string,string>>"))


def _numbered(rows: DataFrame) -> DataFrame:
    """Rows with ``spans`` (an array for each unit) and ``numbered``: all spans in order (unit, start, end, kind, text)
    with each one's number in the document.

    Sorted by entity, the places of one entity stand together: the first of
    them is where it was first seen, and entities sorted by that are numbered
    within their kind.  No step is worse than a sort.
    """
    place = lambda i, s: F.struct(i.alias("unit"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["text"].alias("text"))
    rows = rows.withColumn("seen", once(F.flatten(F.transform("spans", lambda own, i: F.transform(own, lambda s: place(i, s))))))
    named = F.transform("seen", lambda s, j: F.struct(s["kind"].alias("kind"), entity_key(s["text"], s["kind"]).alias("key"), j.alias("at")))
    rows = rows.withColumn("sorted", once(F.array_sort(named)))
    new = lambda s, j: (j == 0) | (s["kind"] != F.get("sorted", j - 1)["kind"]) | (s["key"] != F.get("sorted", j - 1)["key"])
    starts = F.filter(F.transform("sorted", lambda s, j: F.when(new(s, j), j)), lambda j: j.isNotNull())
    rows = rows.withColumn("starts", once(starts))
    # entities by kind and first place; one without a key is none, and keeps its text
    entities = F.transform("starts", lambda j, g: F.struct(F.get("sorted", j)["kind"].alias("kind"), F.get("sorted", j)["at"].alias("at"), g.alias("g"), F.get("sorted", j)["key"].alias("key")))
    rows = rows.withColumn("entities", once(F.array_sort(F.filter(entities, lambda e: e["key"] != ""))))
    kinds = F.array_distinct(F.transform("entities", lambda e: e["kind"]))
    counted = F.flatten(F.transform(kinds, lambda k: F.transform(F.filter("entities", lambda e: e["kind"] == k), lambda e, i: F.struct(e["g"].alias("g"), (i + 1).alias("n")))))
    rows = rows.withColumn("counted", once(F.array_sort(counted)))
    end = lambda g: F.coalesce(F.get("starts", g + 1), F.size("sorted"))
    group = lambda e: F.slice(F.col("sorted"), F.get("starts", e["g"]) + 1, end(e["g"]) - F.get("starts", e["g"]))
    numbers = F.flatten(F.transform("counted", lambda e: F.transform(group(e), lambda s: F.struct(s["at"].alias("at"), e["n"].alias("n")))))
    rows = rows.withColumn("numbers", once(F.array_sort(numbers)))
    numbered = F.transform("numbers", lambda x: F.struct(F.get("seen", x["at"]).alias("s"), x["n"].alias("n")))
    return rows.withColumn("numbered", once(numbered)).drop("seen", "sorted", "starts", "entities", "counted", "numbers")


def redact_rows(docs: DataFrame, anonymizer: Anonymizer, text_col: str = "text") -> DataFrame:
    """``docs`` with ``redacted``: each row's text is a document, its lines are units with the line before as context.

    All within the row: no shuffle, no id.  A null text stays null.
    """
    if anonymizer.names is not None:
        raise ValueError("spans of a recogniser belong to documents by id: use anonymize_texts")
    kept = [F.col(f"`{c}`").alias(f"__own_{k}__") for k, c in enumerate(docs.columns)]
    rows = row_units(docs.select(*kept, F.col(f"`{text_col}`").alias("text")), "text")
    spans = F.transform("u", lambda u: resolve_overlaps(anonymizer._detect(guarded(u["text"]), u["context"])))
    rows = _numbered(rows.withColumn("spans", once(spans)))
    language = language_of(anonymizer.language)
    edit = lambda x: F.struct(x["s"]["start"].alias("start"), x["s"]["end"].alias("end"), marker(x["s"]["kind"], x["n"], language).alias("marker"))
    first = F.filter(
        F.transform("numbered", lambda x, j: F.when((j == 0) | (x["s"]["unit"] != F.get("numbered", j - 1)["s"]["unit"]), j)), lambda j: j.isNotNull()
    )
    rows = rows.withColumn("first", once(first))
    size = lambda g: F.coalesce(F.get("first", g + 1), F.size("numbered")) - F.get("first", g)
    own = lambda j, g: F.transform(F.slice(F.col("numbered"), j + 1, size(g)), edit).cast(REPLACEMENTS)
    unit = lambda j: F.get("u", F.get("numbered", j)["s"]["unit"])
    line = lambda at, after, text: F.struct(at.alias("at"), after.alias("after"), text.alias("text"))
    changed = F.transform("first", lambda j, g: line(unit(j)["unit_seq"], F.lit(1), splice(unit(j)["text"], own(j, g))))
    # the lines as they were, and behind a line that changed what it became
    both = F.array_sort(F.concat(F.transform(F.split("text", "\n"), lambda x, i: line(i, F.lit(0), x)), changed))
    rows = rows.withColumn("both", once(F.when(F.size("first") > 0, both)))
    last = F.filter("both", lambda x, j: F.coalesce(F.get("both", j + 1)["at"] != x["at"], F.lit(True)))
    redacted = F.when(F.col("both").isNull(), F.col("text")).otherwise(F.array_join(F.transform(last, lambda x: x["text"]), "\n"))
    return rows.select(*(F.col(f"__own_{k}__").alias(c) for k, c in enumerate(docs.columns)), redacted.alias("redacted"))


def anonymize_texts(docs: DataFrame, anonymizer: Anonymizer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and redacted: whole texts, their lines as units with the line before as context.

    Without a recogniser each row is a document, whatever its id.  With one,
    rows that share an id are one document, since names belong to ids.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    if anonymizer.names is None:
        return redact_rows(rows, anonymizer).select("doc_id", "redacted")
    found = anonymizer.replacements(document_units(rows, "doc_id", "text"))
    edits = F.array_sort(F.collect_set(F.struct("start", "end", "marker"))).cast(REPLACEMENTS)
    lines = found.groupBy("doc_id", "unit").agg(edits.alias("r")).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("unit", "r"))).alias("m"))
    rows = _same(row_units(rows, "text"), lines, ["doc_id"])
    put = F.transform("u", lambda u: F.struct(u["unit_seq"].alias("at"), F.lit(1).alias("after"), F.try_element_at("m", _unit(u["text"], u["context"])).alias("r"), u["text"].alias("text")))
    put = F.transform(F.filter(put, lambda x: x["r"].isNotNull()), lambda x: F.struct(x["at"], x["after"], splice(x["text"], x["r"]).alias("text")))
    as_was = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("at"), F.lit(0).alias("after"), x.alias("text")))
    rows = rows.withColumn("both", once(F.when(F.col("m").isNotNull(), F.array_sort(F.concat(as_was, put)))))
    last = F.filter("both", lambda x, j: F.coalesce(F.get("both", j + 1)["at"] != x["at"], F.lit(True)))
    whole = F.array_join(F.transform(last, lambda x: x["text"]), "\n")
    return rows.select("doc_id", F.when(F.col("both").isNull(), F.col("text")).otherwise(whole).alias("redacted"))
