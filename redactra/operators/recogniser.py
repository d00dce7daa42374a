"""The stage of a name recogniser: whatever model, run in batches over distinct texts, with what it lacks said aloud."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import LANGUAGES, language_of
from ..session import ship
from .language import detect_language

#: What a model returns for each text: start, end (code points) and label of each entity.
Entities = list[list[tuple[int, int, str]]]
#: The label of a row that says that a model failed on a text; no filter takes it for a kind.
FAILED = "recogniser_failed"
BATCH = 64
#: Code points of a text beyond which a model is not asked for it all at once, but stretch by stretch.
MAX_TEXT = 3_000_000

_models: dict[tuple[str, str], Callable[[list[str]], Entities] | None] = {}


@dataclass(frozen=True)
class Recogniser:
    """``load(language)`` gives a model, called in the workers and once in each; ``languages``: those that have one.

    ``name`` tells models of one worker apart.
    """

    load: Callable[[str], Callable[[list[str]], Entities]]
    languages: tuple[str, ...] = LANGUAGES
    name: str = "recogniser"
    batch: int = BATCH

    def model(self, language: str) -> Callable[[list[str]], Entities] | None:
        """The worker's model; one that could not be loaded is not tried again."""
        key = (self.name, language)
        if key not in _models:
            try:
                _models[key] = self.load(language)
            except Exception:  # noqa: BLE001  whatever a model's loader raises
                _models[key] = None
        return _models[key]

    def warnings(self) -> tuple[dict, ...]:
        """No model at all, or another language's in the place of one that is missing."""
        if not self.languages:
            return ({"code": "models_missing"},)
        return tuple({"code": "model_fallback", "missing": x, "used": self.languages[0]} for x in LANGUAGES if x not in self.languages)


def recognise(units: DataFrame, recogniser: Recogniser, fallback: str = "es") -> DataFrame:
    """doc_id, unit_seq, start, end, label, text: what the model of each document's language finds in its units.

    Each distinct text of a language is asked for once.  A batch on which a model
    fails is tried text by text; a text on which it fails gives one row of label
    ``recogniser_failed``.  Null and blank texts hold nothing, an empty table or
    a recogniser without models gives an empty result.
    """
    ship(units.sparkSession)
    spoken = detect_language(units, language_of(fallback)).select(F.col("doc_id").alias("__d__"), "lang")
    known = recogniser.languages
    model = F.when(F.col("lang").isin(*known), F.col("lang")).otherwise(known[0]) if known else F.lit(None).cast("string")
    rows = units.where(F.col("text").rlike(r"(?U)\S")).join(spoken, F.col("doc_id").eqNullSafe(F.col("__d__"))).select("doc_id", F.col("unit_seq").cast("int").alias("unit_seq"), model.alias("lang"), "text")
    rows = rows.where("lang is not null")
    distinct = rows.select("lang", "text").distinct()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def ask(language: str, texts: list[str]) -> Iterator[tuple]:
            own = recogniser.model(language)
            for a in range(0, len(texts), recogniser.batch):
                some = texts[a : a + recogniser.batch]
                try:
                    found = own(some)
                except Exception:  # noqa: BLE001  whatever a model raises
                    found = [one(own, t) for t in some]
                yield from zip(some, found, strict=True)

        def one(own, text: str) -> list[tuple[int, int, str]]:
            try:
                return own([text])[0]
            except Exception:  # noqa: BLE001
                return [(0, 0, FAILED)]

        for batch in batches:
            by_language: dict[str, list[str]] = {}
            for language, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by_language.setdefault(language, []).append(text)
            out = []
            for language, texts in by_language.items():
                # a very long text in stretches, each with its own offsets
                parts = [(t, at, t[at : at + MAX_TEXT]) for t in texts for at in range(0, len(t), MAX_TEXT)]
                for (t, at, _), (part, found) in zip(parts, ask(language, [p for _, _, p in parts]), strict=True):
                    out += [(language, t, at + s, at + e, label, part[s:e]) for s, e, label in found]
            columns = list(zip(*out, strict=True)) or [[]] * 6
            kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["l", "t", "start", "end", "label", "name"])

    found = distinct.mapInArrow(run, "l string, t string, start int, end int, label string, name string")
    return rows.join(found, (F.col("lang") == F.col("l")) & (F.col("text") == F.col("t"))).select("doc_id", "unit_seq", "start", "end", "label", F.col("name").alias("text"))


def with_recogniser(anonymizer, units: DataFrame, recogniser: Recogniser | None):
    """The anonymizer with the recogniser's spans of these units and its warnings; without models, as if there were none."""
    from dataclasses import replace

    if recogniser is None or not recogniser.languages:
        code = "recogniser_missing" if recogniser is None else "models_missing"
        if anonymizer.require_names:
            from ..plans.anonymize import RecogniserMissing

            raise RecogniserMissing(code)
        return replace(anonymizer, names=None, warnings=({"code": code},))
    return replace(anonymizer, names=recognise(units, recogniser, anonymizer.language), warnings=recogniser.warnings())
