"""Detection of spans by rules, and their overlaps."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..catalog import CONTEXT_WINDOW, CONTEXTS, RULES, SKIP, RuleSpec, active_rules
from ..functions.text import CHECKS, fenced, fenced_matches

SPANS = "array<struct<start:int,end:int,kind:string,text:string,priority:int,source:string,rule:int>>"

#: A unit without any of these holds no match of any rule: a digit, @ / \ : =, or a keyword of a rule that needs neither.
_GATE = r"(?iU)[\d@/\\:=]|www\.|bearer|authorization|api[_-]?key|access[_-]?token|base\s+de\s+datos|database|esquema|schema|dbname|catalog|contra[ct]|expediente|acuerdo|p[oó]liza|policy|protocolo|factura|invoice|albar|pedido|presupuesto|boleta|\bn[º°o]?\s*(?:af|cliente|socio|miembro|registro)|[a-z0-9-]\.(?:local|lan|internal|corp|intranet|int|priv)\b|\bey[a-z0-9_-]{8}|(?:sk|pk|rk)_(?:live|test)_|AKIA|gh[pousr]_|[(\[][A-Z_]"


def _looked_up(rules: Sequence[tuple[int, RuleSpec]], field: Callable[[RuleSpec], object]) -> Callable[[Column], Column]:
    """A field of a rule by its ordinal: a constant array, so that the plan holds it once."""
    known = dict(rules)
    values = [field(known[k]) if k in known else field(rules[0][1]) for k in range(max(known) + 1)]
    return lambda ordinal: F.get(F.array(*map(F.lit, values)), ordinal)


def _by_group(rules: Sequence[tuple[int, RuleSpec]], field: str, ordinal: Column, value: Callable[[str], Column], default: Column) -> Column:
    """``value`` of the rule's ``field``; ``default`` for rules without it."""
    groups: dict[str, list[int]] = {}
    for k, r in rules:
        if getattr(r, field):
            groups.setdefault(getattr(r, field), []).append(k)
    for name, ordinals in reversed(groups.items()):
        default = F.when(ordinal.isin(ordinals), value(name)).otherwise(default)
    return default


def detect(text: Column, context: Column, level: int, rules: Sequence[tuple[int, RuleSpec]] | None = None, extra: bool = False) -> Column:
    """All spans of the active rules.  Rules above the level are not part of the plan.

    Each rule adds only its test and its fences to the plan; what follows (offsets, the word that must be
    near, check digits, priorities) stands there once and runs over the rules that hit.
    """
    active = active_rules(level, extra) if rules is None else rules
    if not active:
        return F.array().cast(SPANS)
    hits = F.array_compact(
        F.array(*(F.when(text.rlike(r.regex), F.struct(F.lit(k).alias("rule"), fenced(text, r.regex, r.group).alias("fences"))) for k, r in active))
    )
    found = F.flatten(F.transform(hits, lambda h: F.transform(fenced_matches(h["fences"]), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["text"].alias("text"), h["rule"].alias("rule")))))

    if any(r.context for _, r in active):

        def near(m: Column) -> Column:
            lo = F.greatest(F.lit(0), m["start"] - CONTEXT_WINDOW)
            around = F.substring(text, lo + 1, m["end"] + CONTEXT_WINDOW - lo)
            said = lambda name: around.rlike("(?iU)" + CONTEXTS[name]) | F.coalesce(context, F.lit("")).rlike("(?iU)" + CONTEXTS[name])
            return _by_group(active, "context", m["rule"], said, F.lit(True))

        found = F.filter(found, near)

    kind, priority, required = (_looked_up(active, f) for f in (lambda r: r.kind, lambda r: r.priority, lambda r: bool(r.check and r.required)))
    valid = lambda m: F.coalesce(_by_group(active, "check", m["rule"], lambda name: CHECKS[name](m["text"]), F.lit(False)), F.lit(False))

    def span(m: Column) -> Column:
        rank = priority(m["rule"]) + (F.when(valid(m), 10).otherwise(0) if any(r.check for _, r in active) else F.lit(0))
        return F.struct(m["start"].alias("start"), m["end"].alias("end"), kind(m["rule"]).alias("kind"), m["text"].alias("text"), rank.alias("priority"), F.lit("regex").alias("source"), m["rule"].alias("rule"))

    # a rule's check adds 10 to its priority, or is the condition of the span
    sound = F.filter(F.transform(found, span), lambda s: ~required(s["rule"]) | (s["priority"] > priority(s["rule"])))
    return F.when(text.rlike(_GATE), sound.cast(SPANS)).otherwise(F.array().cast(SPANS))


def at_level(spans: Column, level: int) -> Column:
    """The spans that the rules of a level found."""
    own = _looked_up(list(enumerate(RULES)), lambda r: r.level)
    return F.filter(spans, lambda s: own(s["rule"]) <= level)


def resolve_overlaps(spans: Column) -> Column:
    """Disjoint spans: higher priority first, then longer, then further left, then by rule; existing markers
    win and go.  In order of start."""

    def before(a: Column, b: Column) -> Column:
        rank = lambda s: F.struct(-s["priority"], s["start"] - s["end"], s["start"], s["rule"], s["kind"])
        return F.when(rank(a) < rank(b), -1).when(rank(a) > rank(b), 1).otherwise(0)

    def accept(kept: Column, s: Column) -> Column:
        clash = F.exists(kept, lambda o: (s["start"] < o["end"]) & (o["start"] < s["end"]))
        return F.when(clash, kept).otherwise(F.concat(kept, F.array(s)))

    chosen = F.aggregate(F.array_sort(spans, before), F.array().cast(SPANS), accept)
    return F.array_sort(F.filter(chosen, lambda s: s["kind"] != SKIP))
