"""Label expressions: canonical names, multi-label sets, indices, strict casts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from trialloom.functions.fixed_values import INSTRUCTION_RELATIONS, NO_RELATION, RELATION_ALIASES
from trialloom.functions.text import clean


def _literal_map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def canonical_label(raw: Column, ontology=INSTRUCTION_RELATIONS, aliases=RELATION_ALIASES) -> Column:
    """Ontology name of a raw label, through upper case or an alias; otherwise NULL."""
    value = clean(raw)
    upper = F.replace(F.upper(value), F.lit("-"), F.lit("_"))
    return F.coalesce(F.when(upper.isin(ontology), upper), F.element_at(_literal_map(aliases), F.lower(value)))


def lookup(key: Column, pairs: dict, what: str = "key") -> Column:
    """Literal map lookup; an unknown key is an error."""
    return F.coalesce(
        F.element_at(_literal_map(pairs), key),
        F.raise_error(F.concat(F.lit(f"unknown {what}: "), F.coalesce(key, F.lit("NULL")))),
    )


def label_atoms(raw: Column) -> Column:
    """'A; b' -> sorted upper-case atoms."""
    parts = F.transform(F.split(raw, ";"), lambda x: F.upper(F.trim(x)))
    return F.array_sort(F.filter(parts, lambda x: x != ""))


def atoms_problem(atoms: Column, ontology) -> Column:
    """Why an atom list is not a valid multi-label target; NULL when it is."""
    known = F.array(*[F.lit(x) for x in [*ontology, NO_RELATION]])
    return (
        F.when(F.size(atoms) == 0, "empty")
        .when(F.size(F.array_distinct(atoms)) < F.size(atoms), "repeated")
        .when(F.array_contains(atoms, NO_RELATION) & (F.size(atoms) > 1), "exclusive")
        .when(F.size(F.array_except(atoms, known)) > 0, "unknown")
    )


def class_index(label: Column, ontology, unknown: str = "ignore") -> Column:
    """Position in the ontology, exact spelling first, any case second; unknown is -1 or an error."""
    exact = F.array_position(F.array(*[F.lit(x) for x in ontology]), label)
    folded = F.array_position(F.array(*[F.lit(x.lower()) for x in ontology]), F.lower(label))
    found = F.when(exact > 0, exact - 1).when(folded > 0, folded - 1)
    if unknown == "ignore":
        return F.coalesce(found, F.lit(-1)).cast("int")
    message = F.concat(F.lit("unknown label: "), F.coalesce(label, F.lit("NULL")))
    return F.coalesce(found, F.raise_error(message)).cast("int")


def multi_hot(atoms: Column, ontology) -> Column:
    return F.transform(F.array(*[F.lit(x) for x in ontology]), lambda x: F.array_contains(atoms, x).cast("int"))


def parse_bool(value: Column, wide: bool = False) -> Column:
    """true/false/1/0 (``wide`` also yes/no); anything else is NULL, to be quarantined."""
    low = F.lower(F.trim(value))
    return F.when(low.isin(["true", "1"] + (["yes"] if wide else [])), True).when(
        low.isin(["false", "0"] + (["no"] if wide else [])), False)


def parse_int(value: Column) -> Column:
    return F.when(F.trim(value).rlike(r"^[+-]?[0-9]+$"), F.trim(value)).try_cast("bigint")


def parse_finite(value: Column) -> Column:
    number = value.try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) < float("inf")), number)


def parse_digest(value: Column) -> Column:
    return F.when(value.rlike("^[0-9a-f]{64}$"), value)
