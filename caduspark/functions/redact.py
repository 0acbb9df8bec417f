"""Redaction of hits in a text: replace, pseudonymise, generalise or suppress, by default and by type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from caduspark.functions import fixed
from caduspark.functions.detect import let

MODES = ("REDACT", "PSEUDONYMIZE", "GENERALIZE", "SUPPRESS")


def pseudonym(value: Column, phi_type: Column, salt: str) -> Column:
    digest = F.substring(F.sha2(F.concat_ws("|", F.lit(salt), phi_type, value).cast("binary"), 256), 1, 8)
    prefix = F.lower(phi_type)
    for kind, word in fixed.PSEUDONYM_PREFIX.items():
        prefix = F.when(phi_type == kind, F.lit(word)).otherwise(prefix)
    return F.concat(prefix, F.lit("_"), digest)


def generalized(value: Column, phi_type: Column) -> Column:
    years = F.filter(F.transform(F.split(F.replace(value, F.lit("/"), F.lit("-")), "-"), lambda t: F.trim(t)), lambda t: t.rlike("^[0-9]{4}$"))
    digits = F.regexp_replace(value, "[^0-9]", "")
    return (
        F.when(phi_type == "DATE", F.coalesce(F.get(years, 0), F.lit("[DATE_YEAR_UNKNOWN]")))
        .when(phi_type == "ZIP", F.when(F.length(digits) >= 3, F.concat(F.substring(digits, 1, 3), F.lit("**"))).otherwise(F.lit("[ZIP]")))
        .otherwise(F.concat(F.lit("["), phi_type, F.lit("]")))
    )


def check(mode: str, overrides: dict[str, str] | None = None) -> None:
    for m in (mode, *(overrides or {}).values()):
        if m not in MODES:
            raise ValueError(f"unknown redaction mode: {m}")


def replacement(h: Column, mode: str, overrides: dict[str, str] | None = None, salt: str = "session") -> Column:
    check(mode, overrides)
    how = {
        "REDACT": F.concat(F.lit("[REDACTED:"), h["phi_type"], F.lit("]")),
        "PSEUDONYMIZE": pseudonym(h["value"], h["phi_type"], salt),
        "GENERALIZE": generalized(h["value"], h["phi_type"]),
        "SUPPRESS": F.lit(""),
    }
    out = how[mode]
    for kind, m in (overrides or {}).items():
        out = F.when(h["phi_type"] == kind, how[m]).otherwise(out)
    return out


def redact(text: Column, hits: Column, mode: str = "REDACT", overrides: dict[str, str] | None = None, salt: str = "session") -> Column:
    """The text with its (disjoint, ordered) hits replaced: a piece a hit, each with the gap before it, joined once."""

    def done(hits: Column) -> Column:
        def piece(h: Column, i: Column) -> Column:
            at = F.coalesce(F.get(hits, i - 1)["end"], F.lit(0))
            return F.concat(F.substring(text, at + 1, h["start"] - at), replacement(h, mode, overrides, salt))

        rest = F.substring(text, F.get(hits, F.size(hits) - 1)["end"] + 1, F.length(text))
        return F.when(F.size(hits) > 0, F.concat(F.array_join(F.transform(hits, piece), ""), rest)).otherwise(text)

    return let(hits, done)
