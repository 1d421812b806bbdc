"""Language labels in any spelling."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

LANGUAGES = ("en", "es", "ca", "fr", "de")
#: Names of the five languages and their codes, in lower case.
NAMES = {
    "en": "en eng english inglés ingles anglès angles anglais englisch",
    "es": "es spa esp spanish español espanol castellano castellà castella espanyol espagnol spanisch castilian",
    "ca": "ca cat catalan català catala catalán valencià valencia valenciano catalanisch",
    "fr": "fr fra fre french français francais francés frances francès französisch",
    "de": "de deu ger german deutsch alemán aleman alemany allemand",
}
#: Labels that name no language, in lower case.
NO_LANGUAGE = "und unk unknown undefined undetermined none null nil na n/a nan mul mis zxx xx ? ?? ??? - -- desconocido desconegut inconnu unbekannt other".split()


def language_code(label: Column) -> Column:
    """One of LANGUAGES, 'other' for a label that names another language, 'none' for one that names none (null and blank too).

    Spelling, letter case, blanks and regions (en-GB, es_MX) don't matter.
    """
    plain = F.lower(F.regexp_replace(label, r"(?U)^\s+|\s+$", ""))
    base = F.regexp_extract(plain, r"^([\p{L}]+)(?:[-_ ].*)?$", 1)
    table = F.create_map(*chain.from_iterable((F.lit(n), F.lit(c)) for c, names in NAMES.items() for n in names.split()))
    return (
        F.when(label.isNull() | (plain == "") | plain.isin(NO_LANGUAGE) | ~plain.rlike(r"\p{L}"), "none")
        .otherwise(F.coalesce(F.try_element_at(table, plain), F.try_element_at(table, base), F.lit("other")))
    )
