"""Name cleaning for platforms and waste types, as regular expressions on columns."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from salmoura.names import col

# ---- fixed values: full platform name -> code, production log ----
PRODUCTION_CODES = {
    "FPSO CIDADE DE SANTOS": "FPCST",
    "FPSO CIDADE DE ANGRA DOS REIS": "FPCAR",
    "FPSO CIDADE DE ITAGUAI": "FPCIG",
    "FPSO CIDADE DE SAO PAULO": "FPCSP",
    "FPSO CIDADE DE SAQUAREMA": "FPCSQ",
    "FPSO CIDADE DE MARICA": "FPCMC",
    "FPSO CIDADE DE MANGARATIBA": "FPCMB",
    "FPSO BRASIL": "FPSO-BR",
    "FPSO-BRASIL": "FPSO-BR",
    "FPSO FLUMINENSE": "FPRJ",
    "FPSO MARLIM SUL": "FPSO-MLS",
    "FPSO CAPIXABA": "CAPX",
    "FPSO CIDADE DO RIO DE JANEIRO": "FPSO-RJ",
    "FPSO RIO DAS OSTRAS": "FPSO-RO",
    "ESPADARTE FPSO": "FPSO-ESP",
}

# ---- fixed values: part of the name -> code, waste log, in order of precedence ----
WASTE_LOG_CODES = [
    ("BRASIL", "FPBR"),
    ("MARICA", "FPMQT"),
    ("SAQUAREMA", "FPCSQ"),
    ("SANTOS", "FPCST"),
    ("ILHABELA", "FPCIB"),
    ("SAO PAULO", "FPCSP"),
    ("NITER", "FPCNI"),
    ("ITAJA", "FPCIT"),
    ("MANGARATIBA", "FPCMG"),
    ("PARATY", "FPCPY"),
]

# ---- fixed values: waste-type labels that mean the same ----
CONTAMINATED_LABELS = [
    "BORRA OLEOSA COM NORM (CATEGORIA I - ETIQUETA BRANCA)",
    "BORRA OLEOSA COM NORM (CATEGORIA II - ETIQUETA AMARELA)",
]
CONTAMINATED = "BORRA OLEOSA COM NORM"

# ---- fixed values: what a platform looks like inside a location path ----
PLATFORM_IN_PATH = r"(?U)(FPSO[^/]+|P-\d+|P\d+|SS-\d+|CDAN|CAPX|FP\w+)"
UNKNOWN_PLATFORM = "OUTROS"

# ---- fixed values: letters and signs that do not decompose into a plain letter and marks ----
SPELLED = {
    "ß": "ss", "ẞ": "SS", "Æ": "AE", "æ": "ae", "Œ": "OE", "œ": "oe", "Þ": "Th", "þ": "th",
    "…": "...", "—": "--", "„": ",,", "«": "<<", "»": ">>",
}
SINGLE = {
    **dict(zip("ØøĐđÐðŁłĦħŦŧıªº", "OoDdDdLlHhTtiao")),
    **dict.fromkeys("‐‑–", "-"), **dict.fromkeys("‘’", "'"), **dict.fromkeys("“”", '"'),
    "‚": ",", "×": "x", "\u00a0": " ",
}


def _plain_letters() -> dict[str, str]:
    """Letters of the Latin blocks with marks and their plain forms, by decomposition."""
    found = dict(SINGLE)
    for block in (range(0xC0, 0x250), range(0x1E00, 0x1F00)):
        for letter in map(chr, block):
            base = unicodedata.normalize("NFD", letter)[0]
            if base.isascii() and base.isalpha():
                found[letter] = base
    return found


def fold_accents(c: Column) -> Column:
    """Plain letters and signs for Latin letters with marks, ligatures, dashes and quotation marks."""
    table = _plain_letters()
    for sign, spelled in SPELLED.items():
        c = F.replace(c, F.lit(sign), F.lit(spelled))
    return F.translate(c, "".join(table), "".join(table.values()))


def exact_code(c: Column) -> Column:
    """Code of a full platform name; other values stay."""
    pairs = [F.lit(x) for pair in PRODUCTION_CODES.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), c), c)


def numbered_platform(c: Column) -> Column:
    """``Petrobras 58 (P-58)`` and ``petrobras 58`` both become ``P-58``."""
    named = F.regexp_replace(c, r"(?iU)petrobras\s+\d+\s*\(?(P-\d+)\)?", "$1")
    return F.regexp_replace(named, r"(?iU)petrobras\s+(\d+)\s*\(?\)?", "P-$1")


def production_platform(c: Column) -> Column:
    """Platform code of a production-log destination."""
    return F.upper(fold_accents(numbered_platform(exact_code(c))))


def platform_from_path(path: Column) -> Column:
    """Platform named in the last part of a ``/`` path, upper-cased and trimmed."""
    found = F.regexp_extract(F.substring_index(path, "/", -1), PLATFORM_IN_PATH, 1)
    named = F.coalesce(F.regexp_replace(found, "^$", UNKNOWN_PLATFORM), F.lit(UNKNOWN_PLATFORM))
    return F.regexp_replace(F.upper(named), r"(?U)^\s+|\s+$", "")


def tidy_platform(c: Column) -> Column:
    """Drop ``(...)``, set FPSO apart from the name and squeeze blanks. Ends are not trimmed again."""
    c = F.regexp_replace(c, r"\(.*?\)", "")
    c = F.regexp_replace(c, r"^FPSO([A-Z])", "FPSO $1")
    return F.regexp_replace(c, r"(?U)\s+", " ")


def coded_platform(c: Column) -> Column:
    """First matching code of the waste log, else the name with ``P58`` written ``P-58``."""
    first, *rest = [(c.contains(part), code) for part, code in WASTE_LOG_CODES]
    coded = reduce(lambda w, pair: w.when(*pair), rest, F.when(*first))
    return coded.otherwise(F.regexp_replace(c, r"(?U)^P(\d+)$", "P-$1"))


def waste_platform(path: Column) -> Column:
    """Platform code of a waste-log location path. The name is the argument of a lambda, so that it is worked out once
    a row; written into each condition of the codes, it would be worked out for each of them again."""
    return F.transform(F.array(tidy_platform(platform_from_path(path))), coded_platform)[0]


def with_waste_platform(df: DataFrame, path: str, name: str) -> DataFrame:
    """Add :func:`waste_platform` of the column ``path`` as ``name``, in two selects of generated code."""
    named = df.withColumn(name, tidy_platform(platform_from_path(col(path))))
    return named.withColumn(name, coded_platform(col(name)))


def waste_type(c: Column) -> Column:
    return F.when(c.isin(CONTAMINATED_LABELS), CONTAMINATED).otherwise(c)
