"""Text functions: normal forms, areas, dates, labels, error rates, identifiers.

White space and digits follow Unicode ((?U) patterns), as the source data mixes scripts. Unicode normalisation and case
folding, which Spark lacks, are one Arrow function.
"""

from __future__ import annotations

import functools
import json
import re
import sys
import unicodedata
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrow import arrow

#: Field names in their canonical order.
FIELDS = (
    "survey_number", "khasra_number", "khata_number", "owner_details", "plot_area", "village", "tehsil", "district", "land_classification", "mutation_records", "registration_information",
)
IDENTIFIERS = ("survey_number", "khasra_number", "khata_number")
RECORDS = ("mutation_records", "registration_information")
#: Labels of each field.
LABELS: dict[str, tuple[str, ...]] = {
    "survey_number": ("Survey No", "Survey Number", "சர்வே எண்"),
    "khasra_number": ("Khasra No", "Khasra Number", "கஸ்ரா எண்"),
    "khata_number": ("Khata No", "Khata Number", "கத்தா எண்"),
    "owner_details": ("Owner Name", "Owner", "உரிமையாளர் பெயர்", "உரிமையாளர்"),
    "plot_area": ("Plot Area", "Area", "பரப்பளவு"),
    "village": ("Village", "கிராமம்"),
    "tehsil": ("Tehsil", "Taluk", "தாலுகா", "வட்டம்"),
    "district": ("District", "மாவட்டம்"),
    "land_classification": ("Land Classification", "Land Type", "நில வகைப்பாடு", "நில வகை"),
    "mutation_records": ("Mutation Details", "Mutation No", "Mutation", "பெயர்மாற்றம்"),
    "registration_information": ("Registration Details", "Registration No", "Registration", "பதிவு எண்"),
}
#: What marks a text as a test fixture.
FIXTURE_MARKS = ("ocr test data", "not an official record")
IDENTIFIER_PATTERN = r"(?=.*\d)[A-Za-z0-9]+(?:[/-][A-Za-z0-9]+)*"
#: Fixed value: a number and a unit as documents spell them.
_AREA = r"(\d+(?:[,.]\d+)?)\s*(sq\.?\s*ft\.?|sqft|square\s+feet|square\s+foot|m2|m²|square\s+met(?:re|er)s?|acres?|hectares?|சதுர\s+அடி|அடி\s+சதுர)"
#: Unit spellings by canonical unit; what matches the pattern and isn't listed is hectares.
UNITS = {
    "sq_ft": ("sq ft", "sqft", "square feet", "square foot", "சதுர அடி", "அடி சதுர"),
    "sq_m": ("m2", "m²", "square metre", "square metres", "square meter", "square meters"),
    "acre": ("acre", "acres"),
}
#: Fixed value: a date, year first.
_DATE = r"\b(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})\b"
_MARKS = "\u200b\u200c\u200d\ufeff"
SQFT_PER_M2 = 10.7639104167


def trimmed(c: Column) -> Column:
    """Without Unicode white space at either end (Spark's own trim knows the space only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normalize_whitespace(c: Column) -> Column:
    """Ends trimmed, runs of Unicode white space one space. Null stays null."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def normalize_identifier(c: Column) -> Column:
    """Normal white space, none around / and -."""
    return F.regexp_replace(normalize_whitespace(c), r"(?U)\s*([/-])\s*", "$1")


def once(value: Column, use) -> Column:
    """use(value), where value is evaluated once however often `use` mentions it: the optimiser doesn't copy it into each mention."""
    return F.element_at(F.transform(F.array(value), use), 1)


@functools.cache
def _digits() -> tuple[str, str]:
    """Decimal digits of all scripts, and the ASCII digit of each."""
    known = [(chr(k), unicodedata.decimal(chr(k), None)) for k in range(0x80, sys.maxunicode + 1)]
    return "".join(c for c, d in known if d is not None), "".join(str(d) for _, d in known if d is not None)


def ascii_digits(c: Column) -> Column:
    """Decimal digits of any script as ASCII, so that casts accept them."""
    return F.translate(c, *_digits())


def normalize_area(c: Column) -> Column:
    """struct(value, unit) of the first number with a unit, null without one. Commas are dropped before parsing."""
    units = F.create_map(*(F.lit(x) for name, spellings in UNITS.items() for spelling in spellings for x in (spelling, name)))

    def cut(whole: Column, number: Column) -> Column:
        unit = F.trim(F.replace(F.regexp_replace(F.lower(F.substr(whole, F.length(number) + 1)), r"(?U)\s+", " "), F.lit("."), F.lit("")))
        value = F.replace(ascii_digits(number), F.lit(","), F.lit("")).try_cast("double")
        return F.when(number != "", F.struct(value.alias("value"), F.coalesce(F.try_element_at(units, unit), F.lit("hectare")).alias("unit")))

    # the long pattern finds the text once; its number is cut from that by a short one, the unit is the rest
    return once(F.regexp_extract(c, "(?iU)" + _AREA, 0), lambda whole: once(F.regexp_extract(whole, r"(?U)^\d+(?:[,.]\d+)?", 0), lambda number: cut(whole, number)))


def area_m2(area: Column) -> Column:
    """Square metres of a normalised area in square feet or metres; other units have no agreed factor here."""
    return F.when(area["unit"] == "sq_m", area["value"]).when(area["unit"] == "sq_ft", area["value"] / F.lit(SQFT_PER_M2))


def iso_dates(c: Column) -> Column:
    """Dates like 2024-1-5 in a text, in order: zero-padded if they exist, as they stand if not."""
    def read(raw: Column) -> Column:
        iso = F.translate(ascii_digits(raw), "/.", "--")
        return F.coalesce(F.when(~F.startswith(iso, F.lit("0000")), iso.try_cast("date").cast("string")), raw)

    return F.transform(F.regexp_extract_all(c, F.lit("(?U)" + _DATE), F.lit(0)), read)


def record_information(c: Column) -> Column:
    """array of one struct(value, dates): normal white space and the dates in it, null dates without any."""
    entry = lambda text, dates: F.struct(text.alias("value"), F.when(F.size(dates) > 0, dates).alias("dates"))
    return F.array(once(normalize_whitespace(c), lambda text: once(iso_dates(text), lambda dates: entry(text, dates))))


def normalized_value(field: Column, value: Column) -> Column:
    """Tagged struct (kind, text, value, unit, entries) of a field's value; kind null where it can't be normalised."""
    none = {"text": F.lit(None).cast("string"), "value": F.lit(None).cast("double"), "unit": F.lit(None).cast("string"), "entries": F.lit(None).cast("array<struct<value:string,dates:array<string>>>")}

    def tagged(kind, **parts):
        return F.struct((kind if isinstance(kind, Column) else F.lit(kind)).alias("kind"), *((parts.get(k, v)).alias(k) for k, v in none.items()))

    return (
        F.when(field.isin(*IDENTIFIERS), tagged("text", text=normalize_identifier(value)))
        .when(field == "plot_area", once(normalize_area(value), lambda area: tagged(F.when(area.isNotNull(), "area"), value=area["value"], unit=area["unit"])))
        .when(field.isin(*RECORDS), tagged("record", entries=record_information(value)))
        .otherwise(tagged("text", text=normalize_whitespace(value)))
    )


def semantic_value(normal: Column) -> Column:
    """A canonical JSON text: equal exactly if the normalised values are."""
    return F.to_json(normal)


def normalize_casefold(form: str | None):
    """An Arrow function: Unicode normal form (NFC or NFKC, None for the text as it is), then full case folding."""

    @F.pandas_udf("string")
    def fold(values: pd.Series) -> pd.Series:
        return values.map(lambda v: (unicodedata.normalize(form, v) if form else v).casefold(), na_action="ignore")

    return fold


def comparison_text(c: Column) -> Column:
    """NFC without format marks; colons and dashes are spaces; case folded; normal white space."""
    spaced = F.regexp_replace(F.regexp_replace(c, r"\p{Cf}", ""), "[:\\-–—]", " ")
    return normalize_whitespace(normalize_casefold("NFC")(spaced))


def matching_text(c: Column, identifier: bool = False) -> Column:
    """NFKC, case folded, normal white space; identifiers without space around / and -."""
    folded = normalize_casefold("NFKC")(c)
    return normalize_identifier(folded) if identifier else normalize_whitespace(folded)


def equality_text(c: Column) -> Column:
    """The form in which an expected and a read value are compared: case folded, normal white space, no other change."""
    return normalize_whitespace(normalize_casefold(None)(c))


def label_pattern(label: str) -> str:
    """A Java pattern that finds a label's words at a line's start and captures the value behind its separator.

    Format marks may stand anywhere within and between the words.
    """
    words = (f"[{_MARKS}]*".join(map(re.escape, word)) for word in label.split())
    gap = f"[\\s{_MARKS}]+"
    return f"(?iuU)^\\s*{gap.join(words)}[{_MARKS}]*\\.?[:\\-\\s{_MARKS}]+(.+?)\\s*$"


def labels_by_length() -> list[tuple[int, str, str]]:
    """(order, field, label), longest label first, equal lengths as listed."""
    flat = [(field, label) for field, labels in LABELS.items() for label in labels]
    return [(k, field, label) for k, (field, label) in enumerate(sorted(flat, key=lambda x: -len(x[1])))]


def inline_value(line: Column, label: str | Column) -> Column:
    """The value after an inline label (its text, or a column of its label_pattern), null where the line doesn't start with it."""
    pattern = F.lit(label_pattern(label)) if isinstance(label, str) else label
    value = trimmed(F.call_function("regexp_extract", line, pattern, F.lit(1)))
    return F.when(F.length(value) > 0, value)


def is_fixture(comparison: Column) -> Column:
    hit = F.lit(False)
    for mark in FIXTURE_MARKS:
        hit = hit | comparison.contains(mark)
    return hit


def matches_format(value: Column, pattern: str) -> Column:
    """Whether the whole trimmed value has the pattern; null and blank values have none to check."""
    return trimmed(value).rlike(f"^(?:{pattern})$")


def is_blank(c: Column) -> Column:
    return c.isNull() | (F.length(trimmed(c)) == 0)


#: Terms whose keys are never shown, and what marks a signed address.
SENSITIVE = ("password", "token", "secret", "credential", "authorization", "storage_key", "signed_url")
SIGNED = ("X-Amz-Signature=", "X-Amz-Credential=")


def redact_json(c: Column, terms: tuple[str, ...] = SENSITIVE) -> Column:
    """Compact JSON without keys that hold a sensitive term, at any depth, and without signed addresses; bad JSON is null.

    Objects lose keys as they are read; signed addresses are then string literals of the compact text, which Spark replaces.
    """
    hidden = re.compile("|".join(map(re.escape, terms)), re.IGNORECASE)
    shown = lambda pairs: dict(p for p in pairs if not hidden.search(p[0]))

    @F.pandas_udf("string")
    def reread(values: pd.Series) -> pd.Series:
        out = []
        for text in values:
            try:
                out.append(None if text is None else json.dumps(json.loads(text, object_pairs_hook=shown), ensure_ascii=False, separators=(",", ":")))
            except ValueError:
                out.append(None)
        return pd.Series(out, dtype=object)

    inside = r'(?:[^"\\\\]|\\\\.)*'
    return F.regexp_replace(reread(c), f'"{inside}(?:{"|".join(SIGNED)}){inside}"(?!:)', '"[redacted]"')


def redact_flat(entries: Column, terms: tuple[str, ...] = SENSITIVE) -> Column:
    """The same for a map of strings, without Python."""

    def fine(key):
        hit = F.lit(False)
        for t in terms:
            hit = hit | F.lower(key).contains(t)
        return ~hit

    signed = lambda v: v.contains(SIGNED[0]) | v.contains(SIGNED[1])
    return F.transform_values(F.map_filter(entries, lambda k, _: fine(k)), lambda _, v: F.when(signed(v), "[redacted]").otherwise(v))


def _distance(a: list, b: list) -> int:
    """Edit distance of two sequences, a row of the table at a time."""
    names: dict = {}
    x, y = (np.array([names.setdefault(w, len(names)) for w in s], dtype=np.int64) for s in (a, b))
    row = np.arange(len(y) + 1)
    for k, v in enumerate(x, 1):
        # without insertions first; then insertions are a running minimum of row - position
        new = np.concatenate([[k], np.minimum(row[1:] + 1, row[:-1] + (y != v))])
        row = np.minimum.accumulate(new - np.arange(len(new))) + np.arange(len(new))
    return int(row[-1])


@arrow("int")
def word_distance(reference: pd.Series, hypothesis: pd.Series) -> pd.Series:
    """Edit distance in words."""
    return pd.Series([None if r is None or h is None else _distance(r.split(), h.split()) for r, h in zip(reference, hypothesis)], dtype="Int32")


def character_error_rate(reference: Column, hypothesis: Column) -> Column:
    """Edit distance over reference length; an empty reference has 0 if the hypothesis is empty too, else 1."""
    empty = F.when(F.length(hypothesis) == 0, 0.0).otherwise(1.0)
    return F.when(F.length(reference) == 0, empty).otherwise(F.levenshtein(reference, hypothesis) / F.length(reference))


def word_error_rate(reference: Column, hypothesis: Column) -> Column:
    words = F.size(F.filter(F.split(trimmed(reference), r"(?U)\s+"), lambda w: w != ""))
    empty = F.when(F.length(trimmed(hypothesis)) == 0, 0.0).otherwise(1.0)
    return F.when(words == 0, empty).otherwise(word_distance(reference, hypothesis) / words)


def evidence_ref(kind: Column, source: Column, page: Column) -> Column:
    """type:id, with :page:n where there is a page."""
    base = F.concat(kind, F.lit(":"), source)
    return F.when(page.isNotNull(), F.concat(base, F.lit(":page:"), page.cast("string"))).otherwise(base)


def field_label(c: Column) -> Column:
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


def storage_key(project: Column, file: Column, name: Column) -> Column:
    """Object key with unsafe characters of the name replaced."""
    return F.concat_ws("/", F.lit("projects"), project, F.lit("files"), file, F.regexp_replace(name, r"[^A-Za-z0-9._-]", "_"))


#: Login prefixes by role, in order of rank.
LOGIN_PREFIXES = {"ADMIN": "ADM", "OFFICER": "OFF", "REVIEWER": "REV", "SURVEYOR": "SUR", "VIEWER": "VWR"}


def login_id(role: Column, number: Column) -> Column:
    """PREFIX-TN-000123 of a role and a sequence number; null for a role without a prefix."""
    prefix = F.lit(None).cast("string")
    for name, short in LOGIN_PREFIXES.items():
        prefix = F.when(F.upper(trimmed(role)) == name, short).otherwise(prefix)
    return F.when(prefix.isNotNull(), F.concat(prefix, F.lit("-TN-"), F.format_string("%06d", number)))


def is_login_id(c: Column) -> Column:
    value = F.upper(trimmed(c))
    return (F.length(value) <= 32) & value.rlike("^(ADM|OFF|REV|SUR|VWR)-TN-[0-9]{6,}$")


def identity_digest(c: Column) -> Column:
    """sha256 of the trimmed identity in lower case."""
    return F.sha2(F.lower(trimmed(c)), 256)


@arrow("string")
def issue_target(projects: pd.Series, keys: pd.Series) -> pd.Series:
    """A stable UUID (version 5) of an issue key within a project's UUID."""
    return pd.Series([None if p is None or k is None else str(uuid.uuid5(uuid.UUID(p), k)) for p, k in zip(projects, keys)])


def parse_timestamp(c: Column) -> Column:
    """ISO time stamps, Z for UTC; what can't be parsed is null."""
    return F.try_to_timestamp(F.regexp_replace(c, "Z$", "+00:00"))


def language_list(spec: Column) -> Column:
    """Language codes of a spec like tam+eng; null for an empty, repeated or malformed code."""
    codes = F.transform(F.split(spec, r"\+"), lambda x: trimmed(x))
    fine = F.forall(codes, lambda x: x.rlike("^[a-z][a-z0-9_]{1,31}$")) & (F.size(codes) == F.size(F.array_distinct(codes)))
    return F.when(fine, codes)


def missing_languages(wanted: Column, available: Column) -> Column:
    return F.array_except(wanted, available)
