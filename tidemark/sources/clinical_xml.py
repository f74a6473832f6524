"""Clinical XML documents flattened with Spark's own XML reader.

Every document is read once by ``from_xml``. Of a plain one (``clinical_scan``) the parts are cut out of its
text, and the reader only tells whether it is well-formed; any other is parsed against an explicit schema
and its four coded sections become arrays of structs through array functions. All of it happens inside the
scan stage. Element and attribute prefixes are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions.clinical import LOINC_OID, hl7_date, hl7_timestamp, system_for_oid
from tidemark.functions.numbers import floor_div
from tidemark.sources.clinical_scan import LISTS, MEDICATIONS, NAMESPACE, PROBLEMS, RESULTS, VITALS, struct_of

_PROLOG = r"^\x{FEFF}?(?:\s++|<\?[\s\S]*?\?>|<!--[\s\S]*?-->|<!DOCTYPE[^>\[]*(?:\[[\s\S]*?\])?[^>]*>)*+"
_ROOT = _PROLOG + r"<([^\s/>]+)([^>]*)>"


def is_plain(scanned: Column) -> Column:
    return F.coalesce(scanned["plain"], F.lit(False))


def parse_document(text: Column, scanned: Column) -> Column:
    """The document as a nested row; a plain one is checked only, as a child of a root outside the schema."""
    checked = F.concat(F.lit("<x>"), F.substr(text, scanned["start"] + 1), F.lit("</x>"))
    return F.from_xml(
        F.when(is_plain(scanned), checked).otherwise(text), schemas.CLINICAL_DOCUMENT,
        {
            "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "malformed",
            "valueTag": "txt", "ignoreNamespace": "true",
        },
    )


def root_tag(text: Column) -> Column:
    """The text up to the end of its first tag, empty without one; a column of its own, as it is needed thrice."""
    return F.regexp_extract(text, _ROOT, 0)


def document_problem(root: Column, doc: Column, plain: Column) -> Column:
    """Why the text with this root tag is no clinical document; null when it is one, which a plain and well-formed one is."""
    name = F.regexp_extract(root, _ROOT, 1)
    attributes = F.regexp_extract(root, _ROOT, 2)
    prefix = F.when(name.contains(":"), F.concat(F.lit(":"), F.substring_index(name, ":", 1))).otherwise("")
    declared = F.rlike(
        attributes, F.concat(F.lit(r"(?:^|\s)xmlns"), prefix, F.lit(rf"""\s*=\s*["']{NAMESPACE}["']""")))
    return (
        F.when(doc.isNull() | doc["malformed"].isNotNull(), "not well-formed XML")
        .when(plain, None)
        .when(F.substring_index(name, ":", -1) != "ClinicalDocument", "root element is not ClinicalDocument")
        .when(~declared, "root element is in another namespace")
        .when(F.coalesce(F.size(doc["templateId"]), F.lit(0)) <= 0, "root element has no templateId")
    )


def document_date(doc: Column, scanned: Column) -> Column:
    """The day of the document's time in UTC, whatever the session's zone."""
    of_plain = F.when(doc["malformed"].isNull(), scanned["time"])
    at = hl7_timestamp(F.when(is_plain(scanned), of_plain).otherwise(_first(doc["effectiveTime"])["_value"]))
    return F.date_from_unix_date(floor_div(F.unix_seconds(at), 86_400).cast("int"))


def _first(items: Column) -> Column:
    return F.get(items, F.lit(0))


def _children(items: Column, name: str) -> Column:
    """All ``name`` children of every element; an empty list when there are none."""
    return F.flatten(F.filter(items[name], lambda c: c.isNotNull()))


def sections(doc: Column) -> Column:
    """The first section of each component of the first structured body."""
    body = _first(_children(doc["component"], "structuredBody"))
    return F.transform(F.filter(body["component"]["section"], lambda s: F.size(s) > 0), _first)


def _entries(of: Column, loinc: str) -> Column:
    def matches(section: Column) -> Column:
        return F.exists(
            section["code"], lambda c: (c["_code"] == loinc) & (c["_codeSystem"] == LOINC_OID))

    return _children(F.filter(of, matches), "entry")


def _panel_observations(entries: Column) -> Column:
    return _children(_children(_children(entries, "organizer"), "component"), "observation")


def _coding(row: Column) -> list[Column]:
    return [
        row["system"].alias("coding_system"),
        row["parts"]["code"].alias("coding_code"),
        row["parts"]["display"].alias("coding_display"),
    ]


def _read(items: Column, parts: Callable[[Column], dict[str, Column]]) -> Column:
    return F.transform(items, lambda e: F.struct(*(part.alias(name) for name, part in parts(e).items())))


def _coded(
    scanned: Column, name: str, items: Column, elements: Callable[[Column], dict[str, Column]],
    parts: Callable[[Column], dict[str, Column]], parsed: Callable[[Column], dict[str, Column]],
) -> Column:
    """Elements with a usable code; anything else is valid but carries no data.

    ``elements`` are found in an item, ``parts`` taken out of these, unless the scan has the parts already, and
    ``parsed`` is worked out of the parts. An expression is evaluated at each place where a lambda has it, so
    what is needed more than once is a field of the step before. Rows of the tables are formed of the result,
    by those tables that are asked for.
    """
    kind = f"array<{struct_of(LISTS[name])}>"
    taken = F.when(is_plain(scanned), scanned[name]).otherwise(_read(_read(items, elements), parts).cast(kind))
    rows = _read(taken, lambda r: {"parts": r, "system": system_for_oid(r["oid"]), **parsed(r)})
    return F.filter(rows, lambda r: r["system"].isNotNull() & r["parts"]["code"].isNotNull())


def _code_parts(code: Column) -> dict[str, Column]:
    return {"code": code["_code"], "oid": code["_codeSystem"], "display": code["_displayName"]}


def _number_text(value: Column) -> Column:
    whole = (value == F.floor(value)) & (F.abs(value) < 1e15)
    return F.when(whole, value.try_cast("bigint").cast("string")).otherwise(value.cast("string"))


def _observation_elements(o: Column) -> dict[str, Column]:
    return {"code": _first(o["code"]), "time": _first(o["effectiveTime"]), "value": _first(o["value"])}


def _observation_parts(r: Column) -> dict[str, Column]:
    v = r["value"]
    return {
        **_code_parts(r["code"]), "time": r["time"]["_value"],
        "kind": v["_type"], "number": v["_value"], "unit": v["_unit"], "txt": v["txt"],
    }


def _observation_parsed(r: Column) -> dict[str, Column]:
    return {"start": hl7_timestamp(r["time"]), "own": r["number"].try_cast("double")}


def _observation_rows(rows: Column, first: Column | int, value_of: Callable[[Column], dict[str, Column]]) -> Column:
    def row(r: Column, seq: Column) -> Column:
        value = value_of(r)
        return F.struct(
            *_coding(r),
            r["start"].alias("effective_start"),
            F.lit(None).cast("timestamp").alias("effective_end"),
            value["quantity"].cast("double").alias("value_quantity"),
            value["string"].cast("string").alias("value_string"),
            value["unit"].cast("string").alias("value_unit"),
            seq,
        )

    return _numbered(rows, row, first)


def _numbered(rows: Column, row: Callable[[Column, Column], Column], first: Column | int = 0) -> Column:
    """Table rows with their position in the document as ``seq``."""
    offset = first if isinstance(first, Column) else F.lit(first)
    return F.transform(rows, lambda r, i: row(r, (i + offset).cast("bigint").alias("seq")))


def _without_time(r: Column, otherwise: Column) -> Column:
    return F.when(r["start"].isNull(), "missing or malformed effectiveTime").otherwise(otherwise)


def _vital_value(r: Column) -> dict[str, Column]:
    v = r["parts"]
    is_quantity = v["kind"] == "PQ"
    is_text = v["kind"].isNull() | (v["kind"] == "ST")
    return {
        "quantity": F.when(is_quantity, r["own"]),
        "string": F.when(is_text, v["txt"]),
        "unit": F.when(is_quantity, v["unit"]),
    }


def _vital_error(r: Column) -> Column:
    kind = r["parts"]["kind"]
    is_quantity = kind == "PQ"
    is_text = kind.isNull() | (kind == "ST")
    return _without_time(r, F.when(is_quantity & r["own"].isNull(), "quantity is not numeric").when(
        ~(is_quantity | is_text), "unsupported value type"))


def _result_elements(o: Column) -> dict[str, Column]:
    value = _first(o["value"])
    spelled = F.filter(
        F.concat(
            F.coalesce(value["originalText"], F.array().cast("array<struct<txt: string>>")),
            _children(value["translation"], "originalText"),
        ),
        lambda t: F.lit(True),
    )
    return {
        **_observation_elements(o),
        "translation": _first(value["translation"]), "spelled": _first(spelled),
        "low": _first(value["low"]), "high": _first(value["high"]),
    }


def _result_parts(r: Column) -> dict[str, Column]:
    return {
        **_observation_parts(r), "value_code": r["value"]["_code"], "value_display": r["value"]["_displayName"],
        "translated": r["translation"]["_value"], "translated_unit": r["translation"]["_unit"],
        "spelled": r["spelled"]["txt"],
        "low": r["low"]["_value"], "low_unit": r["low"]["_unit"],
        "high": r["high"]["_value"], "high_unit": r["high"]["_unit"],
    }


def _result_parsed(r: Column) -> dict[str, Column]:
    return {
        **_observation_parsed(r), "low": r["low"].try_cast("double"), "high": r["high"].try_cast("double"),
    }


def _result_error(r: Column) -> Column:
    v = r["parts"]
    return _without_time(r, F.when(
        (v["kind"] == "PQ") & v["number"].isNotNull() & r["own"].isNull(), "quantity is not numeric"))


def _result_value(r: Column) -> dict[str, Column]:
    """Quantity with translation fallback, interval, coded value or text; other types have no value."""
    v = r["parts"]
    kind = v["kind"]
    spelled_unit = F.trim(v["spelled"])
    quantity_unit = F.coalesce(v["unit"], v["translated_unit"], F.when(spelled_unit != "", spelled_unit))

    low_value, high_value = r["low"], r["high"]
    same = F.abs(low_value - high_value) < 2.220446049250313e-16
    is_range = low_value.isNotNull() & high_value.isNotNull() & ~same
    range_text = F.concat(
        _number_text(low_value), F.lit("-"), _number_text(high_value),
        F.coalesce(F.concat(F.lit(" "), v["low_unit"]), F.lit("")),
    )
    one_bound = F.when(~F.coalesce(is_range, F.lit(False)), F.coalesce(low_value, high_value))
    bound_unit = F.when(low_value.isNotNull(), v["low_unit"]).otherwise(
        F.when(high_value.isNotNull(), v["high_unit"]))
    return {
        "quantity": F.when(
            kind == "PQ",
            F.when(v["number"].isNotNull(), r["own"]).otherwise(v["translated"].try_cast("double")),
        ).when(kind == "IVL_PQ", one_bound),
        "string": F.when(kind == "IVL_PQ", F.when(is_range, range_text))
        .when(kind == "CD", F.coalesce(v["value_display"], v["value_code"]))
        .when(kind.isNull() | (kind == "ST"), v["txt"]),
        "unit": F.when(kind == "PQ", quantity_unit).when(
            kind == "IVL_PQ", F.when(~F.coalesce(is_range, F.lit(False)), bound_unit)),
    }


def vitals(of: Column, scanned: Column) -> Column:
    return _coded(
        scanned, "vitals", _panel_observations(_entries(of, VITALS)),
        _observation_elements, _observation_parts, _observation_parsed)


def results(of: Column, scanned: Column) -> Column:
    """Panel members and results hung directly off an entry; nested notes are not results."""
    entries = _entries(of, RESULTS)
    found = F.concat(_panel_observations(entries), _children(entries, "observation"))
    return _coded(scanned, "results", found, _result_elements, _result_parts, _result_parsed)


def observation_rows(vital: Column, result: Column) -> Column:
    """Rows of the vitals, then of the results."""
    return F.concat(
        _observation_rows(vital, 0, _vital_value), _observation_rows(result, F.size(vital), _result_value))


def problems(of: Column, scanned: Column) -> Column:
    found = _children(_children(_children(_entries(of, PROBLEMS), "act"), "entryRelationship"), "observation")
    return _coded(
        scanned, "problems", found,
        lambda o: {
            "code": _first(F.filter(o["value"], lambda v: v["_type"] == "CD")),
            "status": _first(o["statusCode"]),
            "onset": _first(_first(o["effectiveTime"])["low"]),
        },
        lambda r: {**_code_parts(r["code"]), "status": r["status"]["_code"], "onset": r["onset"]["_value"]},
        lambda r: {},
    )


def problem_rows(rows: Column) -> Column:
    return _numbered(rows, lambda r, seq: F.struct(
        *_coding(r),
        r["parts"]["status"].alias("status"),
        hl7_date(r["parts"]["onset"]).alias("onset_date"),
        F.lit(None).cast("string").alias("section_label"),
        seq,
    ))


def medications(of: Column, scanned: Column) -> Column:
    def elements(a: Column) -> dict[str, Column]:
        product = _first(_first(a["consumable"])["manufacturedProduct"])
        return {
            "code": _first(_first(product["manufacturedMaterial"])["code"]),
            "status": _first(a["statusCode"]),
            "dose": _first(a["doseQuantity"]),
            "route": _first(a["routeCode"]),
            "period": _first(F.filter(a["effectiveTime"], lambda t: t["_type"] == "IVL_TS")),
        }

    def parts(r: Column) -> dict[str, Column]:
        return {
            **_code_parts(r["code"]), "status": r["status"]["_code"],
            "dose": r["dose"]["_value"], "dose_unit": r["dose"]["_unit"], "route": r["route"]["_displayName"],
            "start": _first(r["period"]["low"])["_value"], "end": _first(r["period"]["high"])["_value"],
        }

    found = _children(_entries(of, MEDICATIONS), "substanceAdministration")
    return _coded(scanned, "medications", found, elements, parts, lambda r: {})


def medication_rows(rows: Column) -> Column:
    def row(r: Column, seq: Column) -> Column:
        part = r["parts"]
        return F.struct(
            *_coding(r),
            part["status"].alias("status"),
            F.concat(part["dose"], F.lit(" "), part["dose_unit"]).alias("dose"),
            part["route"].alias("route"),
            F.lit(None).cast("string").alias("frequency"),
            hl7_date(part["start"]).alias("start_date"),
            hl7_date(part["end"]).alias("end_date"),
            seq,
        )

    return _numbered(rows, row)


def _without_status(kind: str) -> Callable[[Column], Column]:
    return lambda r: F.when(r["parts"]["status"].isNull(), f"{kind} without status")


def first_error(vital: Column, result: Column, problem: Column, medication: Column) -> Column:
    """First row error of a document; one bad row rejects the whole document."""
    checks = (
        (vital, _vital_error), (result, _result_error),
        (problem, _without_status("problem")), (medication, _without_status("medication")),
    )
    errors = F.flatten(F.array(*(
        F.coalesce(F.transform(rows, error), F.array().cast("array<string>")) for rows, error in checks)))
    return _first(F.filter(errors, lambda e: e.isNotNull()))
