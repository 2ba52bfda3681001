"""Schema-driven masking of every row of any table.

Each column is classified from its lower-cased name and its type at plan
time; the result is a single ``select`` of native expressions.  Each hashed
class adds ``<col>_sha256`` of the raw value after
the original columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clinops.functions.text import (
    mask_address, mask_email, mask_id, mask_name, mask_numeric_id, mask_phone,
    mask_rrn, mask_text, sha256_hex,
)

# ---------------------------------------------------------------------------
# Column-name sets, substrings and constant masks.
# ---------------------------------------------------------------------------
ID_COLUMNS = {"patient_no", "patient_id", "doctor_id", "user_id", "treatment_doc"}
RRN_COLUMNS = {"patient_rrn", "rrn", "resident_no"}
CERTIFICATE_COLUMN = "certificate_number"
NAME_EXCEPTIONS = {"department_name", "institution_name", "drug_name", "job_name"}
PHONE_COLUMNS = {"patient_tel", "phone_number", "tel", "mobile"}
ADDRESS_COLUMNS = {"patient_address", "address"}
TEXT_HINTS = ("diagnosis", "finding", "purpose", "memo", "comment", "note")
PASSPORT_MASK = "********"
BIRTH_MASK = "****-**-**"
# Wearable-side extras applied after the rules above.
WEARABLE_ID_COLUMNS = ("vital_id", "clinical_event_id", "source_mysql_treatment_id")
WEARABLE_TEXT_COLUMNS = ("title", "department")


# A column holds one class of personal data.  Its whole name decides when it is
# a known one; otherwise the fragments in the name do.  Where several match, the
# class is the one whose mask has to win for equal results, in the fixed order of
# ``IDENTIFYING`` (it is an order of precedence, not of how identifying they are).
KNOWN_NAMES = {
    **dict.fromkeys(ID_COLUMNS, "id"),
    **dict.fromkeys(RRN_COLUMNS, "rrn"),
    **dict.fromkeys(PHONE_COLUMNS, "phone"),
    **dict.fromkeys(ADDRESS_COLUMNS, "address"),
    CERTIFICATE_COLUMN: "text",
}
FRAGMENTS = {c: c for c in ("name", "email", "phone", "passport", "birth")} | dict.fromkeys(TEXT_HINTS, "text")
IDENTIFYING = ("name", "email", "phone", "passport", "birth", "text")  # first wins
STRICT_NAMES = {"app_user_id": "id", "guardian": "name"}  # quirk Q8
UNHASHED = {"birth"}  # too few values for a hash to hide them

MASKS = {
    "id": mask_id,
    "rrn": mask_rrn,
    "text": mask_text,
    "name": mask_name,
    "email": mask_email,
    "phone": mask_phone,
    "passport": lambda c: F.when(c.isNotNull(), F.lit(PASSPORT_MASK)),
    "address": mask_address,
    "birth": lambda c: F.when(c.isNotNull(), F.lit(BIRTH_MASK)),
}


def data_class(name: str, dtype: T.DataType, strict: bool = False) -> str | None:
    """Class of personal data a column holds, or None.  Only ids (and, in
    strict mode, birth dates) are looked for in columns that are not text."""
    name = name.lower()
    found = {KNOWN_NAMES[name]} if name in KNOWN_NAMES else {c for f, c in FRAGMENTS.items() if f in name}
    if name in NAME_EXCEPTIONS:
        found.discard("name")
    if strict and not found and name in STRICT_NAMES:
        found = {STRICT_NAMES[name]}
    if not isinstance(dtype, T.StringType):
        found &= {"id", "birth"} if strict else {"id"}
    return min(found, key=lambda c: IDENTIFYING.index(c) if c in IDENTIFYING else -1, default=None)


def sanitize(df: DataFrame, profile: str = "ops", hashes: bool = True,
             strict: bool = False, key_sidecars: tuple[str, ...] = (),
             hash_salt: str | None = None) -> DataFrame:
    """Mask personal data in every row.

    ``profile="wearable"`` adds the app-side id/text masks; ``strict`` also
    masks typed birth dates, ``guardian`` and ``app_user_id`` (quirk Q8).
    ``key_sidecars`` keeps the raw value of the named columns as
    ``<col>_key`` for drill-down links (off by default: it re-exposes the id).
    ``hash_salt`` prefixes the value before hashing; the default (no salt)
    keeps parity, but unsalted hashes of small id spaces can be reversed.
    """
    out, side = [], []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        held = data_class(f.name, f.dataType, strict)
        expr = c if held is None else MASKS[held](c)
        if profile == "wearable":
            if f.name in WEARABLE_ID_COLUMNS:
                expr = mask_numeric_id(expr)
            elif f.name in WEARABLE_TEXT_COLUMNS and isinstance(f.dataType, T.StringType):
                expr = F.when(expr != "", mask_text(expr)).otherwise(expr)
        out.append(expr.alias(f.name))
        if hashes and held is not None and held not in UNHASHED:
            hv = c if hash_salt is None else F.concat(F.lit(hash_salt), c.cast("string"))
            side.append(sha256_hex(hv).alias(f"{f.name}_sha256"))
    keys = [F.col(f"`{k}`").alias(f"{k}_key") for k in key_sidecars if k in df.columns]
    return df.select(*out, *side, *keys)
