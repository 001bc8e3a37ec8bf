"""The clauses of each category: what a watch requires of a product, judged on the catalog and on the title.

One table says them all: the requirement's field, how it is compared, the catalog's field, and the title's where a
title is evidence. The catalog decides; a title can only contradict. What reading counted is the clause's tier.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.states import kit_total, token_of
from .eligibility import MATCH, NO_MATCH, UNKNOWN, at_least, at_most, equal_to, one_of, recording_contradicted, vendor_lock_outcome

# Clauses by category in their order: name, requirement, comparison, catalog field, title field.
CLAUSES = {
    "drive": (
        ("drive.min_capacity_tb", "min_capacity_tb", "least", "capacity_tb", "capacity_tb"),
        ("drive.media_types", "media_types", "among", "media_type", None),
        ("drive.interfaces", "interfaces", "among", "interface", "interface"),
        ("drive.form_factors", "form_factors", "among", "form_factor", "form_factor"),
        ("drive.recording_techs", "recording_techs", "recording", "recording_tech", "recording"),
    ),
    "gpu": (
        ("gpu.min_vram_gb", "min_vram_gb", "least", "vram_gb", "vram_gb"),
        ("gpu.chip_vendors", "chip_vendors", "among", "chip_vendor", "chip_vendor"),
        ("gpu.interfaces", "interfaces", "among", "interface", "interface"),
        ("gpu.coolings", "coolings", "among", "cooling", "cooling"),
        ("gpu.max_tdp_w", "max_tdp_w", "most", "tdp_w", None),
    ),
    "ram": (
        ("ram.generations", "generations", "among", "generation", "generation"),
        ("ram.module_types", "module_types", "among", "module_type", "module_type"),
        ("ram.require_ecc", "require_ecc", "equal", "ecc", "ecc"),
        ("ram.min_total_capacity_gb", "min_total_capacity_gb", "least", "total_capacity_gb", "total_capacity_gb"),
        ("ram.min_speed_mts", "min_speed_mts", "least", "speed_mts", "speed_mts"),
    ),
    "cpu": (
        ("cpu.sockets", "sockets", "among", "socket", "socket"),
        ("cpu.min_cores", "min_cores", "least", "cores", "cores"),
        ("cpu.max_tdp_w", "max_tdp_w", "most", "tdp_w", None),
    ),
}
DRIVE_INTERFACES = ("nvme", "sas", "sata", "scsi", "usb")
DRIVE_FORM_FACTORS = ("3.5", "2.5", "m.2")
__all__ = ["CLAUSES", "DRIVE_FORM_FACTORS", "DRIVE_INTERFACES", "kit_total", "known", "product_clause", "product_clauses", "token_of"]
_HOW = {"least": at_least, "most": at_most, "among": one_of, "recording": one_of, "equal": equal_to}


def known(value: Column) -> Column:
    """A catalog's choice as evidence: blank and "unknown" say nothing."""
    return F.when(~value.isin("", "unknown"), value)


def product_clause(name: str, bound: Column, how: str, value: Column, said: Column | None, on_conflict: str = NO_MATCH) -> Column:
    """struct<clause, outcome, tier>. ``said`` is what a title says surely enough, else null."""
    test = _HOW[how]
    free = bound.isNull() | (F.size(bound) == 0) if how in ("among", "recording") else bound.isNull()
    ok = F.when(value.isNotNull(), test(bound, value))
    if said is None:
        against = F.lit(False)
    elif how == "recording":
        against = recording_contradicted(bound, said)
    else:
        against = F.coalesce(~test(bound, said), F.lit(False))
    fails, fits = ok == F.lit(False), ok.isNotNull()
    outcome = F.when(free, MATCH).when(fails, NO_MATCH).when(against & fits, on_conflict).when(against, NO_MATCH).when(fits, MATCH).otherwise(UNKNOWN)
    tier = F.when(free, "none").when(fails, "catalog").when(against, "listing").when(fits, "catalog").otherwise("none")
    return F.struct(F.lit(name).alias("clause"), outcome.alias("outcome"), tier.alias("tier"))


def product_clauses(category: str, requirement: Column, spec: Column, said: dict[str, Column], vendor_lock: tuple[Column, Column] | None = None) -> Column:
    """array<struct<clause, outcome, tier>> of a category; none for one without requirements of its own.

    ``requirement`` and ``spec`` are structs (a null spec knows nothing); ``said``: what the title surely says, by field.
    ``vendor_lock``: (stated, confidence), of processors. A watch without its requirement has one unknown clause.
    """
    if category not in CLAUSES:
        return F.array().cast("array<struct<clause:string,outcome:string,tier:string>>")
    out = [product_clause(name, requirement[need], how, spec[field], None if title is None else said.get(title)) for name, need, how, field, title in CLAUSES[category]]
    if category == "cpu":
        stated, sure = vendor_lock or (F.lit(None).cast("string"), F.lit(None).cast("double"))
        outcome = vendor_lock_outcome(requirement["require_vendor_unlocked"], stated, sure)
        wants = F.coalesce(requirement["require_vendor_unlocked"], F.lit(False))
        tier = F.when(wants & (outcome != UNKNOWN), "listing").otherwise("none")
        out.append(F.struct(F.lit("cpu.vendor_lock").alias("clause"), outcome.alias("outcome"), tier.alias("tier")))
    missing = F.array(F.struct(F.lit(f"{category}.requirement").alias("clause"), F.lit(UNKNOWN).alias("outcome"), F.lit("none").alias("tier")))
    return F.when(requirement.isNull(), missing).otherwise(F.array(*out))
