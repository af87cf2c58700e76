"""Quality-band decoding (bit flags, class masks) as Column expressions.

Everything here builds JVM-side expressions: no UDFs, codegen-friendly.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.products import (PRODUCTS, QA_PIXEL_BITS, QA_PIXEL_CONFIDENCE_BITS,
                                SCL_LABELS, _flags)

# Scene-classification codes treated as clear by default.
SCL_VALID_DEFAULT = (4, 5, 6, 7, 11)


def _as_int(q) -> Column:
    """Quality value as a long; null and NaN count as 0 (no bit set)."""
    q = F.col(q) if isinstance(q, str) else q
    return F.coalesce(F.nanvl(q.cast("double"), F.lit(0.0)).cast("long"), F.lit(0))


def bit_set(q, bit: int) -> Column:
    """True where ``bit`` of ``q`` is set; null/NaN quality tests False."""
    return _as_int(q).bitwiseAND(F.lit(1 << bit)) != 0


def any_bit_set(q, bits) -> Column:
    """OR of several single-bit tests folded into one mask test."""
    mask = reduce(lambda a, b: a | b, (1 << b for b in bits), 0)
    return _as_int(q).bitwiseAND(F.lit(mask)) != 0


def qa_pixel_mask(q, mask_type: str) -> Column:
    """Landsat QA_PIXEL condition by name, e.g. ``cloud`` or ``cloud_confidence:high``.

    Names are case-insensitive. Two-bit confidences: low = lo and not hi,
    medium = hi and not lo (cloud only), high = both bits.
    """
    mt = mask_type.lower()
    main, _, sub = mt.partition(":")
    if main in QA_PIXEL_BITS and not sub:
        return bit_set(q, QA_PIXEL_BITS[main])
    if main in QA_PIXEL_CONFIDENCE_BITS:
        lo_b, hi_b = QA_PIXEL_CONFIDENCE_BITS[main]
        lo, hi = bit_set(q, lo_b), bit_set(q, hi_b)
        if sub == "low":
            return lo & ~hi
        if sub == "high":
            return lo & hi
        if sub == "medium" and main == "cloud_confidence":
            return ~lo & hi
        raise ValueError(f"Invalid mask sub-type: {mask_type}")
    raise ValueError(f"Invalid mask type: {mask_type}")


def qa_pixel_any(q, mask_types) -> Column:
    """OR of QA_PIXEL conditions; single-bit names fold into one mask."""
    singles = [m.lower() for m in mask_types if m.lower() in QA_PIXEL_BITS]
    others = [m for m in mask_types if m.lower() not in QA_PIXEL_BITS]
    parts = [any_bit_set(q, [QA_PIXEL_BITS[m] for m in singles])] if singles else []
    parts += [qa_pixel_mask(q, m) for m in others]
    if not parts:
        raise ValueError("no mask types given")
    return reduce(lambda a, b: a | b, parts)


def scl_mask(scl, valid_cats=SCL_VALID_DEFAULT) -> Column:
    """True where the scene class is one of ``valid_cats``."""
    scl = F.col(scl) if isinstance(scl, str) else scl
    return scl.isin(list(valid_cats)) & scl.isNotNull()


def scl_codes(labels) -> list[int]:
    """Product flag labels -> SCL codes (driver-side lookup in the definition)."""
    by_label = {v: k for k, v in SCL_LABELS.items()}
    missing = [lab for lab in labels if lab not in by_label]
    if missing:
        raise ValueError(f"unknown SCL labels: {missing}")
    return [by_label[lab] for lab in labels]


def flag_field(q, bits) -> Column:
    """Unsigned value of the contiguous bit field ``bits`` of ``q``."""
    bits = sorted(bits if isinstance(bits, (list, tuple)) else [bits])
    lo, n = bits[0], len(bits)
    if bits != list(range(lo, lo + n)):
        raise ValueError(f"bits must be contiguous: {bits}")
    return F.shiftright(_as_int(q), lo).bitwiseAND(F.lit((1 << n) - 1))


def make_mask(q, product: str, band: str, **flags) -> Column:
    """AND over ``flag=label`` conditions, codes looked up in the product definition.

    Labels may be given as Python booleans for true/false flags.
    """
    if product not in PRODUCTS:
        raise ValueError(f"unknown product {product}")
    defs = _flags(product, band) or {}
    conds = []
    for name, label in flags.items():
        if name not in defs:
            raise ValueError(f"{product}.{band} has no flag {name!r}")
        bits, values = defs[name]
        want = str(label).lower() if isinstance(label, bool) else label
        codes = [c for c, v in values.items() if v == want]
        if not codes:
            raise ValueError(f"flag {name!r} has no value {label!r}")
        conds.append(flag_field(q, bits) == F.lit(codes[0]))
    if not conds:
        raise ValueError("no flags given")
    return reduce(lambda a, b: a & b, conds)
