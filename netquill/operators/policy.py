"""Decision policies over class-probability arrays (active-class order)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from netquill.contract import ABSTAIN_THRESHOLD, ACTIVE_CLASSES, ACTIVE_LABEL_IDS, RECON_THRESHOLD
from netquill.functions.scalars import round_half_even


def class_array() -> Column:
    return F.array(*[F.lit(c) for c in ACTIVE_CLASSES])


def id_array() -> Column:
    return F.array(*[F.lit(i) for i in ACTIVE_LABEL_IDS])


def probability(probs: Column, label: str) -> Column:
    return F.get(probs, F.lit(ACTIVE_CLASSES.index(label)))


def argmax(probs: Column) -> Column:
    """0-based position of the largest probability, first one on ties."""
    return (F.array_position(probs, F.array_max(probs)) - 1).cast("int")


def verdict(probs: Column, abstain: float = ABSTAIN_THRESHOLD, recon: float = RECON_THRESHOLD) -> Column:
    """Argmax, then the RECON override, then abstention below ``abstain``.

    RECON wins when its probability reaches ``recon`` and at least nine tenths of the
    best one. Abstention is judged on the unrounded confidence.
    """
    best = F.array_max(probs)
    p_recon = probability(probs, "RECON")
    override = (p_recon >= F.lit(recon)) & (p_recon >= best * F.lit(0.9))
    at = F.when(override, F.lit(ACTIVE_CLASSES.index("RECON"))).otherwise(argmax(probs))
    confidence = F.when(override, p_recon).otherwise(best)
    abstained = confidence < F.lit(abstain)
    return F.struct(
        F.get(id_array(), at).alias("predicted_class_id"),
        F.get(class_array(), at).alias("predicted_label"),
        round_half_even(confidence).alias("confidence"),
        F.map_from_arrays(class_array(), F.transform(probs, lambda p: round_half_even(p))).alias("probabilities"),
        abstained.alias("abstained"),
        F.when(abstained, F.lit("ANALYST_REVIEW")).otherwise(F.lit("AUTOMATED_DETECTION")).alias("decision"),
    )


def argmax_label(probs: Column) -> Column:
    return F.get(class_array(), argmax(probs))


def swept_label(probs: Column, recon: Column, dns: Column) -> Column:
    """Class-threshold rule of the sweep: DNS_TUNNEL first, then RECON, then argmax."""
    p_dns, p_recon = probability(probs, "DNS_TUNNEL"), probability(probs, "RECON")
    return (
        F.when((p_dns >= dns) & (p_dns >= p_recon), F.lit("DNS_TUNNEL"))
        .when(p_recon >= recon, F.lit("RECON"))
        .otherwise(argmax_label(probs))
    )
