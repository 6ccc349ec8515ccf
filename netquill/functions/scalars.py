"""Row-level functions over raw log fields and domain names.

Every function takes and returns a ``Column``; none needs a Python worker.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Placeholders a log writes for "no value".
UNSET, EMPTY = "-", "(empty)"
_BLANKS = " \t\n\r\x0b\x0c"
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
_LONG_LIMIT = 9.2e18


def strip(c: Column) -> Column:
    """Trim all ASCII whitespace, not just spaces."""
    return F.btrim(c, F.lit(_BLANKS))


def round_half_even(c: Column, digits: int = 4) -> Column:
    """Round to ``digits`` places with ties to even (``rint`` is codegen-friendly)."""
    scale = float(10 ** digits)
    return F.rint(c * F.lit(scale)) / F.lit(scale)


def safe_float(c: Column, default: float = 0.0) -> Column:
    """Parse a decimal number; placeholders and anything unparsable become ``default``.

    The pattern guard is needed because a Spark cast accepts suffixes such as ``1d``.
    """
    text = strip(c)
    number = F.when(text.rlike(_NUMBER), text.try_cast("double"))
    return F.coalesce(number, F.lit(float(default)))


def safe_int(c: Column, default: int = 0) -> Column:
    """Parse like :func:`safe_float`, then truncate towards zero."""
    text = strip(c)
    number = F.when(text.rlike(_NUMBER), text.try_cast("double"))
    fits = F.abs(number) < F.lit(_LONG_LIMIT)
    return F.coalesce(F.when(fits, number.cast("long")), F.lit(default).cast("long"))


def clean_str(c: Column) -> Column:
    """Trim; null and placeholders become the empty string."""
    text = F.coalesce(c, F.lit(""))
    return F.when(text.isin(UNSET, EMPTY), F.lit("")).otherwise(strip(text))


def unplaced(c: Column) -> Column:
    """Trim first, then drop placeholders (the order domain fields use)."""
    text = strip(F.coalesce(c, F.lit("")))
    return F.when(text.isin(UNSET, EMPTY), F.lit("")).otherwise(text)


def split_answers(c: Column) -> Column:
    """Comma list -> array of trimmed answers without blanks and ``-``."""
    text = F.coalesce(c, F.lit(""))
    parts = F.transform(F.split(text, ","), strip)
    kept = F.filter(parts, lambda a: ~a.isin(UNSET, ""))
    return F.when(text.isin("", UNSET, EMPTY), F.array().cast("array<string>")).otherwise(kept)


def shannon_entropy(c: Column) -> Column:
    """Character entropy in bits, 4 places; 0 for null and for fewer than two characters."""
    n = F.length(c).cast("double")
    letters = F.array_distinct(F.split(c, ""))

    def term(total: Column, letter: Column) -> Column:
        p = (F.length(c) - F.length(F.replace(c, letter, F.lit("")))) / n
        return total - p * F.log2(p)

    bits = F.aggregate(F.filter(letters, lambda x: x != ""), F.lit(0.0), term)
    return F.when(F.length(c) > 1, round_half_even(bits)).otherwise(F.lit(0.0))


def dns_vowel_ratio(c: Column) -> Column:
    """Vowels over letters, case-insensitive."""
    low = F.lower(c)
    letters = F.length(F.regexp_replace(low, r"[^\p{L}]", ""))
    vowels = F.length(F.regexp_replace(low, "[^aeiou]", ""))
    return F.when(letters > 0, round_half_even(vowels / letters)).otherwise(F.lit(0.0))


def dns_numeric_ratio(c: Column) -> Column:
    """Digits over characters other than dots."""
    body = F.regexp_replace(c, r"\.", "")
    digits = F.length(F.regexp_replace(body, r"[^\p{Nd}]", ""))
    return F.when(F.length(body) > 0, round_half_even(digits / F.length(body))).otherwise(F.lit(0.0))


def _labels(c: Column) -> Column:
    return F.filter(F.split(c, r"\."), lambda label: label != "")


def _is_domain(c: Column) -> Column:
    return c.isNotNull() & ~c.isin("", UNSET, EMPTY, ".")


def dns_subdomain_depth(c: Column) -> Column:
    """Number of labels minus one, never below zero."""
    depth = F.greatest(F.size(_labels(c)) - 1, F.lit(0))
    return F.when(_is_domain(c), depth).otherwise(F.lit(0))


def dns_max_label_len(c: Column) -> Column:
    longest = F.array_max(F.transform(_labels(c), F.length))
    return F.when(_is_domain(c), F.coalesce(longest, F.lit(0))).otherwise(F.lit(0))


def flag(condition: Column) -> Column:
    """Boolean -> 1.0 / 0.0, null counts as false."""
    return F.when(condition, F.lit(1.0)).otherwise(F.lit(0.0))


def port_class(port: Column) -> dict[str, Column]:
    return {
        "is_well_known_dst_port": flag(port < 1024),
        "is_registered_dst_port": flag(port.between(1024, 49151)),
        "is_dynamic_dst_port": flag(port > 49151),
    }


def proto_onehot(proto: Column) -> dict[str, Column]:
    return {f"proto_is_{p}": flag(F.lower(proto) == p) for p in ("tcp", "udp", "icmp")}


def state_onehot(state: Column) -> dict[str, Column]:
    s = F.upper(state)
    return {
        "conn_state_is_SF": flag(s == "SF"),
        "conn_state_is_S0": flag(s == "S0"),
        "conn_state_is_REJ": flag(s == "REJ"),
        "conn_state_is_RSTO": flag(s.isin("RSTO", "RSTOS0", "RSTR")),
    }


def history_flags(history: Column) -> dict[str, Column]:
    """Raw history string: a ``-`` placeholder keeps its length of one."""
    h = F.coalesce(history, F.lit(""))
    return {
        "history_len": F.length(h).cast("double"),
        "history_has_syn": flag(h.rlike("[Ss]")),
        "history_has_reset": flag(h.rlike("[Rr]")),
    }


def bytes_per_packet(total_bytes: Column, total_packets: Column) -> Column:
    return F.when(total_packets > 0, round_half_even(total_bytes / total_packets)).otherwise(F.lit(0.0))


def byte_packet_ratios(ob: Column, rb: Column, op: Column, tb: Column, tp: Column) -> dict[str, Column]:
    return {
        "orig_bytes_ratio": round_half_even(ob / (tb + 1.0)),
        "orig_packets_ratio": round_half_even(op / (tp + 1.0)),
        "bytes_asymmetry_ratio": round_half_even((ob - rb) / (ob + rb + 1.0)),
    }


def iso_timestamp(epoch_seconds: Column) -> Column:
    """Epoch seconds -> ISO-8601 UTC text, whatever the session time zone is.

    The fraction is written only when it is not zero, always with six digits.
    """
    micros = F.rint(epoch_seconds * 1e6).cast("decimal(24,0)")
    seconds = (micros / F.lit(1000000).cast("decimal(10,0)")).cast("decimal(18,6)")
    epoch = F.expr("timestamp_ntz'1970-01-01 00:00:00'")
    zero = F.lit(0)
    moment = epoch + F.make_dt_interval(zero, zero, zero, seconds)
    whole = F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.date_format(moment, "SSSSSS")
    return F.concat(whole, F.when(fraction == "000000", "").otherwise(F.concat(F.lit("."), fraction)), F.lit("+00:00"))


def endpoint_str(ip: Column, port: Column) -> Column:
    return F.concat(ip, F.lit(":"), port.cast("string"))


def round_probabilities(m: Column) -> Column:
    return F.transform_values(m, lambda _, v: round_half_even(v))


def is_threat(label: Column, abstained: Column, decision: Column) -> Column:
    return (label != "BENIGN") & ~abstained & (decision == "AUTOMATED_DETECTION")


def clamp0(c: Column) -> Column:
    """``max(0, x)`` where NaN also becomes 0."""
    return F.greatest(F.lit(0.0), F.nanvl(c.cast("double"), F.lit(0.0)))
