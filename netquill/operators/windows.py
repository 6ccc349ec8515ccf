"""The 22 backward-looking window features of a flow.

Windows are ``[t-h, t]``, both ends inclusive, per source host, destination host and
(source, destination) pair; all rows sharing ``t`` see each other. DNS and anomaly rows
of the same source are counted in the source windows by joining the same sorted stream, so no
range join is needed.

Flows are added up once per (source, destination, port, instant). The sums are dealt by destination and time slot, sorted and
answered in one stream per task (:mod:`netquill.operators.sliding`), then by source and slot, which answers the source and its pairs
at once. What is joined back is one row per (source, destination, instant) with finished features.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquill.contract import DST_WINDOW_FEATURES, PAIR_WINDOW_FEATURES, SRC_WINDOW_FEATURES, WINDOW_FEATURES
from netquill.functions.scalars import round_half_even
from netquill.operators import sliding as SL
from netquill.operators import timeline as TL
from netquill.sources.stage import importable, staged

#: Width of a time slot: long against the longest window, because a slot gets a copy of every row that its windows reach back to.
SLOT_SECONDS = 600.0
_EDGE = 1.0  # rows are copied a little further than windows reach, because times may round

# Which totals each feature is projected from.
_NEEDS = {
    "win_src_flow_count_60s": ["n60"],
    "win_src_flow_rate_10s": ["n10"],
    "win_src_unique_dst_ips_60s": ["ips"],
    "win_src_unique_dst_ports_60s": ["ports"],
    "win_src_failed_conn_ratio_60s": ["failed", "n60"],
    "win_src_s0_syn_ratio_60s": ["s0", "n60"],
    "win_src_total_orig_bytes_300s": ["ob300"],
    "win_src_outbound_byte_rate_60s": ["ob60"],
    "win_src_dns_query_count_60s": ["queries"],
    "win_src_dns_nxdomain_ratio_60s": ["nx", "queries"],
    "win_src_dns_unique_domains_60s": ["domains"],
    "win_src_weird_count_60s": ["weird"],
    "win_dst_inbound_flow_rate_10s": ["n10"],
    "win_dst_unique_sources_60s": ["sources"],
    "win_dst_s0_syn_ratio_10s": ["s0", "n10"],
    "win_dst_avg_bytes_per_flow_60s": ["bytes", "n60"],
    "win_pair_flow_count_300s": ["n"],
    "win_pair_total_orig_bytes_300s": ["ob"],
    "win_pair_delta_t_mean": ["n", "gap"],
    "win_pair_delta_t_std": ["n", "gap", "gap_sq"],
    "win_pair_delta_t_cv": ["n", "gap", "gap_sq"],
    "win_pair_orig_bytes_std": ["n", "ob", "ob_sq"],
}


def _measures(features: Iterable[str]) -> list[str]:
    return list(dict.fromkeys(m for f in features for m in _NEEDS[f]))


#: How far back the totals of a source reach that are not read over 60 s.
_FAR = {"n10": 10.0, "ob300": 300.0}
_SOURCE, _DESTINATION, _PAIR = "source", "destination", "pair"
#: Sums over the flows of an instant that each total is made of.
_SUMS = {
    (_SOURCE, "n10"): ["n"], (_SOURCE, "n60"): ["n"], (_SOURCE, "failed"): ["odd"], (_SOURCE, "s0"): ["s0"], (_SOURCE, "ob60"): ["ob"],
    (_SOURCE, "ob300"): ["ob"], (_DESTINATION, "n10"): ["n"], (_DESTINATION, "n60"): ["n"], (_DESTINATION, "s0"): ["s0"],
    (_DESTINATION, "bytes"): ["tb"], (_PAIR, "n"): ["n"], (_PAIR, "ob"): ["ob"], (_PAIR, "ob_sq"): ["ob_sq"],
}
_TYPES = {"n": "long", "odd": "long", "s0": "long", "ob": "long", "tb": "long", "ob_sq": "decimal(38,0)"}


def _at(rows: DataFrame) -> list[str]:
    return ["ts", TL.TIE] if TL.TIE in rows.columns else ["ts"]


def _flow_instants(flows: DataFrame, sums: list[str], by_port: bool) -> DataFrame:
    """Flows added up per source, destination, port and instant; copies of a row cost nothing from here on. Flows without a time are in no window."""
    state = F.upper("conn_state")
    big = F.col("orig_bytes").cast("decimal(19,0)")
    of = {
        "n": F.count(F.lit(1)), "odd": F.sum((state != "SF").cast("long")), "s0": F.sum((state == "S0").cast("long")), "ob": F.sum("orig_bytes"),
        "tb": F.sum("total_bytes"), "ob_sq": F.sum(big * big),
    }
    port = [F.col("dst_port").cast("long").alias("dst_port")] if by_port else []
    timed = flows.filter(F.col("ts").isNotNull()).withColumn("dst_ip", F.col("dst_ip").cast("string")).withColumn("src_ip", F.col("src_ip").cast("string"))
    return timed.groupBy("src_ip", "dst_ip", *port, *_at(flows)).agg(*[F.coalesce(of[n].cast(_TYPES[n]), F.lit(0).cast(_TYPES[n])).alias(n) for n in sums])


def _slotted(rows: DataFrame, slot_seconds: float, reach: float, payload: Iterable[str] = ()) -> DataFrame:
    """Every row in its own slot (``own``) and, without its ``payload``, in the later slots whose windows reach back to it."""
    slot = lambda c: F.floor(c / F.lit(float(slot_seconds)))
    payload = set(payload)
    place = F.posexplode(F.sequence(slot(F.col("ts")), slot(F.col("ts") + F.lit(reach + _EDGE)))).alias("_copy", "slot")
    placed = rows.select(*rows.columns, place).withColumn("own", F.col("_copy") == 0)
    return placed.select(*[F.when(F.col("own"), F.col(c)).alias(c) if c in payload else F.col(c) for c in rows.columns], "slot", "own")


def _streamed(rows: DataFrame, key: str, reach: float, answer: Callable[..., pa.RecordBatch], schema: dict[str, str]) -> DataFrame:
    """``answer`` for every run of rows of a (key, slot), in the order of time."""
    importable(rows.sparkSession)
    names = list(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in SL.chunks(batches, key, reach + _EDGE):
            out = answer(*found)
            if out.num_rows:
                yield out.select(names)

    ordered = rows.repartition(key, "slot").sortWithinPartitions(key, "slot", *_at(rows))
    return ordered.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in schema.items()))


def totals(flows: DataFrame, dns: DataFrame | None, weird: DataFrame | None, wanted: dict[str, list[str]], slot_seconds: float) -> DataFrame:
    """Totals at every instant of the keys that are asked for: ``d_`` of a destination, ``s_`` of a source and ``p_`` of a pair.

    The keys are ``src_ip`` if a source or pair is asked for, ``dst_ip`` if a destination or pair is, and the instant."""
    at = _at(flows)
    by_source, by_pair = wanted.get(_SOURCE, []), wanted.get(_PAIR, [])
    sums = [n for n in _TYPES if any(n in _SUMS.get((g, m), []) for g, ms in wanted.items() for m in ms)]
    rows = _flow_instants(flows, sums, "ports" in by_source)
    types = dict(rows.dtypes)
    keys: dict[str, str] = {}
    totals_: dict[str, str] = {}
    onward = bool(by_source or by_pair)
    if measures := wanted.get(_DESTINATION):
        totals_ = {f"d_{m}": "long" for m in measures}
        kept = {c: t for c, t in types.items() if onward or c in ("dst_ip", *at)}
        keep = list(kept)
        rows = _streamed(
            _slotted(rows, slot_seconds, 60.0), "dst_ip", 60.0,
            lambda table, group, first, end: SL.destination_totals(table, group, first, end, measures, keep, onward), kept | totals_,
        )
        if not onward:
            return rows
    reach = max([300.0] if by_pair else [], default=0.0)
    reach = max([reach, *[_FAR.get(m, 60.0) for m in by_source]])
    carried = list(totals_)
    paired = bool(by_pair or carried)
    rows = rows.select(*[c for c in rows.columns if c not in ("dst_ip", "tb")], F.col("dst_ip").alias("other"), F.lit(SL.FLOW).alias("kind"))
    parts = [_slotted(rows, slot_seconds, reach, carried)]
    known = ~F.col("src_ip").isin("", "-", "(empty)") & F.col("ts").isNotNull()
    if dns is not None and any(m in by_source for m in ("queries", "nx", "domains")):
        nx = F.coalesce((F.upper("rcode_name") == "NXDOMAIN").cast("long"), F.lit(0))
        asked = dns.filter(known).groupBy("src_ip", F.col("query").alias("other"), *_at(dns)).agg(F.count(F.lit(1)).alias("n"), F.sum(nx).alias("odd"))
        parts.append(_slotted(asked.withColumn("kind", F.lit(SL.NAME)), slot_seconds, 60.0))
    if weird is not None and "weird" in by_source:
        odd = weird.filter(known).groupBy("src_ip", *_at(weird)).agg(F.count(F.lit(1)).alias("n"))
        parts.append(_slotted(odd.withColumn("kind", F.lit(SL.ODD)), slot_seconds, 60.0))
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    for c in {"n", "odd"} - set(rows.columns):
        rows = rows.withColumn(c, F.lit(0).cast("long"))
    keys = {"src_ip": "string", **({"other": "string"} if paired else {}), **{c: types[c] for c in at}}
    totals_ |= {f"s_{m}": "long" for m in by_source} | {f"p_{m}": "decimal(38,0)" if m.endswith("_sq") else "long" for m in by_pair}
    found = _streamed(
        rows, "src_ip", reach,
        lambda table, group, first, end: SL.source_totals(table, group, first, end, by_source, by_pair, [*keys, *carried]), keys | totals_,
    )
    return found.withColumnRenamed("other", "dst_ip")


def _population_std(n: Column, total: Column, squares: Column) -> Column:
    """Standard deviation from exact sums; doubles only if 38 digits do not suffice."""
    exact = F.try_subtract(
        F.try_multiply(n.cast("decimal(19,0)"), squares),
        F.try_multiply(total.cast("decimal(19,0)"), total.cast("decimal(19,0)")).cast("decimal(38,0)"),
    ).cast("double")
    nd, td = n.cast("double"), total.cast("double")
    rough = nd * squares.cast("double") - td * td
    return F.sqrt(F.greatest(F.lit(0.0), F.coalesce(exact, rough))) / nd


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, round_half_even(part / whole)).otherwise(F.lit(0.0))


def _at_least_one(c: Column) -> Column:
    return F.greatest(F.lit(1), c).cast("double")


def _project(feature: str, prefix: str) -> Column:
    c = lambda m: F.col(f"{prefix}{m}")
    if feature in ("win_src_flow_count_60s",):
        out = _at_least_one(c("n60"))
    elif feature in ("win_src_flow_rate_10s", "win_dst_inbound_flow_rate_10s"):
        out = round_half_even(c("n10") / 10.0)
    elif feature in ("win_src_unique_dst_ips_60s", "win_src_unique_dst_ports_60s", "win_dst_unique_sources_60s",
                     "win_pair_flow_count_300s"):
        out = _at_least_one(c(_NEEDS[feature][0]))
    elif feature == "win_src_failed_conn_ratio_60s":
        out = _share(c("failed"), c("n60"))
    elif feature == "win_src_s0_syn_ratio_60s":
        out = _share(c("s0"), c("n60"))
    elif feature == "win_dst_s0_syn_ratio_10s":
        out = _share(c("s0"), c("n10"))
    elif feature == "win_src_outbound_byte_rate_60s":
        out = round_half_even(c("ob60") / 60.0)
    elif feature == "win_src_dns_nxdomain_ratio_60s":
        out = _share(c("nx"), c("queries"))
    elif feature == "win_dst_avg_bytes_per_flow_60s":
        out = round_half_even(c("bytes") / c("n60"))
    elif feature in ("win_pair_delta_t_mean", "win_pair_delta_t_std", "win_pair_delta_t_cv", "win_pair_orig_bytes_std"):
        several = c("n") >= 2
        links = c("n") - 1
        if feature == "win_pair_orig_bytes_std":
            value, alone = round_half_even(_population_std(c("n"), c("ob"), c("ob_sq"))), 0.0
        else:
            mean = c("gap") / F.lit(SL.GAP_UNIT) / F.greatest(links, F.lit(1))
            alone = 0.0
            if feature == "win_pair_delta_t_mean":
                value = round_half_even(mean)
            else:
                std = _population_std(F.greatest(links, F.lit(1)), c("gap"), c("gap_sq")) / F.lit(SL.GAP_UNIT)
                if feature == "win_pair_delta_t_std":
                    value = round_half_even(std)
                else:
                    value, alone = round_half_even(F.least(F.lit(5.0), std / (mean + F.lit(1e-6)))), 1.0
        out = F.when(several, value).otherwise(F.lit(alone))
    else:  # plain totals
        out = c(_NEEDS[feature][0]).cast("double")
    return out.alias(feature)


def window_features(
    flows: DataFrame,
    dns: DataFrame | None = None,
    weird: DataFrame | None = None,
    features: Iterable[str] = WINDOW_FEATURES,
    slot_seconds: float = SLOT_SECONDS,
    targets: DataFrame | None = None,
    arrival: str | None = None,
    stage: Callable[..., DataFrame] = staged,
) -> DataFrame:
    """Flows plus the requested window features.

    Only the totals the requested features need are computed, and all of them are joined back in one go. ``slot_seconds`` sets how
    finely a busy key is cut; results do not depend on it. Both sides of that join are plain shuffles, so
    an instant with very many flows is split by the adaptive skew join.

    ``targets`` restricts the rows that receive features (default: all of ``flows``).
    ``arrival`` names a unique arrival number: then a flow sees only those flows of its own
    instant that arrived before it, as in a replay; DNS and anomaly rows always count as earlier.
    ``stage`` writes the features of the instants and returns them.
    """
    features = list(features)
    out = flows if targets is None else targets
    names = out.columns
    if arrival is not None:
        flows = flows.withColumn(TL.TIE, F.col(arrival).cast("long"))
        out = out.withColumn(TL.TIE, F.col(arrival).cast("long"))
        first = F.lit(-(2 ** 62)).cast("long")
        dns = None if dns is None else dns.withColumn(TL.TIE, first)
        weird = None if weird is None else weird.withColumn(TL.TIE, first)
    groups = {
        _SOURCE: (SRC_WINDOW_FEATURES, "s_", ["src_ip"]),
        _DESTINATION: (DST_WINDOW_FEATURES, "d_", ["dst_ip"]),
        _PAIR: (PAIR_WINDOW_FEATURES, "p_", ["src_ip", "dst_ip"]),
    }
    asked = {g: [f for f in members if f in features] for g, (members, _, _) in groups.items()}
    wanted = {g: _measures(names_of) for g, names_of in asked.items() if names_of}
    if wanted:
        found = totals(flows, dns, weird, wanted, slot_seconds)
        key = [c for c in ("src_ip", "dst_ip") if c in found.columns]
        at = [*key, *_at(out)]
        found = stage(found.select(*[F.col(c).alias(f"_at_{c}") for c in at], *[_project(f, groups[g][1]) for g in wanted for f in asked[g]]))
        # A flow without a source still has its destination's features, and the other way round.
        alone = [c for c in key if not all(c in groups[g][2] for g in wanted)]
        met = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_at_{c}")) if c in alone else F.col(c) == F.col(f"_at_{c}") for c in at])
        out = out.join(found, met, "left")
        for g in wanted:
            known = reduce(Column.__and__, [F.col(c).isNotNull() for c in groups[g][2]])
            out = out.withColumns({f: F.when(known, F.col(f)) for f in asked[g]})
    return out.select(*names, *[f for f in WINDOW_FEATURES if f in features])
