"""The registered queries restated in plain SQL over the same tables.

Views are spelled out as common table expressions; :func:`sql` prefixes a statement with the
views it names. The statements follow the definitions directly (RANGE frames, correlated
counts), not the plans used on Spark.
"""

from __future__ import annotations

import re

VIEWS = {
    "ev": """
        SELECT event_id, user_id, event_type, value, k, ts, uid,
               '10.0.' || (user_id // 256) || '.' || (user_id % 256) AS src_ip,
               '93.184.' || (d // 10) || '.' || (d % 10) AS dst_ip
        FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k,
                     (user_id * 4 + CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 4) % 101 AS d,
                     'C' || event_id AS uid
              FROM (SELECT event_id, user_id, event_type, value, props,
                           CAST(epoch_us(ts) AS DOUBLE) / CAST(1000000 AS DOUBLE) / CAST(1440 AS DOUBLE) AS ts
                    FROM events))""",
    "conn_v": """
        SELECT *, CASE WHEN total_packets > 0 THEN round_even(CAST(total_bytes AS DOUBLE) / total_packets, 4) ELSE 0 END AS bytes_per_packet
        FROM (SELECT *, orig_bytes + resp_bytes AS total_bytes, orig_packets + resp_packets AS total_packets
              FROM (SELECT event_id, user_id, event_type, k, ts, uid, src_ip, 40000 + event_id % 20000 AS src_port, dst_ip,
                           CAST(CASE event_type WHEN 'click' THEN 443 WHEN 'view' THEN 53 WHEN 'purchase' THEN 8080
                                WHEN 'signup' THEN 60000 ELSE 80 END AS BIGINT) AS dst_port,
                           CASE event_type WHEN 'view' THEN 'udp' ELSE 'tcp' END AS protocol,
                           CASE event_type WHEN 'click' THEN 'ssl' WHEN 'view' THEN 'dns' WHEN 'purchase' THEN 'http' ELSE '' END AS service,
                           value / 100 AS duration,
                           CASE WHEN event_type = 'error' THEN 0 ELSE CAST(floor(value * 10) AS BIGINT) END AS orig_bytes,
                           CASE WHEN event_type = 'error' THEN 0 ELSE CAST(floor(value * 25) AS BIGINT) END AS resp_bytes,
                           1 + event_id % 7 AS orig_packets, event_id % 5 AS resp_packets, CAST(0 AS BIGINT) AS missed_bytes,
                           CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN 'S0' WHEN event_type = 'error' THEN 'REJ'
                                WHEN event_type = 'signup' AND event_id % 3 = 0 THEN 'RSTO' ELSE 'SF' END AS conn_state,
                           CASE event_type WHEN 'error' THEN 'S' WHEN 'view' THEN 'Dd' ELSE 'ShADda' END AS history
                    FROM ev))""",
    "host_v": """
        SELECT ev.*, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host
        FROM ev JOIN pages ON page_id = event_id % (SELECT count(*) FROM pages)""",
    "dns_v": """
        SELECT ts + seq * CAST(0.5 AS DOUBLE) AS ts, seq, uid, src_ip, dst_ip, host AS query,
               CASE WHEN seq = 1 THEN 'CNAME' WHEN event_id % 5 = 0 THEN 'TXT' ELSE 'A' END AS qtype_name,
               CASE WHEN seq = 0 AND event_id % 7 = 0 THEN 'NXDOMAIN' ELSE 'NOERROR' END AS rcode_name,
               CASE event_id % 3 WHEN 0 THEN '-' WHEN 1 THEN '93.184.216.34' ELSE '93.184.216.34, 93.184.216.35,-' END AS answers,
               value / 1000 AS rtt
        FROM (SELECT *, CAST(0 AS BIGINT) AS seq FROM host_v WHERE event_type = 'view'
              UNION ALL SELECT *, CAST(1 AS BIGINT) FROM host_v WHERE event_type = 'view' AND event_id % 10 = 0)""",
    "weird_v": """
        SELECT ts, CAST(0 AS BIGINT) AS seq, uid, src_ip, dst_ip,
               CASE WHEN event_id % 8 = 0 THEN 'bad_SYN_ack' ELSE 'bad_HTTP_request' END AS name,
               CASE WHEN event_id % 12 = 0 THEN 'T' ELSE 'F' END AS notice
        FROM ev WHERE event_type = 'error' AND event_id % 4 = 0
        UNION ALL
        SELECT ts, CAST(1 AS BIGINT), uid, src_ip, dst_ip, 'possible_split_routing', CASE WHEN event_id % 12 = 0 THEN 'T' ELSE 'F' END
        FROM ev WHERE event_type = 'error' AND event_id % 16 = 0""",
    "ssl_v": """
        SELECT uid, host AS server_name, CASE WHEN event_id % 9 = 0 THEN 'TLSv10' ELSE 'TLSv13' END AS version,
               CASE WHEN event_id % 13 = 0 THEN 'self signed certificate' ELSE 'ok' END AS validation_status,
               'CN=a' AS subject, CASE WHEN event_id % 17 = 0 THEN 'CN=a' ELSE 'CN=b' END AS issuer,
               CASE WHEN event_id % 5 = 0 THEN '-' ELSE lower(hex(event_id)) END AS ja3,
               CASE WHEN event_id % 3 = 0 THEN 'T' ELSE 'F' END AS resumed
        FROM host_v WHERE event_type = 'click'""",
    "quic_v": """
        SELECT uid, host AS server_name, lower(hex(event_id)) AS dcid FROM host_v WHERE event_type = 'purchase'""",
    "runs_v": """
        SELECT uid, 'exp_' || (user_id % 12) AS experiment_id,
               ['BENIGN', 'DDOS', 'RECON', 'DNS_TUNNEL', 'C2_BEACON', 'SLOW_HTTP'][c + 1] AS label,
               CAST([0, 1, 2, 4, 5, 7][c + 1] AS INTEGER) AS label_id
        FROM (SELECT *, (list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) - 1 + k % 2) % 6 AS c FROM ev)""",
    "pred_v": """
        SELECT uid, event_id, experiment_id, label, label_id, processing_time_ms, p,
               [p[1], p[2], p[3], p[4], p[5], p[6]] AS probs, list_max(p) AS max_p,
               list_position(p, list_max(p)) AS top
        FROM (SELECT ev.uid, event_id, experiment_id, label, label_id,
                     ((event_id * 37 + k) % 1000) / CAST(10 AS DOUBLE) + 5 AS processing_time_ms,
                     [CAST(x AS DOUBLE) / list_sum(w) for x in w] AS p
              FROM (SELECT *, [1 + (event_id * q + k) % 97 for q in [3, 5, 7, 11, 13, 17]] AS w FROM ev) ev
              JOIN runs_v USING (uid))""",
    "arg_v": """
        SELECT *, ['BENIGN', 'DDOS', 'RECON', 'DNS_TUNNEL', 'C2_BEACON', 'SLOW_HTTP'][top] AS prediction,
               max_p AS max_confidence, label = ['BENIGN', 'DDOS', 'RECON', 'DNS_TUNNEL', 'C2_BEACON', 'SLOW_HTTP'][top] AS is_correct
        FROM pred_v""",
    "verdict_v": """
        SELECT *, ['BENIGN', 'DDOS', 'RECON', 'DNS_TUNNEL', 'C2_BEACON', 'SLOW_HTTP'][pick] AS predicted_label,
               CAST([0, 1, 2, 4, 5, 7][pick] AS INTEGER) AS predicted_class_id, round_even(conf, 4) AS confidence,
               conf < 0.40::DOUBLE AS abstained,
               CASE WHEN conf < 0.40::DOUBLE THEN 'ANALYST_REVIEW' ELSE 'AUTOMATED_DETECTION' END AS decision
        FROM (SELECT *, CASE WHEN p[3] >= 0.35::DOUBLE AND p[3] >= max_p * 0.9::DOUBLE THEN 3 ELSE top END AS pick,
                     CASE WHEN p[3] >= 0.35::DOUBLE AND p[3] >= max_p * 0.9::DOUBLE THEN p[3] ELSE max_p END AS conf
              FROM pred_v)""",
    "alert_v": """
        SELECT sha256(c.uid || '|' || CAST(floor(c.ts * 1000000) AS BIGINT)) AS alert_id, c.uid AS flow_uid, c.ts AS "timestamp",
               strftime(make_timestamp(CAST(round_even(c.ts * 1000000, 0) AS BIGINT)), '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS timestamp_iso,
               src_ip AS source_ip, dst_ip AS destination_ip, src_port AS source_port, dst_port AS destination_port,
               lower(protocol) AS protocol, predicted_class_id, predicted_label, confidence, abstained, decision, p,
               round_even(processing_time_ms, 3) AS processing_time_ms, experiment_id, event_id,
               duration, orig_bytes, resp_bytes, total_bytes, conn_state, label
        FROM conn_v c JOIN (SELECT * EXCLUDE (event_id) FROM verdict_v) v USING (uid)""",
    "win_v": """
        SELECT f.*, x.* FROM (
        SELECT uid,
          CAST(greatest(1, count(*) OVER s60) AS DOUBLE) AS win_src_flow_count_60s,
          round_even((count(*) OVER s10) / CAST(10 AS DOUBLE), 4) AS win_src_flow_rate_10s,
          CAST(greatest(1, count(DISTINCT dst_ip) OVER s60) AS DOUBLE) AS win_src_unique_dst_ips_60s,
          CAST(greatest(1, count(DISTINCT dst_port) OVER s60) AS DOUBLE) AS win_src_unique_dst_ports_60s,
          round_even(CAST(count(*) FILTER (upper(conn_state) <> 'SF') OVER s60 AS DOUBLE) / (count(*) OVER s60), 4) AS win_src_failed_conn_ratio_60s,
          round_even(CAST(count(*) FILTER (upper(conn_state) = 'S0') OVER s60 AS DOUBLE) / (count(*) OVER s60), 4) AS win_src_s0_syn_ratio_60s,
          CAST(sum(orig_bytes) OVER s300 AS DOUBLE) AS win_src_total_orig_bytes_300s,
          round_even(CAST(sum(orig_bytes) OVER s60 AS DOUBLE) / 60, 4) AS win_src_outbound_byte_rate_60s,
          round_even((count(*) OVER d10) / CAST(10 AS DOUBLE), 4) AS win_dst_inbound_flow_rate_10s,
          CAST(greatest(1, count(DISTINCT src_ip) OVER d60) AS DOUBLE) AS win_dst_unique_sources_60s,
          round_even(CAST(count(*) FILTER (upper(conn_state) = 'S0') OVER d10 AS DOUBLE) / (count(*) OVER d10), 4) AS win_dst_s0_syn_ratio_10s,
          round_even(CAST(sum(total_bytes) OVER d60 AS DOUBLE) / (count(*) OVER d60), 4) AS win_dst_avg_bytes_per_flow_60s,
          CAST(greatest(1, count(*) OVER p300) AS DOUBLE) AS win_pair_flow_count_300s,
          CAST(sum(orig_bytes) OVER p300 AS DOUBLE) AS win_pair_total_orig_bytes_300s,
          CASE WHEN count(*) OVER p300 >= 2 THEN round_even(stddev_pop(orig_bytes) OVER p300, 4) ELSE 0 END AS win_pair_orig_bytes_std,
          list(ts) OVER p300 AS seen
        FROM conn_v
        WINDOW s10 AS (PARTITION BY src_ip ORDER BY ts RANGE BETWEEN 10 PRECEDING AND CURRENT ROW),
               s60 AS (PARTITION BY src_ip ORDER BY ts RANGE BETWEEN 60 PRECEDING AND CURRENT ROW),
               s300 AS (PARTITION BY src_ip ORDER BY ts RANGE BETWEEN 300 PRECEDING AND CURRENT ROW),
               d10 AS (PARTITION BY dst_ip ORDER BY ts RANGE BETWEEN 10 PRECEDING AND CURRENT ROW),
               d60 AS (PARTITION BY dst_ip ORDER BY ts RANGE BETWEEN 60 PRECEDING AND CURRENT ROW),
               p300 AS (PARTITION BY src_ip, dst_ip ORDER BY ts RANGE BETWEEN 300 PRECEDING AND CURRENT ROW)) x
        JOIN (SELECT * FROM conn_v) f USING (uid)""",
    "gap_v": """
        SELECT uid, CASE WHEN len(g) > 0 THEN round_even(m, 4) ELSE 0 END AS win_pair_delta_t_mean,
               CASE WHEN len(g) > 0 THEN round_even(s, 4) ELSE 0 END AS win_pair_delta_t_std,
               CASE WHEN len(g) > 0 THEN round_even(least(5, s / (m + CAST(1e-6 AS DOUBLE))), 4) ELSE 1 END AS win_pair_delta_t_cv
        FROM (SELECT uid, g, list_avg(g) AS m, list_aggregate(g, 'stddev_pop') AS s
              FROM (SELECT uid, [l[i + 1] - l[i] for i in range(1, len(l))] AS g
                    FROM (SELECT uid, list_sort(seen) AS l FROM win_v)))""",
    "aux_v": """
        SELECT f.uid,
          CAST(coalesce(d.n, 0) AS DOUBLE) AS win_src_dns_query_count_60s,
          CASE WHEN d.n > 0 THEN round_even(CAST(d.nx AS DOUBLE) / d.n, 4) ELSE 0 END AS win_src_dns_nxdomain_ratio_60s,
          CAST(coalesce(d.doms, 0) AS DOUBLE) AS win_src_dns_unique_domains_60s,
          CAST(coalesce(w.n, 0) AS DOUBLE) AS win_src_weird_count_60s
        FROM conn_v f
        LEFT JOIN (SELECT c.uid, count(*) AS n, count(*) FILTER (upper(rcode_name) = 'NXDOMAIN') AS nx, count(DISTINCT query) AS doms
                   FROM conn_v c JOIN dns_v q ON q.src_ip = c.src_ip AND q.ts >= c.ts - 60 AND q.ts <= c.ts GROUP BY c.uid) d ON d.uid = f.uid
        LEFT JOIN (SELECT c.uid, count(*) AS n
                   FROM conn_v c JOIN weird_v q ON q.src_ip = c.src_ip AND q.ts >= c.ts - 60 AND q.ts <= c.ts GROUP BY c.uid) w ON w.uid = f.uid""",
    "flowf_v": """
        SELECT uid, duration AS flow_duration, CAST(orig_bytes AS DOUBLE) AS orig_bytes, CAST(resp_bytes AS DOUBLE) AS resp_bytes,
          CAST(total_bytes AS DOUBLE) AS total_bytes, CAST(orig_packets AS DOUBLE) AS orig_packets,
          CAST(resp_packets AS DOUBLE) AS resp_packets, CAST(total_packets AS DOUBLE) AS total_packets, bytes_per_packet,
          round_even(CAST(orig_bytes AS DOUBLE) / (total_bytes + 1), 4) AS orig_bytes_ratio,
          round_even(CAST(orig_packets AS DOUBLE) / (total_packets + 1), 4) AS orig_packets_ratio,
          round_even(CAST(orig_bytes - resp_bytes AS DOUBLE) / (orig_bytes + resp_bytes + 1), 4) AS bytes_asymmetry_ratio,
          CAST(missed_bytes AS DOUBLE) AS missed_bytes,
          CAST(dst_port < 1024 AS DOUBLE) AS is_well_known_dst_port,
          CAST(dst_port BETWEEN 1024 AND 49151 AS DOUBLE) AS is_registered_dst_port,
          CAST(dst_port > 49151 AS DOUBLE) AS is_dynamic_dst_port,
          CAST(src_ip LIKE '10.%' AS DOUBLE) AS is_src_private_ip, CAST(dst_ip NOT LIKE '93.%' AS DOUBLE) AS is_dst_private_ip,
          CAST(protocol = 'tcp' AS DOUBLE) AS proto_is_tcp, CAST(protocol = 'udp' AS DOUBLE) AS proto_is_udp,
          CAST(protocol = 'icmp' AS DOUBLE) AS proto_is_icmp,
          CAST(conn_state = 'SF' AS DOUBLE) AS "conn_state_is_SF", CAST(conn_state = 'S0' AS DOUBLE) AS "conn_state_is_S0",
          CAST(conn_state = 'REJ' AS DOUBLE) AS "conn_state_is_REJ",
          CAST(conn_state IN ('RSTO', 'RSTOS0', 'RSTR') AS DOUBLE) AS "conn_state_is_RSTO",
          CAST(length(history) AS DOUBLE) AS history_len, CAST(contains(lower(history), 's') AS DOUBLE) AS history_has_syn,
          CAST(contains(lower(history), 'r') AS DOUBLE) AS history_has_reset
        FROM conn_v""",
    "text_v": """
        SELECT host, CASE WHEN length(host) > 1 THEN
                 round_even(list_sum([-((length(host) - length(replace(host, c, ''))) / CAST(length(host) AS DOUBLE))
                     * log2((length(host) - length(replace(host, c, ''))) / CAST(length(host) AS DOUBLE))
                     for c in list_distinct(string_split(host, ''))]), 4) ELSE 0 END AS entropy,
               CAST(greatest(len([x for x in string_split(host, '.') if x <> '']) - 1, 0) AS INTEGER) AS depth,
               CAST(list_max([length(x) for x in string_split(host, '.') if x <> '']) AS INTEGER) AS longest,
               round_even(CAST(length(regexp_replace(host, '[^0-9]', '', 'g')) AS DOUBLE) / length(replace(host, '.', '')), 4) AS numeric_ratio,
               round_even(CAST(length(regexp_replace(host, '[^aeiou]', '', 'g')) AS DOUBLE) / length(regexp_replace(host, '[^a-z]', '', 'g')), 4) AS vowel_ratio
        FROM (SELECT DISTINCT lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) AS host FROM pages)""",
    "dnsf_v": """
        SELECT uid, CAST(1 AS DOUBLE) AS has_dns_context, CAST(length(query) AS DOUBLE) AS dns_query_len, entropy AS dns_query_entropy,
          CAST(depth AS DOUBLE) AS dns_subdomain_depth, CAST(longest AS DOUBLE) AS dns_max_label_len,
          numeric_ratio AS dns_numeric_ratio, vowel_ratio AS dns_vowel_ratio,
          CAST(qtype_name = 'A' AS DOUBLE) AS "dns_qtype_is_A", CAST(qtype_name = 'TXT' AS DOUBLE) AS "dns_qtype_is_TXT",
          CAST(qtype_name IN ('NULL', 'CNAME', 'ANY') AS DOUBLE) AS "dns_qtype_is_NULL",
          CAST(rcode_name = 'NXDOMAIN' AS DOUBLE) AS dns_is_nxdomain,
          CAST(len([a for a in string_split(answers, ',') if trim(a) NOT IN ('-', '')]) AS DOUBLE) AS dns_answer_count,
          round_even(greatest(0, rtt), 4) AS dns_rtt
        FROM (SELECT * FROM dns_v QUALIFY row_number() OVER (PARTITION BY uid ORDER BY seq DESC) = 1) d JOIN text_v ON host = query""",
    "quicf_v": """
        SELECT uid, CAST(1 AS DOUBLE) AS has_quic_context, CAST(length(server_name) AS DOUBLE) AS quic_sni_len,
          entropy AS quic_sni_entropy, CAST(length(dcid) AS DOUBLE) AS quic_dcid_len
        FROM quic_v JOIN text_v ON host = server_name""",
    "weirdf_v": """
        SELECT uid, CAST(1 AS DOUBLE) AS has_weird_anomaly, CAST(count(*) AS DOUBLE) AS weird_anomaly_count_flow,
          CAST(bool_or(name IN ('bad_SYN_ack', 'SYN_inside_connection')) AS DOUBLE) AS weird_is_bad_syn_ack,
          CAST(bool_or(contains(name, 'HTTP')) AS DOUBLE) AS weird_is_bad_http, CAST(bool_or(notice = 'T') AS DOUBLE) AS weird_notice_flag
        FROM weird_v GROUP BY uid""",
    "sslf_v": """
        SELECT uid, CAST(1 AS DOUBLE) AS has_ssl_context, CAST(length(server_name) AS DOUBLE) AS ssl_sni_len, entropy AS ssl_sni_entropy,
          CAST(version IN ('SSLv3', 'TLSv10', 'TLSv11', 'TLS 1.0', 'TLS 1.1') AS DOUBLE) AS ssl_is_outdated_version,
          CAST(contains(validation_status, 'self signed') OR subject = issuer AS DOUBLE) AS ssl_is_self_signed,
          CAST(ja3 <> '-' AS DOUBLE) AS ssl_has_ja3_fingerprint, CAST(resumed = 'T' AS DOUBLE) AS ssl_resumed_flag
        FROM ssl_v JOIN text_v ON host = server_name""",
}


def _context_view(name: str, columns: list[str]) -> str:
    filled = ", ".join(f'coalesce(x."{c}", 0) AS "{c}"' for c in columns)
    return f"SELECT f.uid, {filled} FROM conn_v f LEFT JOIN {name} x ON x.uid = f.uid"


def matrix_select(features: list[str]) -> str:
    """SELECT of the feature table, joining only what ``features`` need."""
    from netquill import contract as K

    sources = [
        ("flowf_v", "ff", K.FLOW_FEATURES), ("dnsf_v", "df", K.DNS_FEATURES), ("quicf_v", "qf", K.QUIC_FEATURES),
        ("weirdf_v", "wf", K.WEIRD_FEATURES), ("sslf_v", "sf", K.SSL_FEATURES),
        ("aux_v", "ax", [f for f in K.SRC_WINDOW_FEATURES if "dns" in f or "weird" in f]),
        ("gap_v", "gp", [f for f in K.PAIR_WINDOW_FEATURES if "delta_t" in f]),
        ("win_v", "wn", K.WINDOW_FEATURES),
    ]
    chosen, joins, taken = [], [], set()
    for view, alias, members in sources:
        mine = [f for f in features if f in members and f not in taken]
        taken.update(mine)
        if mine:
            chosen += [f'coalesce({alias}."{f}", 0) AS "{f}"' for f in mine]
            joins.append(f"LEFT JOIN {view} {alias} ON {alias}.uid = c.uid")
    identity = (
        'c.uid AS flow_uid, c.ts AS "timestamp", c.src_ip AS source_ip, c.src_port AS source_port, '
        "c.dst_ip AS destination_ip, c.dst_port AS destination_port, c.protocol, c.conn_state AS connection_state"
    )
    return f"SELECT {identity}{', ' if chosen else ''}{', '.join(chosen)} FROM conn_v c {' '.join(joins)}"


def labelled_select(features: list[str]) -> str:
    """The feature table joined with its run and label."""
    return (
        "SELECT m.*, r.experiment_id, r.label, r.label_id, source_ip || ':' || source_port AS source_endpoint, "
        "destination_ip || ':' || destination_port AS destination_endpoint "
        f"FROM ({matrix_select(features)}) m JOIN runs_v r ON r.uid = m.flow_uid"
    )


def sql(body: str) -> str:
    """Prefix ``body`` with the views it uses, in dependency order."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if re.search(rf"\b{name}\b", text) and name not in needed:
                visit_text = VIEWS[name]
                visit(visit_text)
                if name not in needed:
                    needed.append(name)

    visit(body)
    if not needed:
        return body
    prefix = "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({VIEWS[n]})" for n in needed)
    return f"{prefix}\n{body}"
