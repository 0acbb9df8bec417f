"""DuckDB SQL twins that are too long for one line: spans, merged hits, chains."""

from __future__ import annotations

from caduspark.functions import fixed
from caduspark.functions.hashing import hmac_pads

#: RE2 has no lookahead: the numbers that the pattern excludes are left out one by one.
SSN = r"\b(?:00[1-9]|0[1-9]\d|[1-578]\d{2}|6(?:[0-57-9]\d|6[0-57-9]))[- ](?:0[1-9]|[1-9]\d)[- ](?:000[1-9]|00[1-9]\d|0[1-9]\d{2}|[1-9]\d{3})\b"


def pattern_of(kind: str, pattern: str) -> str:
    return (SSN if kind == "SSN" else pattern.replace("(?iu)", "(?i)")).replace("'", "''")


def spans(view: str, key: str, text: str = "text", types: list[str] | None = None) -> str:
    """SELECT key, phi_type, place, start, stop, value, confidence of all pattern hits of a view."""
    parts = []
    for place, (kind, pattern, confidence, _) in enumerate(fixed.PATTERNS):
        if types is not None and kind not in types:
            continue
        p = pattern_of(kind, pattern)
        parts.append(
            f"SELECT {key}, '{kind}' AS phi_type, {place} AS place, {confidence}::DOUBLE AS confidence, m[i] AS value, "
            f"coalesce(list_sum(list_transform(g[1:i], lambda x: len(x))), 0) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: len(x))), 0) AS start "
            f"FROM (SELECT {key}, m, g, unnest(generate_series(1, len(m))) AS i FROM (SELECT {key}, regexp_extract_all({text}, '{p}', 0) AS m, string_split_regex({text}, '{p}') AS g FROM v) WHERE len(m) > 0)"
        )
    return f"WITH v AS ({view}), raw AS ({' UNION ALL '.join(parts)}) SELECT {key}, phi_type, place, cast(start AS INT) AS start, cast(start + len(value) AS INT) AS stop, value, confidence FROM raw"


def merged(view: str, key: str, text: str = "text", types: list[str] | None = None) -> str:
    """The same with overlaps folded: union of spans, metadata of the best (confidence, length).

    Islands by running maximum; equal to the fold wherever an island's best hit is best at each step, as in these views.
    """
    return (
        f"WITH s AS ({spans(view, key, text, types)}), o AS (SELECT *, max(stop) OVER (PARTITION BY {key} ORDER BY start, -(stop - start), -confidence, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s), "
        f"n AS (SELECT *, sum(CASE WHEN before IS NULL OR start >= before THEN 1 ELSE 0 END) OVER (PARTITION BY {key} ORDER BY start, -(stop - start), -confidence, place ROWS UNBOUNDED PRECEDING) AS island FROM o) "
        f"SELECT {key}, island, min(start) AS start, max(stop) AS stop, arg_max(phi_type, confidence * 1000000 + (stop - start)) AS phi_type, arg_max(value, confidence * 1000000 + (stop - start)) AS value, "
        f"arg_max(confidence, confidence * 1000000 + (stop - start)) AS confidence FROM n GROUP BY {key}, island"
    )


def redacted(view: str, key: str, replacement: str, text: str = "text", types: list[str] | None = None) -> str:
    """SELECT key, redacted of every row; `replacement` is SQL over phi_type and value."""
    return (
        f"WITH v0 AS ({view}), h AS ({merged(view, key, text, types)}), p AS (SELECT {key}, start, stop, {replacement} AS r, coalesce(lag(stop) OVER (PARTITION BY {key} ORDER BY start), 0) AS after FROM h), "
        f"j AS (SELECT v0.{key}, any_value(v0.{text}) AS t, string_agg(substr(v0.{text}, cast(after + 1 AS BIGINT), cast(start - after AS BIGINT)) || r, '' ORDER BY start) AS a, max(stop) AS z FROM v0 JOIN p USING ({key}) GROUP BY v0.{key}) "
        f"SELECT v0.{key}, CASE WHEN j.{key} IS NULL THEN v0.{text} ELSE j.a || substr(j.t, cast(j.z + 1 AS BIGINT)) END AS redacted FROM v0 LEFT JOIN j USING ({key})"
    )


PSEUDONYM = (
    "(CASE phi_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fixed.PSEUDONYM_PREFIX.items()) + " ELSE lower(phi_type) END) || '_' || substr(sha256('session|' || phi_type || '|' || value), 1, 8)"
)
GENERALIZED = (
    "CASE phi_type WHEN 'DATE' THEN coalesce(list_filter(list_transform(string_split(replace(value, '/', '-'), '-'), lambda t: trim(t)), lambda t: regexp_full_match(t, '[0-9]{4}'))[1], '[DATE_YEAR_UNKNOWN]') "
    "WHEN 'ZIP' THEN substr(regexp_replace(value, '[^0-9]', '', 'g'), 1, 3) || '**' ELSE '[' || phi_type || ']' END"
)


def json_body(number: str = "sequence_number") -> str:
    """The canonical form of an event without its links."""
    return (
        f"cast(json_object('agent_id', agent_id, 'confidence_score', confidence_score, 'event_id', event_id, 'event_type', event_type, 'input_hash', input_hash, 'risk_tier', risk_tier, "
        f"'sequence_number', {number}, 'session_id', session_id, 'ts_us', ts_us) AS VARCHAR)"
    )


def hmac(message: str, key: bytes) -> str:
    inner, outer = hmac_pads(key)
    return f"sha256(from_hex('{outer}') || from_hex(sha256(from_hex('{inner}') || encode({message}))))"


def chain(view: str, key: bytes) -> str:
    """WITH RECURSIVE ... chain AS (...): emitted, linked and signed events of a view (no SELECT at the end)."""
    return (
        f"WITH RECURSIVE src AS (SELECT * REPLACE (cast(row_number() OVER (PARTITION BY session_id ORDER BY sequence_number, event_id) AS BIGINT) AS sequence_number) FROM ({view})), "
        f"bodies AS (SELECT *, {json_body()} AS body FROM src), "
        "links AS (SELECT session_id, sequence_number, '' AS prev, sha256(body) AS hash FROM bodies WHERE sequence_number = 1 "
        "UNION ALL SELECT b.session_id, b.sequence_number, l.hash, sha256(b.body || l.hash) FROM links l JOIN bodies b ON b.session_id = l.session_id AND b.sequence_number = l.sequence_number + 1), "
        f"chain AS (SELECT b.*, l.prev AS prev_event_hash, l.hash AS event_hash, {hmac('b.body || l.prev', key)} AS signature FROM bodies b JOIN links l USING (session_id, sequence_number))"
    )


def verify(source: str, key: bytes | None) -> str:
    """, verified AS (...) over a table or CTE of stored events."""
    signature = f"WHEN signature IS NULL OR signature <> {hmac(json_body() + ' || prev_event_hash', key)} THEN 'event ' || event_id || ' signature invalid' " if key is not None else ""
    return (
        f", hashed AS (SELECT *, sha256({json_body()} || prev_event_hash) AS h, row_number() OVER (PARTITION BY session_id ORDER BY sequence_number, event_id) AS i FROM {source}), "
        "linked AS (SELECT *, coalesce(lag(h) OVER (PARTITION BY session_id ORDER BY i), '') AS p FROM hashed), "
        "errors AS (SELECT *, CASE WHEN sequence_number <> i THEN 'event ' || event_id || ' has sequence_number ' || sequence_number || ', expected ' || i || ' (gap or reorder)' "
        "WHEN p IS DISTINCT FROM prev_event_hash THEN 'event ' || event_id || ' (#' || sequence_number || ') has prev_event_hash mismatch at index ' || (i - 1) " + signature + "END AS error FROM linked), "
        "verified AS (SELECT session_id, min(i) FILTER (error IS NOT NULL) IS NULL AS ok, arg_min(error, i) FILTER (error IS NOT NULL) AS error, count(*) AS n, arg_max(h, i) AS head FROM errors GROUP BY session_id)"
    )
