"""SQL that reads the ledgers' dates, shared by the SQL of every query that needs instants."""

from __future__ import annotations

#: Offsets in seconds of the abbreviations of the zones in the table of writers.
ABBREVIATIONS = {
    "UTC": 0, "GMT": 0, "UT": 0, "CET": 3600, "CEST": 7200, "BST": 3600, "EST": -18000, "EDT": -14400, "PST": -28800, "PDT": -25200,
    "IST": 19800, "AEST": 36000, "AEDT": 39600, "JST": 32400}
_MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
_BLANKS = "' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11) || chr(160) || chr(8199) || chr(8239) || chr(8203) || chr(65279)"
_DATES = {
    "ymd": r"(?:\d{4}-\d\d?-\d\d?|\d{4}/\d\d?/\d\d?|\d{4}\.\d\d?\.\d\d?)",
    "num": r"(?:\d\d?/\d\d?/\d{4}|\d\d?\.\d\d?\.\d{4}|\d\d?-\d\d?-\d{4})",
    "dmy": r"(?:[A-Za-z]{3,9},? +)?\d\d?[ -][A-Za-z]{3,9}\.?,?[ -]\d{4}",
    "mdy": r"(?:[A-Za-z]{3,9},? +)?[A-Za-z]{3,9}\.? +\d\d?,? +\d{4}",
}
_TIME = r"(\d\d?:\d\d(?::\d\d(?:[.,]\d+)?)?)"
_TAIL = r"(?: *([AaPp][Mm]))?(?: *([Zz]))?(?: *([A-Za-z]{3,}(?:[/_-][A-Za-z]+)*))?(?: *([+-]\d\d(?::?\d\d(?::?\d\d)?)?))?(?: *[\[(]([A-Za-z][A-Za-z/_+0-9-]*)[\])])?$"


def instants(source: str) -> str:
    """CTEs ending in ``<source>_at``: the rows of a CTE ``source`` (t text, zone, first boolean and any others) with us, UTC microseconds."""
    s = source
    form = "CASE " + " ".join(
        f"WHEN regexp_matches(x, '^{d}(?:{'(?: +|[Tt] ?)' if k == 'ymd' else ',? +'}{_TIME})?{_TAIL}') THEN '{k}'" for k, d in _DATES.items()) + r" WHEN regexp_matches(x, '^\d{9,20}(?:\.\d+)?$') THEN 'epoch'"
    form += rf" WHEN regexp_matches(x, '^\d{{8}}[Tt ]\d{{4}}(?:\d\d(?:[.,]\d+)?)?{_TAIL}') THEN 'compact' END"
    date = "CASE k " + " ".join(f"WHEN '{k}' THEN regexp_extract(x, '^{d}')" for k, d in _DATES.items()) + r" WHEN 'compact' THEN regexp_extract(x, '^\d{8}') END"
    month = "CAST(CASE left(lower(m), 3) " + " ".join(f"WHEN '{m}' THEN {i + 1}" for i, m in enumerate(_MONTHS)) + " END AS INTEGER)"
    abbr = "CASE upper({0}) " + " ".join(f"WHEN '{a}' THEN {o}" for a, o in ABBREVIATIONS.items()) + " END"
    names = "'^(?:january|february|march|april|may|june|july|august|september|october|november|december|sept|jan|feb|mar|apr|jun|jul|aug|sep|oct|nov|dec)$'"
    i = lambda e: f"TRY_CAST({e} AS INTEGER)"
    local_to_utc = "timezone({0}, {1})"
    first = lambda z, t: f"CASE WHEN timezone({z}, {local_to_utc.format(z, t)} - INTERVAL 1 HOUR) = {t} THEN {local_to_utc.format(z, t)} - INTERVAL 1 HOUR ELSE {local_to_utc.format(z, t)} END"
    return rf"""{s}_x AS (SELECT *, trim(translate(t, {_BLANKS}, repeat(' ', 11)), ' ') AS x0 FROM {s}),
{s}_k AS (SELECT * EXCLUDE (x0), {form} AS k FROM (SELECT *, translate(x0, chr(8722) || chr(8208) || chr(8209) || chr(8211), '----') AS x FROM {s}_x)),
{s}_d AS (SELECT *, {date} AS d, CASE WHEN k = 'compact' THEN regexp_replace(substr(x, 10), '^(\d\d)(\d\d)(\d\d)?', '\1:\2:\3') ELSE regexp_replace(substr(x, length({date}) + 1), '^(?:[Tt] ?|,? +)(\d)', '\1') END AS r FROM {s}_k),
{s}_p AS (SELECT *, regexp_extract(r, '^(\d\d?):', 1) AS h0, regexp_extract(r, '^\d\d?:(\d\d)', 1) AS mi0, regexp_extract(r, '^\d\d?:\d\d:(\d\d)', 1) AS s0, regexp_extract(r, '^\d\d?:\d\d:\d\d[.,](\d+)', 1) AS f0,
    regexp_extract(r, '^(?:\d\d?:\d\d:?(?:\d\d(?:[.,]\d+)?)?)?(.*)$', 1) AS z, regexp_extract_all(d, '\d+') AS n, regexp_extract_all(d, '[A-Za-z]+') AS w FROM {s}_d),
{s}_t AS (SELECT *, upper(regexp_extract(z, '^ *([AaPp][Mm])(?:[^A-Za-z/]|$)', 1)) AS ap, regexp_replace(z, '^ *[AaPp][Mm]([^A-Za-z/]|$)', '\1') AS z1, w[-1] AS m, w[1] AS wd FROM {s}_p),
{s}_z AS (SELECT *, regexp_extract(z1, '^ *([Zz])(?:[^A-Za-z/]|$)', 1) AS zl, regexp_extract(z1, '^ *[Zz]? *([A-Za-z]{{3,}}(?:[/_-][A-Za-z]+)*)', 1) AS zn, regexp_extract(z1, '([+-]\d\d(?::?\d\d(?::?\d\d)?)?)(?: *[\[(].*)?$', 1) AS off, regexp_extract(z1, '[\[(]([A-Za-z][A-Za-z/_+0-9-]*)[\])]$', 1) AS zb,
    CASE WHEN k IN ('ymd', 'compact') THEN {i("CASE k WHEN 'ymd' THEN n[1] ELSE left(d, 4) END")} ELSE {i("n[-1]")} END AS yy,
    CASE k WHEN 'ymd' THEN {i("n[2]")} WHEN 'compact' THEN {i("substr(d, 5, 2)")} WHEN 'num' THEN {i("n[1]")} ELSE CASE WHEN regexp_matches(lower(m), {names}) THEN {month} END END AS a,
    CASE k WHEN 'ymd' THEN {i("n[3]")} WHEN 'compact' THEN {i("substr(d, 7, 2)")} WHEN 'num' THEN {i("n[2]")} ELSE {i("n[1]")} END AS b FROM {s}_t),
{s}_v AS (SELECT *, CASE WHEN k <> 'num' THEN false WHEN first IS NOT NULL THEN first WHEN contains(d, '.') THEN true
    WHEN TRY_CAST(format('{{:04d}}-{{:02d}}-{{:02d}}', yy, b, a) AS DATE) IS NULL THEN false WHEN TRY_CAST(format('{{:04d}}-{{:02d}}-{{:02d}}', yy, a, b) AS DATE) IS NULL THEN true WHEN a = b THEN true END AS dm,
    CASE WHEN ap = '' THEN {i("h0")} WHEN {i("h0")} BETWEEN 1 AND 12 THEN {i("h0")} % 12 + CASE ap WHEN 'PM' THEN 12 ELSE 0 END ELSE 99 END AS h FROM {s}_z),
{s}_l AS (SELECT *, TRY_CAST(format('{{:04d}}-{{:02d}}-{{:02d}} {{:02d}}:{{:02d}}:{{:02d}}', yy, CASE WHEN dm THEN b ELSE a END, CASE WHEN dm THEN a ELSE b END, coalesce(h, 0), coalesce({i("mi0")}, 0), coalesce({i("s0")}, 0)) AS TIMESTAMP) AS local,
    coalesce(TRY_CAST(rpad(left(f0, 6), 6, '0') AS BIGINT), 0) AS f FROM {s}_v WHERE k <> 'epoch'),
{s}_u AS (SELECT *, CASE WHEN coalesce(h, 0) > 23 OR coalesce({i("s0")}, 0) > 59 OR (k IN ('dmy', 'mdy') AND len(w) > 1 AND NOT regexp_matches(lower(wd), '^(mon|tue|tues|wed|wednes|thu|thur|thurs|fri|sat|satur|sun)(day)?$')) THEN NULL
    WHEN off <> '' THEN CASE WHEN {i("substr(off, 2, 2)")} <= 18 AND {i("substr(replace(off, ':', '') || '0000', 4, 2)")} <= 59 THEN epoch_us(local) - (CASE left(off, 1) WHEN '-' THEN -1 ELSE 1 END) * ({i("substr(off, 2, 2)")} * 3600 + {i("substr(replace(off, ':', '') || '0000', 4, 2)")} * 60) * 1000000::BIGINT END
    WHEN zl <> '' THEN epoch_us(local)
    WHEN zb <> '' OR zn <> '' THEN CASE WHEN {abbr.format("CASE WHEN zb <> '' THEN zb ELSE zn END")} IS NOT NULL THEN epoch_us(local) - {abbr.format("CASE WHEN zb <> '' THEN zb ELSE zn END")} * 1000000::BIGINT
        WHEN (CASE WHEN zb <> '' THEN zb ELSE zn END) IN (SELECT name FROM pg_timezone_names()) THEN epoch_us({first("(CASE WHEN zb <> '' THEN zb ELSE zn END)", "local")}) END
    ELSE epoch_us({first("coalesce(zone, 'UTC')", "local")}) END + f AS us FROM {s}_l),
{s}_at AS (SELECT * EXCLUDE (t, zone, first, x, k, d, r, h0, mi0, s0, f0, z, n, w, ap, z1, m, wd, zl, zn, off, zb, yy, a, b, dm, h, local, f) FROM {s}_u
    UNION ALL BY NAME SELECT * EXCLUDE (t, zone, first, x, k), CASE WHEN k = 'epoch' THEN CAST(left(split_part(x, '.', 1) || rpad(left(split_part(x, '.', 2), 6), 6, '0'), 38) AS HUGEINT)
        // (CASE WHEN length(split_part(x, '.', 1)) <= 11 THEN 1 WHEN length(split_part(x, '.', 1)) <= 14 THEN 1000 WHEN length(split_part(x, '.', 1)) <= 17 THEN 1000000 ELSE 1000000000 END) END AS us FROM {s}_k WHERE k = 'epoch' OR k IS NULL)"""


WRITERS = "wr AS (SELECT writer, min(zone_id) AS zone, bool_and(day_first) AS first FROM ledger_writers WHERE writer IS NOT NULL GROUP BY 1)"
#: Claims with us, all records, after WRITERS; the same with WRITERS; counter-claims with us, after WRITERS.
CLAIMS_ONLY = f"""ci AS (SELECT claims.*, created_at AS t, zone, first FROM claims LEFT JOIN wr ON writer = split_part(generated_by_run, '/', 1)), {instants('ci')}"""
CLAIMS_AT = f"{WRITERS}, {CLAIMS_ONLY}"
COUNTERS_AT = f"""cj AS (SELECT counter_claims.*, created_at AS t, zone, first FROM counter_claims LEFT JOIN wr ON writer = provenance.generator), {instants('cj')}"""
