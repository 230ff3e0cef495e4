"""SQL that reads date strings, written apart from the column code it checks: one moment per string, day-first."""

from __future__ import annotations

_FROM = "İIıĞğÜüŞşÖöÇç０１２３４５６７８９"
_TO = "iiigguussoocc0123456789"
_MONTHS = "oca|sub|mar|nis|may|haz|tem|agu|eyl|eki|kas|ara|jan|feb|apr|jun|jul|aug|sep|oct|nov|dec"
_NUMBER = "CASE {m} WHEN 'oca' THEN 1 WHEN 'jan' THEN 1 WHEN 'sub' THEN 2 WHEN 'feb' THEN 2 WHEN 'mar' THEN 3 WHEN 'nis' THEN 4 WHEN 'apr' THEN 4 WHEN 'may' THEN 5 WHEN 'haz' THEN 6 WHEN 'jun' THEN 6 WHEN 'tem' THEN 7 WHEN 'jul' THEN 7 WHEN 'agu' THEN 8 WHEN 'aug' THEN 8 WHEN 'eyl' THEN 9 WHEN 'sep' THEN 9 WHEN 'eki' THEN 10 WHEN 'oct' THEN 10 WHEN 'kas' THEN 11 WHEN 'nov' THEN 11 WHEN 'ara' THEN 12 WHEN 'dec' THEN 12 END"
_ROMAN = "list_position(['i','ii','iii','iv','v','vi','vii','viii','ix','x','xi','xii'], {m})"
_PATTERNS = {
    "ymd": r"(?:^|[^0-9])([0-9]{4})[-/.]([0-9]{1,2})[-/.]([0-9]{1,2})([^0-9].*)?$",
    "dmy": r"(?:^|[^0-9])([0-9]{1,2})[-/.]([0-9]{1,2})[-/.]([0-9]{4}|[0-9]{2})([^0-9].*)?$",
    "dmn": rf"(?:^|[^0-9])([0-9]{{1,2}})[-/. ]*({_MONTHS})[a-z]*[-/., ]+([0-9]{{4}})([^0-9].*)?$",
    "mdn": rf"(?:^|[^a-z0-9])({_MONTHS})[a-z]*[-/. ]+([0-9]{{1,2}})(?:st|nd|rd|th)?[, ]+([0-9]{{4}})([^0-9].*)?$",
    "rom": r"(?:^|[^0-9])([0-9]{1,2})[-/. ]+(viii|vii|iii|xii|iv|vi|ix|xi|ii|x|v|i)[-/. ]+([0-9]{4})([^0-9].*)?$",
    "run14": r"(?:^|[^0-9])([0-9]{8})([0-9]{2})([0-9]{2})([0-9]{2})(?:[^0-9].*)?$",
    "count": r"^[^0-9-]*([0-9]{9,10}|[0-9]{12,13})[^0-9]*$",
    "run8": r"(?:^|[^0-9.,:])([0-9]{8})(?:t([0-9]{2})([0-9]{2})([0-9]{2}))?([^0-9].*)?$",
}
_CLOCK = r"^(?:t|[^0-9]*?[^0-9.,+-])?([0-9]{1,2})[:.]([0-9]{2})(?:[:.]([0-9]{2})(?:[.,]([0-9]+))?)?([^0-9].*)?$"
_OFF = r"^ *(?:gmt|utc)? *([+-])([0-9]{2}):?([0-9]{2})"
_ABBR = {"z": 0, "gmt": 0, "utc": 0, "eet": 120, "eest": 180, "trt": 180, "cet": 60, "cest": 120, "msk": 180}


def _offset(instant: str) -> str:
    """Minutes by which the zone is before UTC at an instant."""
    return f"date_diff('minute', {instant}, timezone(zn, timezone('UTC', {instant})))"


def moments(name: str, source: str, raw: str, keep: str) -> str:
    """CTEs that end in ``name``: the columns ``keep`` of ``source`` utc, the moment that ``raw`` names (null for none), and fmt, the writing it was read in."""
    n = name
    x = lambda p, i, c="s": f"regexp_extract({c}, '{p}', {i})"
    kind = "CASE WHEN NOT regexp_matches(s, '[0-9]') THEN NULL " + " ".join(f"WHEN regexp_matches(s, '{p}') THEN '{k}'" for k, p in _PATTERNS.items()) + " END"
    part = lambda i: "CASE kd " + " ".join(f"WHEN '{k}' THEN {x(_PATTERNS[k], i)}" for k in ("ymd", "dmy", "dmn", "mdn", "rom", "run14", "run8", "count") if i == 1 or k != "count") + " END"
    rest = f"CASE WHEN kd = 'run14' THEN concat_ws(':', g2, g3, {x(_PATTERNS['run14'], 4)}) WHEN kd = 'run8' THEN CASE WHEN g2 <> '' THEN concat_ws(':', g2, g3, {x(_PATTERNS['run8'], 4)}) ELSE '' END || {x(_PATTERNS['run8'], 5)} WHEN kd <> 'count' THEN {part(4)} END"
    num = lambda c: f"try_cast(nullif({c}, '') AS INT)"
    date = lambda y, m, d: f"CASE WHEN {y} BETWEEN 1 AND 9999 AND {m} BETWEEN 1 AND 12 AND {d} BETWEEN 1 AND 31 THEN try_strptime(printf('%04d-%02d-%02d', {y}, {m}, {d}), '%Y-%m-%d') END"
    three = "g3"
    civil = (
        f"CASE kd WHEN 'ymd' THEN {date(num('g1'), num('g2'), num('g3'))} WHEN 'dmy' THEN {date(f'({num(three)} + CASE WHEN length(g3) = 2 THEN 2000 ELSE 0 END)', num('g2'), num('g1'))} "
        f"WHEN 'dmn' THEN {date(num('g3'), '(' + _NUMBER.format(m='g2') + ')', num('g1'))} WHEN 'mdn' THEN {date(num('g3'), '(' + _NUMBER.format(m='g1') + ')', num('g2'))} WHEN 'rom' THEN {date(num('g3'), '(' + _ROMAN.format(m='g2') + ')', num('g1'))} "
        "WHEN 'run14' THEN coalesce(try_strptime(g1, '%Y%m%d'), try_strptime(g1, '%d%m%Y')) WHEN 'run8' THEN coalesce(try_strptime(g1, '%Y%m%d'), try_strptime(g1, '%d%m%Y')) END"
    )
    hour = "CASE WHEN regexp_matches(tl, '^ *(os|pm)([^a-z]|$)') THEN CASE WHEN h = 12 THEN 12 WHEN h < 12 THEN h + 12 END WHEN regexp_matches(tl, '^ *(oo|am)([^a-z]|$)') THEN CASE WHEN h = 12 THEN 0 WHEN h < 12 THEN h END ELSE h END"
    abbr = r"^ *[(]?(" + "|".join(sorted(_ABBR, key=len, reverse=True)) + r")([^a-z].*)?$"
    shift = f"CASE WHEN regexp_matches(tl, '{_OFF}') THEN CASE {x(_OFF, 1, 'tl')} WHEN '-' THEN -1 ELSE 1 END * ({num(x(_OFF, 2, 'tl'))} * 60 + {num(x(_OFF, 3, 'tl'))}) ELSE CASE {x(abbr, 1, 'tl')} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in _ABBR.items()) + " END END"
    zone = r"regexp_extract(tl, '^ *[\[(]*([a-z]+/[a-z_]+)', 1)"
    proper = f"array_to_string(list_transform(string_split({zone}, '/'), lambda p: array_to_string(list_transform(string_split(p, '_'), lambda w: upper(w[1]) || w[2:]), '_')), '/')"
    return (
        f"{n}_a AS (SELECT {keep}, trim(regexp_replace(lower(translate({raw}, '{_FROM}', '{_TO}')), '[\\s\\x{{1c}}-\\x{{1f}}\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}\\x{{feff}}]', ' ', 'g')) s FROM {source}), "
        f"{n}_b AS (SELECT *, {kind} kd FROM {n}_a), {n}_c AS (SELECT *, {part(1)} g1, {part(2)} g2, {part(3)} g3 FROM {n}_b), {n}_d AS (SELECT *, {rest} rs FROM {n}_c), "
        f"{n}_e AS (SELECT *, coalesce(regexp_matches(rs, '{_CLOCK}'), false) tm, CASE WHEN regexp_matches(rs, '{_CLOCK}') THEN {x(_CLOCK, 5, 'rs')} ELSE '' END tl, {num(x(_CLOCK, 1, 'rs'))} h, {num(x(_CLOCK, 2, 'rs'))} mi, coalesce({num(x(_CLOCK, 3, 'rs'))}, 0) se, {x(_CLOCK, 4, 'rs')} fr, {civil} dy FROM {n}_d), "
        f"{n}_f AS (SELECT *, {hour} hh, CASE WHEN tm THEN {shift} END sh, CASE WHEN tm AND {zone} <> '' THEN {proper} ELSE 'Europe/Istanbul' END zn FROM {n}_e), "
        f"{n}_g AS (SELECT *, CASE WHEN NOT tm THEN dy WHEN hh < 24 AND mi < 60 AND se < 60 THEN dy + to_hours(hh) + to_minutes(mi) + to_seconds(se) + to_microseconds(CASE WHEN coalesce(fr, '') <> '' THEN rpad(substr(fr, 1, 6), 6, '0')::BIGINT ELSE 0 END) END lc FROM {n}_f), "
        # the offset in force before a change holds in a gap and for a repeated reading
        f"{n}_h AS (SELECT *, {_offset('(lc - INTERVAL 12 HOUR)')} o1 FROM {n}_g), {n}_i AS (SELECT *, {_offset('(lc - to_minutes(o1))')} o2 FROM {n}_h), {n}_j AS (SELECT *, {_offset('(lc - to_minutes(o2))')} o3 FROM {n}_i), "
        f"{n} AS (SELECT {keep}, CASE WHEN kd = 'count' THEN CASE WHEN length(g1) <= 10 THEN make_timestamp(g1::BIGINT * 1000000) ELSE make_timestamp(g1::BIGINT * 1000) END WHEN sh IS NOT NULL THEN lc - to_minutes(sh) WHEN o1 = o2 OR o3 <> o2 THEN lc - to_minutes(o1) ELSE lc - to_minutes(o2) END utc, CASE WHEN kd = 'count' THEN CASE WHEN length(g1) <= 10 THEN 'epoch_s' ELSE 'epoch_ms' END WHEN kd IN ('run14', 'run8') THEN CASE WHEN try_strptime(g1, '%Y%m%d') IS NOT NULL THEN 'run_ymd' ELSE 'run_dmy' END ELSE kd END fmt FROM {n}_j)"
    )


def day(utc: str) -> str:
    """The day in Istanbul of a moment."""
    return f"timezone('Europe/Istanbul', timezone('UTC', {utc}))::DATE"
