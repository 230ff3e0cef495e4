"""Mixed timestamp formats and time zones, resolved by a mixture of formats.

Every string is read under all formats that can produce a real calendar moment from it. Each
reading is a component of a mixture; per source, expectation-maximisation learns how often each
format is used and in which years the source's dates lie. A value's posterior over its readings
chooses one, or marks the value as ambiguous. All parsing is built-in column arithmetic; the
driver sees only the counts of distinct (source, signature) pairs, of which there are at most a
few hundred per source, whatever the number of rows.

Defined results: null, blank and wordless strings give no reading (``utc`` null, ``n_readings``
0); a day that does not exist or an impossible clock time gives none; repeated rows are kept;
extra columns pass through untouched unless they clash with the names in ``RESERVED``, which are
overwritten.
"""

from __future__ import annotations

import json
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from derlem.functions.keys import BLANKS

RESERVED = ("readings", "utc_micros", "utc", "reading", "posterior", "ambiguous", "n_readings")

#: Month names by their first three letters after Turkish-safe folding (Turkish, English).
MONTHS = {
    "oca": 1, "sub": 2, "mar": 3, "nis": 4, "may": 5, "haz": 6, "tem": 7, "agu": 8, "eyl": 9, "eki": 10, "kas": 11, "ara": 12,
    "jan": 1, "feb": 2, "apr": 4, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12,
}
#: Roman month numbers.
ROMAN = {"i": 1, "ii": 2, "iii": 3, "iv": 4, "v": 5, "vi": 6, "vii": 7, "viii": 8, "ix": 9, "x": 10, "xi": 11, "xii": 12}
#: Zone abbreviations and their offset in minutes.
ABBREVIATIONS = {"z": 0, "gmt": 0, "utc": 0, "eet": 120, "eest": 180, "trt": 180, "cet": 60, "cest": 120, "msk": 180}

DAY = 86_400_000_000
_NAMES = "|".join(MONTHS)


def _fold(c: Column) -> Column:
    """Lower case with Turkish letters as plain ones, odd blanks as spaces and full-width digits as ASCII."""
    c = F.translate(c, "İIıĞğÜüŞşÖöÇç０１２３４５６７８９" + BLANKS, "iiigguussoocc0123456789" + " " * len(BLANKS))
    return F.trim(F.lower(c))


def _int(c: Column) -> Column:
    return F.when(c != "", c).cast("int")


def _lookup(table: dict, key: Column, kind: str = "int") -> Column:
    """The value of a key; the table is one folded literal, not an expression per entry."""
    return F.try_element_at(F.from_json(F.lit(json.dumps(table)), f"map<string,{kind}>"), key)


def _day_micros(y: Column, m: Column, d: Column) -> Column:
    """Microseconds of a civil day's start as if in UTC; null where the day does not exist."""
    ok = y.between(1, 9999) & m.between(1, 12) & (d >= 1)
    first = F.when(ok, F.make_date(y, m, F.lit(1)))
    return F.when(ok & (d <= F.dayofmonth(F.last_day(first))), (F.unix_date(first) + d - 1).cast("long") * DAY)


def _fix(df: DataFrame, **cols: Column) -> DataFrame:
    """Add columns behind a generator, so that the optimizer neither inlines them into later
    expressions nor pushes a later filter's copy of them down: each is computed once a row."""
    keep = [c for c in df.columns if c not in cols]
    return df.select(*[F.col(f"`{c}`") for c in keep], F.inline(F.array(F.struct(*[v.alias(k) for k, v in cols.items()]))))


def _zones(spark: SparkSession) -> dict[str, str]:
    """Region zones known to the JVM, by their folded names."""
    jvm = spark.sparkContext._jvm.java
    ids = jvm.lang.String.join(",", jvm.time.ZoneId.getAvailableZoneIds())
    return {z.lower(): z for z in sorted(ids.split(",")) if "/" in z and not z.startswith(("Etc/", "SystemV/"))}


def add_readings(df: DataFrame, column: str, zone: str = "Europe/Istanbul", numeric_order: str | None = "day_first", century: int = 2000) -> DataFrame:
    """Add ``readings``: array of (format, micros) with every valid interpretation of ``column``.

    ``numeric_order``: ``day_first`` or ``month_first`` where a convention is known, ``None`` to
    leave the order of numeric dates to the mixture.
    """
    spark = df.sparkSession
    s = F.col("_s")
    df = _fix(df, _s=_fold(F.col(column)))
    take = lambda pat, i, c=s: F.regexp_extract(c, pat, i)

    ymd = r"(?<!\d)(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})(?!\d)(.*)$"
    dmy = r"(?<!\d)(\d{1,2})[-/.](\d{1,2})[-/.](\d{4}|\d{2})(?!\d)(.*)$"
    rom = r"(?<!\d)(\d{1,2})[-/. ]+(x?i{1,3}|x?iv|x?vi{0,3}|ix|x)[-/. ]+(\d{4})(?!\d)(.*)$"
    dmn = rf"(?<!\d)(\d{{1,2}})[-/. ]*({_NAMES})[a-z]*[-/., ]+(\d{{4}})(?!\d)(.*)$"
    mdn = rf"\b({_NAMES})[a-z]*[-/. ]+(\d{{1,2}})(?:st|nd|rd|th)?[, ]+(\d{{4}})(?!\d)(.*)$"
    run = r"(?<![\d.,:])(\d{8})(?:t(\d{2})(\d{2})(\d{2}))?(?!\d)(.*)$"
    run14 = r"(?<!\d)(\d{8})(\d{2})(\d{2})(\d{2})(?!\d)(.*)$"
    count = r"^[^\d-]*(\d{9,10}|\d{12,13})\D*$"

    kind = (
        F.when(s.rlike(ymd), "ymd").when(s.rlike(dmy), "dmy").when(s.rlike(dmn), "dmn").when(s.rlike(mdn), "mdn").when(s.rlike(rom), "rom")
        .when(s.rlike(run14), "run14").when(s.rlike(count), "count").when(s.rlike(run), "run")
    )
    df = _fix(df, _k=F.when(s.rlike(r"\d"), kind))
    k = F.col("_k")
    part = lambda i, **by: F.coalesce(*[F.when(k == n, take(p, i)) for n, p in by.items()])
    pats = {"ymd": ymd, "dmy": dmy, "rom": rom, "dmn": dmn, "mdn": mdn, "run": run, "run14": run14}
    parts = F.when(k.isin(*pats), F.array(*[part(i, **pats) for i in (1, 2, 3)]))
    rest = (F.when(k == "run", F.concat(F.when(take(run, 2) != "", F.concat_ws(":", take(run, 2), take(run, 3), take(run, 4))).otherwise(""), take(run, 5))).when(k == "run14", F.concat(F.concat_ws(":", take(run14, 2), take(run14, 3), take(run14, 4)), take(run14, 5))).when(k.isin(*pats), part(4, **{n: p for n, p in pats.items() if n not in ("run", "run14")})))
    df = _fix(df, _p=parts, _rest=rest)

    rest = F.col("_rest")
    clock = r"^(?:t|[^\d]*?[^\d.,+-])?(\d{1,2})[:.](\d{2})(?:[:.](\d{2})(?:[.,](\d{1,}))?)?(?![\d])"
    has = rest.rlike(clock)
    df = _fix(df, _has=has)
    hour, minute, sec, frac = (take(clock, i, rest) for i in (1, 2, 3, 4))
    tail = F.regexp_replace(rest, clock, "")
    df = _fix(df, _tail=F.when(F.col("_has"), tail).otherwise(F.lit("")))
    tail = F.col("_tail")
    noon = F.regexp_extract(tail, r"^ *(oo|os|am|pm)\b", 1)
    h = _int(hour)
    h = F.when(noon.isin("os", "pm"), F.when(h == 12, 12).when(h < 12, h + 12)).when(noon.isin("oo", "am"), F.when(h == 12, 0).when(h < 12, h)).otherwise(h)
    mi, se = _int(minute), F.coalesce(_int(sec), F.lit(0))
    us = F.rpad(F.substring(frac, 1, 6), 6, "0").cast("long")
    time = F.when(~F.col("_has"), F.lit(0).cast("long")).when(
        (h < 24) & (mi < 60) & (se < 60), (h.cast("long") * 3600 + mi * 60 + se) * 1_000_000 + F.when(frac != "", us).otherwise(0)
    )

    off = r"^ *(?:gmt|utc)? *([+-])(\d{2}):?(\d{2})(?!\d)"
    abbr = F.regexp_extract(tail, r"^ *\(?(" + "|".join(ABBREVIATIONS) + r")\b", 1)
    offset = F.when(tail.rlike(off), F.when(F.regexp_extract(tail, off, 1) == "-", -1).otherwise(1) * (_int(F.regexp_extract(tail, off, 2)) * 60 + _int(F.regexp_extract(tail, off, 3)))).when(abbr != "", _lookup(ABBREVIATIONS, abbr))
    region = F.regexp_extract(tail, r"^ *\[?\(?([a-z]+/[a-z_]+(?:/[a-z_]+)?)", 1)
    region = F.when(region != "", _lookup(_zones(spark), region, "string"))
    df = _fix(df, _t=time, _off=F.when(F.col("_has"), offset), _zone=F.coalesce(F.when(F.col("_has"), region), F.lit(zone)))

    p = F.col("_p")
    a, b, c = (F.get(p, F.lit(i)) for i in (0, 1, 2))
    year = F.when(F.length(c) == 2, _int(c) + century).otherwise(_int(c))
    e8 = lambda i, n: F.substring(a, i, n).cast("int")
    readings: list[tuple[str, Column]] = [("ymd", F.when(k == "ymd", _day_micros(_int(a), _int(b), _int(c))))]
    if numeric_order != "month_first":
        readings.append(("dmy", F.when(k == "dmy", _day_micros(year, _int(b), _int(a)))))
    if numeric_order != "day_first":
        readings.append(("mdy", F.when(k == "dmy", _day_micros(year, _int(a), _int(b)))))
    readings += [
        ("dmn", F.when(k == "dmn", _day_micros(_int(c), _lookup(MONTHS, b), _int(a)))),
        ("mdn", F.when(k == "mdn", _day_micros(_int(c), _lookup(MONTHS, a), _int(b)))),
        ("rom", F.when(k == "rom", _day_micros(_int(c), _lookup(ROMAN, b), _int(a)))),
        ("run_ymd", F.when(k.isin("run", "run14"), _day_micros(e8(1, 4), e8(5, 2), e8(7, 2)))),
        ("run_dmy", F.when(k.isin("run", "run14"), _day_micros(e8(5, 4), e8(3, 2), e8(1, 2)))),
    ]
    local = lambda day: F.when(F.col("_off").isNotNull(), day + F.col("_t") - F.col("_off").cast("long") * 60_000_000).otherwise(F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(day + F.col("_t")), F.col("_zone"))))
    n = F.when(k == "count", F.regexp_extract(s, count, 1))
    made = [(f, local(d)) for f, d in readings]
    made += [("epoch_s", F.when(F.length(n) <= 10, n.cast("long") * 1_000_000)), ("epoch_ms", F.when(F.length(n) >= 12, n.cast("long") * 1_000))]
    arr = F.array(*[F.struct(F.lit(f).alias("format"), m.alias("micros")) for f, m in made])
    df = _fix(df, readings=F.filter(arr, lambda x: x["micros"].isNotNull()))
    return df.drop("_s", "_k", "_p", "_rest", "_has", "_tail", "_t", "_off", "_zone")


def _era(micros: Column) -> Column:
    """Five-year bins from 1900 to 2100; everything else is bin -1."""
    y = F.year(F.date_from_unix_date(F.floor(micros / DAY).cast("int")))
    return F.when(y.between(1900, 2099), F.floor((y - 1900) / 5)).otherwise(-1).cast("int")


def fit_mixture(df: DataFrame, source: str, rounds: int = 30, smooth: float = 0.5) -> dict[str, dict[tuple, float]]:
    """Expectation-maximisation on counts of (source, signature).

    ``df`` has ``readings``. Returns per source the weights ``("f", format)`` and ``("e", era)``.
    The collected table has one row per source and set of (format, era): bounded by formats times
    eras, not by rows.
    """
    sig = F.transform("readings", lambda r: F.struct(r["format"].alias("f"), _era(r["micros"]).alias("e")))
    rows = df.groupBy(F.col(source).alias("src"), sig.alias("sig")).count().collect()
    return em([(r["src"], [(x["f"], x["e"]) for x in r["sig"]], r["count"]) for r in rows if r["sig"]], rounds, smooth)


def em(rows: list[tuple], rounds: int = 30, smooth: float = 0.5) -> dict[str, dict[tuple, float]]:
    """The iteration itself, on (source, [(format, era)], count)."""
    formats = sorted({f for _, s, _ in rows for f, _ in s})
    eras = sorted({e for _, s, _ in rows for _, e in s})
    out: dict = {}
    by: dict = defaultdict(list)
    for src, s, n in rows:
        by[src].append((s, n))
    for src, own in by.items():
        w = {("f", f): 1 / len(formats) for f in formats} | {("e", e): 1 / len(eras) for e in eras}
        for _ in range(rounds):
            got: dict = defaultdict(float)
            for s, n in own:
                p = [w["f", f] * w["e", e] for f, e in s]
                z = sum(p) or 1.0
                for (f, e), x in zip(s, p):
                    got["f", f] += n * x / z
                    got["e", e] += n * x / z
            total = sum(n for _, n in own)
            w = {k: (got[k] + smooth) / (total + smooth * (len(formats) if k[0] == "f" else len(eras))) for k in w}
        out[src] = w
    return out


def normalise_timestamps(df: DataFrame, column: str, source: str, *, zone: str = "Europe/Istanbul", numeric_order: str | None = "day_first", certain: float = 0.9) -> DataFrame:
    """Add ``utc_micros``, ``utc`` (text), ``reading`` (format), ``posterior``, ``ambiguous`` and ``n_readings``.

    The most probable reading is chosen; ``ambiguous`` is true where its posterior is below
    ``certain``. Readings that name the same moment support each other. Ties go to the earlier
    format in alphabetical order.
    """
    read = add_readings(df, column, zone, numeric_order)
    weights = fit_mixture(read, source)
    flat = {f"{src}\x1f{k[0]}{k[1]}": w for src, ws in weights.items() for k, w in ws.items()}
    if flat:
        src = F.coalesce(F.col(source).cast("string"), F.lit("None"))
        look = lambda kind, v: F.coalesce(_lookup(flat, F.concat(src, F.lit("\x1f" + kind), v), "double"), F.lit(1e-9))
        scored = F.transform("readings", lambda r: F.struct((look("f", r["format"]) * look("e", _era(r["micros"]).cast("string"))).alias("w"), r["micros"].alias("m"), r["format"].alias("f")))
    else:
        scored = F.transform("readings", lambda r: F.struct(F.lit(1.0).alias("w"), r["micros"].alias("m"), r["format"].alias("f")))
    # a single reading needs no weights
    single = F.transform("readings", lambda r: F.struct(F.lit(1.0).alias("w"), r["micros"].alias("m"), r["format"].alias("f")))
    read = _fix(read, _sc=F.when(F.size("readings") == 1, single).otherwise(scored))
    best = F.array_max("_sc")
    total = F.aggregate("_sc", F.lit(0.0), lambda acc, x: acc + x["w"])
    same = F.aggregate("_sc", F.lit(0.0), lambda acc, x: acc + F.when(x["m"] == best["m"], x["w"]).otherwise(0.0))
    return (
        _fix(read, utc_micros=best["m"], reading=best["f"], posterior=F.try_divide(same, total), n_readings=F.size("readings"))
        .withColumns({"utc": format_utc(F.col("utc_micros")), "ambiguous": F.col("posterior") < certain})
        .drop("_sc", "readings")
    )


def format_utc(micros: Column) -> Column:
    """``YYYY-MM-DDTHH:MM:SS.ffffffZ``, whatever the session's zone."""
    rest = F.pmod(micros, F.lit(DAY))
    day = ((micros - rest) / DAY).cast("int")
    pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
    sec = F.floor(rest / 1_000_000).cast("long")
    return F.concat(
        F.date_format(F.date_from_unix_date(day), "yyyy-MM-dd"), F.lit("T"), pad(F.floor(sec / 3600), 2), F.lit(":"), pad(F.floor(sec % 3600 / 60), 2),
        F.lit(":"), pad(sec % 60, 2), F.lit("."), pad(rest % 1_000_000, 6), F.lit("Z"),
    )
