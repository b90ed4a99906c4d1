"""Column functions: identifiers, dates, geography, radio and demographic classifiers.

Every function takes columns (or names) and returns a ``Column``; dirty input gives null, never an error.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
KM_PER_DEGREE = 111.32


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_null(c) -> Column:
    t = F.trim(col(c))
    return F.when(t != "", t)


def text_or_empty(c) -> Column:
    """Trimmed text; null and spelled nulls are empty."""
    t = F.trim(col(c).cast("string"))
    return F.when(t.isNull() | F.lower(t).isin("<na>", "nan", "none"), "").otherwise(t)


def digits(c) -> Column:
    return F.regexp_replace(col(c).cast("string"), r"\D", "")


def _of_length(c: Column, low: int, high: int) -> Column:
    return F.when(F.length(c).between(low, high), c)


def msisdn(c) -> Column:
    """Digits with country code: ten get a 7 in front, eleven that begin with 8 get a 7 instead; 7 to 15 stay."""
    d = digits(c)
    d = F.when(F.length(d) == 10, F.concat(F.lit("7"), d)).otherwise(d)
    d = F.when((F.length(d) == 11) & d.startswith("8"), F.concat(F.lit("7"), F.substring(d, 2, 10))).otherwise(d)
    return _of_length(d, 7, 15)


def imsi(c, low: int = 14) -> Column:
    return _of_length(digits(c), low, 15)


def imei(c, low: int = 14) -> Column:
    return _of_length(digits(c), low, 16)


def digits_to_long(c, low: int) -> Column:
    """At least ``low`` digits as a number; more than a long can hold give null."""
    d = digits(c)
    return F.when(F.length(d) >= low, d).try_cast("long")


def number_to_digits(c) -> Column:
    """A number as digits, by way of long: doubles would lose the tail of long identifiers."""
    return col(c).try_cast("long").cast("string")


def operator_of_imsi(c, home_mcc: str = "250") -> Column:
    d = digits(c)
    return F.when(F.substring(d, 1, 3) == home_mcc, F.substring(d, 4, 2)).try_cast("long")


def tac_of_imei(c) -> Column:
    d = digits(c)
    return F.when(F.length(d) >= 8, F.substring(d, 1, 8))


def last_digits(c, n: int) -> Column:
    """Right-most n digits, zero-padded; lpad alone would cut a longer value from the wrong end."""
    d = digits(c)
    return F.when(d != "", F.right(F.concat(F.lit("0" * n), d), F.lit(n)))


_CYRILLIC, _LATIN = "АВЕКМНОРСТУХ", "ABEKMHOPCTYX"


def latin_code(c) -> Column:
    """Upper-case code with Cyrillic look-alikes made Latin."""
    return F.translate(F.upper(F.trim(col(c))), _CYRILLIC, _LATIN)


def fourteen_digits(c) -> Column:
    return F.trim(col(c).cast("string")).rlike(r"^\d{14}$")


def event_time(c) -> Column:
    t = F.trim(col(c).cast("string"))
    return F.try_to_timestamp(F.when(t.rlike(r"^\d{14}$"), t), F.lit("yyyyMMddHHmmss")).cast("timestamp_ntz")


def flexible_date(c) -> Column:
    """dd.MM.yyyy, or another day-first form, as yyyy-MM-dd."""
    t = F.trim(col(c))
    forms = ("dd.MM.yyyy", "d.M.yyyy", "dd/MM/yyyy", "d/M/yyyy", "yyyy-MM-dd", "dd-MM-yyyy")
    return F.date_format(F.coalesce(*[F.try_to_timestamp(t, F.lit(f)) for f in forms]), "yyyy-MM-dd")


def floor_to(ts, seconds: int = 300) -> Column:
    """Start of the bucket of ``seconds`` that a timestamp without zone falls into."""
    return F.window(col(ts), f"{seconds} seconds")["start"]


def bucket_no(ts, seconds: int = 300) -> Column:
    """Number of the bucket, for grouping without a window struct."""
    return F.floor(F.unix_micros(col(ts).cast("timestamp")) / F.lit(seconds * 1_000_000)).cast("long")


def bucket_end(ts, seconds: int = 300) -> Column:
    return floor_to(ts, seconds) + F.make_dt_interval(secs=F.lit(seconds))


def local_to_utc(ts, hours) -> Column:
    return col(ts) - F.make_dt_interval(hours=F.coalesce(col(hours).cast("int"), F.lit(0)))


def iso_offset_minutes(c) -> Column:
    """Minutes east of UTC that an ISO time text ends with; none or Z is 0."""
    sign = F.regexp_extract(col(c), r"([+\-])(\d{2}):?(\d{2})$", 1)
    h, m = (F.regexp_extract(col(c), r"([+\-])(\d{2}):?(\d{2})$", k).try_cast("int") for k in (2, 3))
    return F.when(sign == "", 0).otherwise(F.when(sign == "-", -1).otherwise(1) * (h * 60 + m))


def age_at(birth, at, year: float = 365.2425) -> Column:
    """Whole years as text; U if unknown, negative or above 120."""
    years = F.floor(F.datediff(col(at), col(birth)) / F.lit(year))
    return F.when(years.between(0, 120), years.cast("string")).otherwise("U")


def cgi(mcc, mnc, lac, cell) -> Column:
    """One key of a cell's four parts, null as 0; unique while mnc < 100, lac < 100 000, cell < 1 000 000."""
    z = [F.coalesce(col(c).try_cast("long"), F.lit(0)) for c in (mcc, mnc, lac, cell)]
    return z[0] * 10**13 + z[1] * 10**11 + z[2] * 10**6 + z[3]


def haversine(lat1, lon1, lat2, lon2) -> Column:
    a1, o1, a2, o2 = (F.radians(col(c)) for c in (lat1, lon1, lat2, lon2))
    a = F.pow(F.sin((a2 - a1) / 2), 2) + F.cos(a1) * F.cos(a2) * F.pow(F.sin((o2 - o1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.least(F.lit(1.0), F.sqrt(F.greatest(F.lit(0.0), a))))


def wrap_longitude(c) -> Column:
    c = col(c)
    return F.when(c > 180, c - 360).when(c < -180, c + 360).otherwise(c)


def azimuth(c) -> Column:
    return F.coalesce(F.bround(F.pmod(col(c), F.lit(360.0)), 5), F.lit(0.0))


def sector_angle(c) -> Column:
    a = F.abs(col(c))
    return F.when(a.isNull() | (a < 1), 120.0).otherwise(F.least(a, F.lit(359.0)))


def sector_radius_km(bs_type) -> Column:
    t = col(bs_type)
    return F.when(t == "m", 0.2).when(t == "i", 0.1).when(t == "f", 0.05).otherwise(5.0)


def generation(c) -> Column:
    s = F.upper(F.trim(col(c)))
    return F.when(s.isin("2G", "3G", "4G"), s).otherwise("4G")


def site_type(kind, location, description) -> Column:
    """m metro, i indoor, x both, f small cell, o outdoor: the first keyword in that order decides."""
    t = F.lower(F.concat_ws(" ", *[F.coalesce(col(c).cast("string"), F.lit("")) for c in (kind, location, description)]))

    def has(*keys):
        out = F.lit(False)
        for k in keys:
            out = out | t.contains(k)
        return out

    return F.when(has("metro", "underground"), "m").when(has("indoor", "ind "), "i").when(has("out/ind", "indoor-outdoor"), "x").when(has("femto", "pico"), "f").otherwise("o")


def clamp(c, low: float, high: float) -> Column:
    c = col(c)
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def _lookup(c: Column, table: dict[str, float], other: float) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(c == k, v) if out is None else out.when(c == k, v)
    return out.otherwise(other)


POWER = dict(zip("mifxo", (22.0, 6.0, 1.5, 16.0, 42.0), strict=True))
HEIGHT = dict(zip("mifxo", (18.0, 7.0, 4.5, 20.0, 35.0), strict=True))
RADIATION = dict(zip("abcds", (1.08, 1.0, 0.94, 0.86, 0.92), strict=True))


def first_letter(c) -> Column:
    return F.substring(F.lower(F.trim(col(c))), 1, 1)


def valid_power(power, bs_type) -> Column:
    p = col(power).try_cast("double")
    return F.least(F.when(p >= 0, p).otherwise(_lookup(first_letter(bs_type), POWER, 35.0)), F.lit(150.0))


def valid_height(height, bs_type) -> Column:
    return clamp(F.coalesce(col(height).try_cast("double"), _lookup(first_letter(bs_type), HEIGHT, 30.0)), -50.0, 240.0)


def radiation_factor(c) -> Column:
    return F.coalesce(_lookup(first_letter(c), RADIATION, 1.0), F.lit(1.0))


def median_tilt(*tilts) -> Column:
    """Median of the absolute tilts up to 120 degrees; 8 without any."""
    a = F.array_sort(F.filter(F.array(*[F.abs(col(t).try_cast("double")) for t in tilts]), lambda x: x.isNotNull() & (x <= 120)))
    n = F.size(a)
    low, high = F.floor((n - 1) / 2).cast("int"), F.floor(n / 2).cast("int")
    return F.when(n == 0, 8.0).otherwise((F.get(a, low) + F.get(a, high)) / 2)


def reach_m(radius_km, power_w, height_m, tilt, bs_type, factor) -> Column:
    """How far a cell serves, from its radius and validated radio fields, within caps by kind of site."""
    base = F.greatest(F.lit(120.0), F.greatest(F.lit(0.01), F.coalesce(col(radius_km), F.lit(5.0))) * 850.0)
    power = F.least(F.lit(1.48), F.greatest(F.lit(0.72), 1 + 0.18 * F.log1p(F.greatest(F.lit(0.0), col(power_w)) / 15)))
    height = 1 + F.least(F.lit(0.32), F.greatest(F.lit(0.0), col(height_m)) / 120) * 0.11
    down = F.greatest(F.lit(0.68), 1 - F.least(F.lit(0.22), clamp(tilt, 0.0, 35.0) / 28 * 0.16))
    r = base * power * height * down * clamp(factor, 0.75, 1.2)
    small = F.coalesce(first_letter(bs_type).isin("m", "i", "f"), F.lit(False))
    return F.when(small, F.greatest(F.lit(80.0), F.least(r, F.lit(900.0)))).otherwise(F.greatest(F.lit(120.0), F.least(r, F.lit(42_000.0))))


GEOHASH = "0123456789bcdefghjkmnpqrstuvwxyz"


def grid_key(lat, lon, size: float = 0.01) -> Column:
    """Integer key of the grid cell that a point falls into."""
    return F.concat_ws(":", F.floor(col(lat) / size).cast("long"), F.floor(col(lon) / size).cast("long"))


def geohash(lat, lon, length: int = 9) -> Column:
    """Standard geohash text, by interleaving the bits of both coordinates."""
    bits = length * 5
    nlon, nlat = (bits + 1) // 2, bits // 2
    x = F.least(F.floor((col(lon) + 180) / 360 * F.lit(float(1 << nlon))).cast("long"), F.lit((1 << nlon) - 1))
    y = F.least(F.floor((col(lat) + 90) / 180 * F.lit(float(1 << nlat))).cast("long"), F.lit((1 << nlat) - 1))
    out = []
    for k in range(length):
        value = F.lit(0).cast("long")
        for b in range(5):
            i = k * 5 + b
            bit = F.shiftright(x, nlon - 1 - i // 2) if i % 2 == 0 else F.shiftright(y, nlat - 1 - i // 2)
            value = value + bit.bitwiseAND(F.lit(1).cast("long")) * (1 << (4 - b))
        out.append(F.substring(F.lit(GEOHASH), value.cast("int") + 1, F.lit(1)))
    return F.when(col(lat).isNotNull() & col(lon).isNotNull(), F.concat(*out))


def person_id(key) -> Column:
    k = F.coalesce(col(key), F.lit(""))
    return F.when(k == "", "prs_unknown").otherwise(F.concat(F.lit("prs_"), F.substring(F.sha2(k, 256), 1, 24)))


def stable_seed(c) -> Column:
    """32-bit number from a text's SHA-256."""
    return F.conv(F.substring(F.sha2(col(c).cast("string"), 256), 1, 8), 16, 10).cast("long")


def bio_key(last, first, second, birth, document) -> Column:
    """``bio:last|first|second|birth|document digits`` in lower case; null without last name, first name or birth."""
    f, n, s = (F.lower(text_or_empty(c)) for c in (last, first, second))
    b = F.date_format(col(birth), "yyyy-MM-dd")
    return F.when((f != "") & (n != "") & b.isNotNull(), F.concat(F.lit("bio:"), F.concat_ws("|", f, n, s, b, F.coalesce(digits(document), F.lit("")))))


def _ends(c: Column, *tails: str) -> Column:
    out = F.lit(False)
    for t in tails:
        out = out | c.endswith(t)
    return out


def gender(first, second) -> Column:
    """From the endings of patronymic and first name."""
    n, p = F.lower(text_or_empty(first)), F.lower(text_or_empty(second))
    return F.when(_ends(p, "кызы", "вна", "ична"), "F").when(_ends(p, "вич", "оглы"), "M").when(_ends(n, "а", "я"), "F").when(n != "", "M").otherwise("U")


def confidence(keys) -> Column:
    """high if any key is biographic, medium if any is an iccid, else low."""
    k = col(keys)
    return F.when(F.exists(k, lambda x: x.startswith("bio:")), "high").when(F.exists(k, lambda x: x.startswith("iccid:")), "medium").otherwise("low")


#: Text tokens and the country that each stands for: issuing office, document, names. Order decides.
OFFICE = (("мвд", "RU"), ("овд", "RU"), ("умвд", "RU"), ("russia", "RU"), ("kaz", "KZ"), ("uzb", "UZ"), ("tajik", "TJ"), ("kyrgyz", "KG"), ("belarus", "BY"), ("armenia", "AM"), ("azerbaijan", "AZ"), ("ukrain", "UA"), ("china", "CN"), ("german", "DE"), ("american", "US"))
PAPER = (("паспорт рф", "RU"), ("российск", "RU"), ("казахстан", "KZ"), ("узбекистан", "UZ"), ("таджикистан", "TJ"), ("кыргыз", "KG"), ("беларус", "BY"), ("армен", "AM"), ("азербайджан", "AZ"), ("украин", "UA"), ("кнр", "CN"), ("chinese", "CN"), ("german passport", "DE"), ("american passport", "US"))
NAMES = (("kaz", "KZ"), ("uzb", "UZ"), ("ukr", "UA"), ("tj", "TJ"), ("kg", "KG"), ("blr", "BY"), ("arm", "AM"), ("aze", "AZ"))


def _tokens(c: Column, table, codes: dict[str, str]) -> Column:
    # the first token that occurs decides, even for a country that the dimension lacks
    out = F.when(c == "", None)
    for token, country in table:
        out = out.when(c.contains(token), F.lit(codes.get(country)))
    return out


def citizenship(office, paper, first, second, last, codes: dict[str, str], country_names: list[tuple[str, str]] = ()) -> Column:
    """Numeric country code by a cascade: office, document, name hints, country names, Russian patronymic; U if none.

    ``codes``: alpha-2 to numeric. ``country_names``: (token, numeric), tried longest token first.
    """
    o, p = F.lower(text_or_empty(office)), F.lower(text_or_empty(paper))
    n = F.trim(F.concat_ws(" ", *[F.lower(text_or_empty(c)) for c in (last, first, second)]))
    n = F.regexp_replace(n, r"^\s+$", "")
    whole = F.concat_ws(" ", *[F.when(c != "", c) for c in (o, p, n)])
    named = F.lit(None).cast("string")
    for token, code in sorted(country_names, key=lambda x: (len(x[0]), x[0])):
        named = F.when(whole.contains(token.lower()), F.lit(code)).otherwise(named)
    home = F.lit(codes.get("RU", "643"))
    patronymic = n.contains("вич") | n.contains("вна") | n.contains("оглы") | n.contains("кызы")
    default = F.when(patronymic & (o.contains("мвд") | p.contains("паспорт рф") | ((o == "") & (p == ""))), home)
    return F.coalesce(_tokens(o, OFFICE, codes), _tokens(p, PAPER, codes), _tokens(whole, NAMES, codes), named, default, F.lit("U"))


M2M_EQUIPMENT = frozenset(("IoT Device", "M2M Module", "Modem", "Module", "Vehicle Unit", "WLAN Router"))


def is_m2m(equipment, kinds=tuple(sorted(M2M_EQUIPMENT))) -> Column:
    return F.coalesce(col(equipment), F.lit("")).isin(*kinds)


def boolean_text(c) -> Column:
    t = F.lower(F.trim(col(c).cast("string")))
    return F.when(t.isin(*"1 t true y yes".split()), "true").when(t.isin(*"0 f false n no".split()), "false").when(t.isNull() | (t == ""), None).otherwise("<other>")


def number_label(c) -> Column:
    """A number as text, integers without a point."""
    c = col(c)
    return F.when(c == F.floor(c), c.cast("long").cast("string")).otherwise(c.cast("string"))


def count_bucket(c) -> Column:
    c = col(c)
    return F.when((c > 0) & (c <= 1), "1").when((c > 1) & (c <= 5), "2-5").when((c > 5) & (c <= 20), "6-20").when(c > 20, ">20")


def number_list(c) -> Column:
    """Whether a text is a comma list of numbers."""
    return F.trim(col(c)).rlike(r"^\d+(\.\d+)?(\s*,\s*\d+(\.\d+)?)*$")


def service_entries(c) -> Column:
    """Entries of a list joined by U+0011."""
    return F.filter(F.split(col(c), "\\x11"), lambda x: F.trim(x) != "")
