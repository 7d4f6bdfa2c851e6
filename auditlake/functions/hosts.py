"""ASCII form of international host names: Bootstring coding (RFC 3492) as folds over code points, in the JVM.

Letters are lower-cased and full stops of other scripts become dots; names are expected in composed form, as nothing in
Spark's functions normalises Unicode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditlake.functions.binding import bind

# Fixed values of the coding.
BASE, T_MIN, T_MAX, SKEW, DAMP, INITIAL_BIAS, FIRST = 36, 1, 26, 38, 700, 72, 128
DIGITS = "abcdefghijklmnopqrstuvwxyz0123456789"
#: A number has at most so many digits: seven hold more than labels of any length in use need.
MOST_DIGITS = 12
#: Halvings of the bias at most.
MOST_STEPS = 10
STOPS = "[。．｡]"


def _long(value) -> Column:
    return F.lit(value).cast("long")


def _digit(value: Column) -> Column:
    return F.substring(F.lit(DIGITS), (value + 1).cast("int"), F.lit(1))


def _number(delta: Column, bias: Column) -> Column:
    """``delta`` in digits whose weights depend on the bias."""

    def step(acc: Column, i: Column) -> Column:
        t = F.greatest(_long(T_MIN), F.least(_long(T_MAX), i.cast("long") * BASE - acc["bias"]))

        def put(limit: Column) -> Column:
            left, span = acc["left"] - limit, _long(BASE) - limit
            goes_on = acc["left"] >= limit
            digit = F.when(goes_on, limit + left % span).otherwise(acc["left"])
            return F.struct(
                F.when(goes_on, F.floor(left / span)).otherwise(_long(-1)).alias("left"),
                F.concat(acc["text"], _digit(digit)).alias("text"),
                acc["bias"].alias("bias"),
            )

        return F.when(acc["left"] < 0, acc).otherwise(bind(t, put))

    start = F.struct(delta.alias("left"), F.lit("").alias("text"), bias.alias("bias"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(MOST_DIGITS)), start, step, lambda acc: acc["text"])


def _next_bias(delta: Column, points: Column, first: Column) -> Column:
    """Bias for the next number, from the one just written and how many code points are placed."""
    damped = F.floor(delta / F.when(first, _long(DAMP)).otherwise(_long(2)))

    def halved(d: Column) -> Column:
        start = F.struct((d + F.floor(d / points)).alias("d"), _long(0).alias("k"))
        span = BASE - T_MIN

        def step(acc: Column, _: Column) -> Column:
            return F.when(
                acc["d"] > (span * T_MAX) // 2, F.struct(F.floor(acc["d"] / span).alias("d"), (acc["k"] + BASE).alias("k"))
            ).otherwise(acc)

        return F.aggregate(
            F.sequence(F.lit(1), F.lit(MOST_STEPS)), start, step, lambda a: a["k"] + F.floor((_long(span + 1) * a["d"]) / (a["d"] + SKEW))
        )

    return bind(damped, halved)


def _label(label: Column) -> Column:
    """One label in its ASCII form: the plain characters, then where each other one goes, in the order of their codes."""
    chars = F.filter(F.split(label, ""), lambda c: c != "")

    def code(points: Column) -> Column:
        plain = F.filter(points, lambda p: p < FIRST)
        # Places in the order they are filled: by code, then by position.
        places = F.array_sort(
            F.filter(F.transform(points, lambda p, i: F.struct(p.alias("p"), i.cast("long").alias("i"))), lambda s: s["p"] >= FIRST)
        )
        basic = F.array_join(F.transform(plain, F.char), "")

        def put(acc: Column, place: Column) -> Column:
            # Code points passed since the last insertion: whole rounds for each code in between, and those before this place.
            done = acc["done"]
            lower = lambda upto, bound: F.size(F.filter(F.slice(points, 1, upto.cast("int")), lambda p: p < bound)).cast("long")
            equal = lambda upto: F.size(F.filter(F.slice(points, 1, upto.cast("int")), lambda p: p == place["p"])).cast("long")
            same = acc["p"] == place["p"]
            before = lower(place["i"], place["p"]) + equal(place["i"])
            passed = F.when(same, before - acc["at"] - 1).otherwise(
                # The rest of the last round, the rounds of codes that don't occur, and the start of this one.
                done - acc["at"] - 1 + (place["p"] - acc["p"] - 1) * (done + 1) + before + 1
            )

            def write(delta: Column) -> Column:
                return F.struct(
                    F.concat(acc["text"], _number(delta, acc["bias"])).alias("text"),
                    _next_bias(delta, done + 1, acc["first"]).alias("bias"),
                    (done + 1).alias("done"),
                    place["p"].alias("p"),
                    before.alias("at"),
                    F.lit(False).alias("first"),
                )

            return bind(passed, write)

        n_plain = F.size(plain).cast("long")
        start = F.struct(
            F.concat(F.lit("xn--"), basic, F.when(F.size(plain) > 0, "-").otherwise("")).alias("text"), _long(INITIAL_BIAS).alias("bias"),
            n_plain.alias("done"), _long(FIRST - 1).alias("p"), n_plain.alias("at"), F.lit(True).alias("first"),
        )
        return F.aggregate(places, start, put, lambda acc: acc["text"])

    points = F.transform(chars, _code_point)
    return F.when(label.rlike(r"^[\x00-\x7f]*$"), label).otherwise(bind(points, code))


def _code_point(char: Column) -> Column:
    """Code point of a character of one or two UTF-16 units, from the last four of its UTF-32 bytes."""
    return F.conv(F.right(F.hex(F.encode(char, "utf-32")), F.lit(8)), 16, 10).cast("long")


def ascii_host(host: Column) -> Column:
    """Lower-cased host with every international label in its ASCII form; plain hosts take the short way."""

    def coded(h: Column) -> Column:
        return F.array_join(F.transform(F.split(F.regexp_replace(h, STOPS, "."), r"\.", -1), lambda label: bind(label, _label)), ".")

    return bind(F.lower(host), lambda h: F.when(h.rlike(r"^[\x00-\x7f]*$"), h).otherwise(coded(h)))


def ascii_url(url: Column) -> Column:
    """URL with its host in ASCII form, anything else as it is; text that is no absolute http(s) URL stays.

    Apply it to a column of URLs before they are normalised or compared. It isn't part of :func:`auditlake.functions.urls.normalize_url`:
    inside the parse of a page's links the folds made the whole parse two to three times slower."""
    parts = r"(?is)^([\x00-\x20]*https?:[/\\]{2}(?:[^/?#\\]*@)?)([^/?#\\@:]*)(.*)$"
    host = F.regexp_extract(url, parts, 2)
    whole = F.concat(F.regexp_extract(url, parts, 1), ascii_host(host), F.regexp_extract(url, parts, 3))
    return F.when(host.rlike(r"[^\x00-\x7f]"), whole).otherwise(url)
