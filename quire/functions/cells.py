"""Cell values: typing of text, display text, comparison classes and sort keys, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, types as T
from pyspark.sql import functions as F

# Leading currency symbols and their ISO codes; ambiguous ones have none.
CURRENCIES = {"£": "GBP", "€": "EUR", "₹": "INR", "₩": "KRW", "₽": "RUB", "$": None, "¥": None}
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
MONTH_NAMES = "january february march april may june july august september october november december".split()
_SPACES = "[\\u00A0\\u202F]"


class ClassMismatch(ValueError):
    """Two values of different comparison classes were compared."""


def comparison_class(kind: T.DataType) -> str:
    """numeric, boolean or text; dates and times compare as ISO text."""
    if isinstance(kind, T.NumericType):
        return "numeric"
    return "boolean" if isinstance(kind, T.BooleanType) else "text"


def comparable(column: Column, kind: T.DataType) -> Column:
    """A column as the value that it compares by: numbers and booleans as they are, all else as text."""
    if comparison_class(kind) != "text" or isinstance(kind, T.StringType):
        return column
    if isinstance(kind, T.DateType):
        return F.date_format(column, "yyyy-MM-dd")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss")
    return column.cast("string")


def sort_key(column: Column, kind: T.DataType) -> Column:
    """Text in the order of its UTF-16 code units, all else as it compares."""
    value = comparable(column, kind)
    return F.encode(value, "UTF-16BE") if comparison_class(kind) == "text" else value


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value evaluated once a row, however often use names it."""
    return F.transform(F.array(value), use)[0]


def normalized(text: Column) -> Column:
    """Text without surrounding spaces, no-break spaces counting as spaces."""
    return F.trim(F.regexp_replace(text, _SPACES, " "))


def _plain_number(text: Column) -> Column:
    """The number that a text spells, null where a spelling is declined.

    Declined are leading zeros, a lone comma group (1,234 may be a decimal), exponents, minus
    zero, and digits that a double does not give back.
    """
    spelled = text.rlike(r"^[+-]?(?:(?:0|[1-9][0-9]*)|(?![+-]?[0-9]{1,3},[0-9]{3}$)[1-9][0-9]{0,2}(?:,[0-9]{3})+)(?:\.[0-9]+)?$")
    significant = F.char_length(F.regexp_replace(text, r"^[+-]?0?\.?0*|\.0*$|[^0-9]", ""))
    bare = F.regexp_replace(text, r"[,+]|\.0+$|(?<=\.[0-9]{1,400})0+$", "")
    given = lambda v: ((significant <= 15) | (number_text(v) == bare)) & ~((v == 0) & text.startswith("-"))
    return F.when(spelled, once(F.replace(text, F.lit(","), F.lit("")).try_cast("double"), lambda v: F.when(given(v), v)))


def _iso_date(text: Column) -> Column:
    """The ISO date that a text spells: ISO, day month-name year, or month-name day, year."""
    names = "|".join(f"{m[:3]}(?:{m[3:]})?" for m in MONTH_NAMES)
    day_first, month_first = rf"(?i)^([0-9]{{1,2}})[\s-]({names})\.?[\s-]([0-9]{{4}})$", rf"(?i)^({names})\.?[\s-]([0-9]{{1,2}}),?[\s-]([0-9]{{4}})$"
    month = lambda name: F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.left(name, F.lit(3))))
    build = lambda y, m, d: F.concat_ws("-", y, F.lpad(m.cast("string"), 2, "0"), F.lpad(d, 2, "0"))
    part = lambda pattern, n: F.regexp_extract(text, pattern, n)
    spelled = (
        F.when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), text)
        .when(text.rlike(day_first), build(part(day_first, 3), month(part(day_first, 2)), part(day_first, 1)))
        .when(text.rlike(month_first), build(part(month_first, 3), month(part(month_first, 1)), part(month_first, 2)))
    )
    return once(spelled, lambda d: F.when(F.try_to_timestamp(d, F.lit("yyyy-MM-dd")).isNotNull(), d))


def infer_cell(text: Column) -> Column:
    """The typed cell of a text: struct(kind, num, bool, text, currency).

    Tried in order: boolean (true, false), date, currency, percentage (as a fraction), number;
    all else is a string, and null or empty text an empty cell. Yes, no, on and off stay text,
    and so do numeric dates with slashes or dots.
    """
    money = r"^(-?)([£€₹₩₽$¥])\s?([-+]?[0-9].*)$"
    table = F.create_map(*(F.lit(x) for pair in CURRENCIES.items() for x in pair))

    def spelled(t: Column) -> Column:
        """struct(date, symbol, percent, digits): what the kinds are judged by; digits is what may spell a number."""
        symbol = F.regexp_extract(t, money, 2)
        digits = F.when(symbol != "", F.regexp_extract(t, money, 3)).when(t.endswith("%"), F.rtrim(F.regexp_replace(t, "%$", ""))).otherwise(t)
        sign = F.when((symbol != "") & t.startswith("-"), -1).otherwise(1)
        return F.struct(t.alias("t"), _iso_date(t).alias("date"), symbol.alias("symbol"), (sign * once(digits, _plain_number)).alias("number"))

    def typed(raw: Column, s: Column) -> Column:
        lower = F.lower(s["t"])
        kind = (
            F.when(F.coalesce(raw, F.lit("")) == "", "empty").when(lower.isin("true", "false"), "boolean").when(s["date"].isNotNull(), "date")
            .when(s["number"].isNull(), "string").when(s["symbol"] != "", "currency").when(s["t"].endswith("%"), "percentage").otherwise("number")
        )
        return once(kind, lambda k: F.struct(
            k.alias("kind"),
            F.when(k == "percentage", s["number"] / 100).when(k.isin("currency", "number"), s["number"]).alias("num"),
            F.when(k == "boolean", lower == "true").alias("bool"),
            F.when(k == "date", s["date"]).when(k == "string", raw).alias("text"),
            F.when(k == "currency", table[s["symbol"]]).alias("currency"),
        ))

    return once(text, lambda raw: once(once(normalized(raw), spelled), lambda s: typed(raw, s)))


def number_text(value: Column) -> Column:
    """A double as its shortest decimal text: no trailing .0, exponents only below 1e-6 and from 1e21 on."""
    text = value.cast("double").cast("string")
    mantissa, power = F.regexp_extract(text, r"^-?([0-9.]+)E", 1), F.regexp_extract(text, r"E(-?[0-9]+)$", 1).try_cast("int")
    sign = F.when(text.startswith("-"), "-").otherwise("")
    digits = F.regexp_replace(F.regexp_replace(mantissa, r"\.0$", ""), r"\.", "")
    size = F.char_length(digits)
    wide = F.when(size <= power + 1, F.rpad(digits, power + 1, "0")).otherwise(F.concat(F.left(digits, power + 1), F.lit("."), F.substr(digits, power + 2)))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    far = F.concat(F.regexp_replace(mantissa, r"\.0$", ""), F.lit("e"), F.when(power > 0, "+").otherwise(""), power.cast("string"))
    exponent = F.concat(sign, F.when((power >= 0) & (power < 21), wide).when((power < 0) & (power >= -7) & (F.abs(value) >= 1e-6), small).otherwise(far))
    plain = F.regexp_replace(text, r"\.0$", "")
    return F.when(value == 0, "0").when(text.contains("E"), exponent).otherwise(plain)


def display(cell: Column) -> Column:
    """What a typed cell shows: numbers short, percentages times 100 with %, TRUE or FALSE, nothing for empty."""
    return (
        F.when(cell["kind"] == "boolean", F.upper(cell["bool"].cast("string")))
        .when(cell["kind"] == "percentage", F.concat(number_text(F.round(cell["num"] * 100, 10)), F.lit("%")))
        .when(cell["kind"].isin("number", "currency"), number_text(cell["num"]))
        .otherwise(F.coalesce(cell["text"], F.lit("")))
    )
