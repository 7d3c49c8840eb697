"""Personal data in texts, with built-in expressions only.

Regular expressions propose spans, checksums (Luhn, mod 97) and value ranges confirm them,
and words nearby move the score. The positions of matches come from the texts between them:
``split`` and ``regexp_extract_all`` walk the same leftmost, non-overlapping matches, so the
running sum of both lengths is where each match starts, in code points.

Null and empty texts have no spans. Rows are independent: repeated rows, ties and other
columns do not matter; the columns that are not asked for are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from poolsift.llm.common import whole

#: Fixed patterns. They start only where a run of their first characters starts (or where
#: the match before ended), and never give characters back: the same matches as the plain
#: form, in time linear in the text.
LOCAL = "A-Za-z0-9._%+-"
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
EMAIL = rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?:(?<![0-9])|\G)[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Only the country and check digits, so that what stands behind a number is never part of the match.
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=(?:\x20?[A-Z0-9]){11})"
IBAN_RUN = r"^[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])"
NATIONAL_ID = r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])"
LOCAL_PHONE = r"(?<![0-9+(.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9-])"

#: Characters of an account number by country (ISO 13616 registry). Other lengths and countries count too, but come second.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU",
}

#: Kinds the contract counts, in its order, and those this method adds.
BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "national_id", "local_phone")

#: Code points looked at on either side of a span.
NEAR = 40
#: Least score of an added span; spans of the base kinds stay whatever their score.
LEAST_SCORE = 0.6
#: Score without context.
PRIOR = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "national_id": 0.4, "local_phone": 0.4}
#: Words nearby that speak for a kind, and those that speak against any.
FOR_WORDS = {
    "email": "mail|contact|write to|correo|kontakt",
    "ip": "ip|host|server|login|address|adresse",
    "card": "card|visa|mastercard|credit|payment|karte|carte|tarjeta",
    "phone": "phone|tel|call|mobile|fax|telefon|teléfono",
    "iban": "iban|account|bank|konto|compte|cuenta",
    "national_id": "ssn|social security|national id|insurance number",
    "local_phone": "phone|tel|call|mobile|fax|telefon|teléfono",
}
AGAINST_WORDS = "version|release|isbn|order no|invoice|serial|sample"
STEP = 0.3

def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def mod97(value: Column) -> Column:
    """Remainder of an account number by ISO 7064: first four characters last, letters as 10 to 35."""
    plain = F.regexp_replace(value, r"\x20", "")
    turned = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))
    return F.aggregate(
        F.split(turned, ""),
        F.lit(0),
        lambda total, c: F.when(c == "", total)
        .when(c.between("0", "9"), (total * 10 + F.ascii(c) - 48) % 97)
        .otherwise((total * 100 + F.ascii(c) - 55) % 97),
    )


#: What a proposed value must fulfil, by kind.
CONFIRM = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: v.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"),
    "card": lambda v: F.length(_digits(v)).between(13, 19) & F.call_function("luhn_check", _digits(v)),
    "phone": lambda v: F.length(_digits(v)).between(9, 15),
    "iban": lambda v: F.length(F.regexp_replace(v, r"\x20", "")).between(15, 34) & (mod97(v) == 1),
    "national_id": lambda v: F.lit(True),
    "local_phone": lambda v: F.lit(True),
}
PATTERNS = {
    "email": EMAIL,
    "ip": IP,
    "card": CARD,
    "phone": PHONE,
    "iban": IBAN,
    "national_id": NATIONAL_ID,
    "local_phone": LOCAL_PHONE,
}
#: What a text must hold before a pattern is tried on it.
HINT = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9][\x20-]?[0-9]"),
    "phone": lambda t: t.contains("+"),
    "iban": lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}"),
    "national_id": lambda t: t.rlike(r"[0-9]-[0-9]{2}-[0-9]"),
    "local_phone": lambda t: t.rlike(r"[0-9][\x20.-][0-9]{4}"),
}

SPAN = "struct<kind:string,start:bigint,end:bigint,value:string,score:double>"


def _located(text: Column, kind: str, found: Column) -> Column:
    """Spans of the matches ``found``: a running sum over the gaps and the matches."""
    gaps = F.slice(F.split(text, PATTERNS[kind], -1), F.lit(1), F.size(found))
    empty = F.expr(f"named_struct('at', bigint(0), 'spans', cast(array() as array<{SPAN}>))")

    def step(acc: Column, pair: Column) -> Column:
        start = acc["at"] + F.length(pair["gap"])
        end = start + F.length(pair["value"])
        span = F.struct(
            F.lit(kind).alias("kind"),
            start.alias("start"),
            end.alias("end"),
            pair["value"].alias("value"),
            F.lit(PRIOR[kind]).alias("score"),
        )
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    pairs = F.zip_with(gaps, found, lambda g, v: F.struct(g.alias("gap"), v.alias("value")))
    return F.aggregate(pairs, empty, step, lambda acc: acc["spans"])


def _account_numbers(text: Column, spans: Column) -> Column:
    """``spans`` of country and check digits, led on to the end of the number.

    The capitals and digits that follow, with or without blanks, may hold words that do not belong
    to the number. So every end of a group is tried: first the length of the country, then the
    longest whose checksum holds. A span inside an earlier number goes.
    """

    lengths = F.create_map(*[F.lit(x) for size, names in IBAN_LENGTHS.items() for name in names.split() for x in (name, size)])

    def led_on(span: Column) -> Column:
        run = F.regexp_extract(F.substring(text, (span["start"] + 1).cast("int"), 68), IBAN_RUN, 0)
        groups = F.split(run, r"\x20")
        ends = F.sequence(F.size(groups), F.lit(1), F.lit(-1))
        values = F.filter(F.transform(ends, lambda n: F.array_join(F.slice(groups, F.lit(1), n), " ")), CONFIRM["iban"])
        usual = F.filter(values, lambda v: F.length(F.regexp_replace(v, r"\x20", "")) == lengths[F.substring(v, 1, 2)])
        value = F.coalesce(F.get(usual, F.lit(0)), F.get(values, F.lit(0)))
        return span.withField("value", value).withField("end", span["start"] + F.length(value))

    found = F.filter(F.transform(spans, led_on), lambda s: s["value"].isNotNull())
    return F.filter(found, lambda s: ~F.exists(found, lambda b: (b["start"] < s["start"]) & (s["start"] < b["end"])))


def _confirmed(text: Column, kind: str, spans: Column) -> Column:
    if kind == "iban":
        return _account_numbers(text, spans)
    return F.filter(spans, lambda s: CONFIRM[kind](s["value"]))


def _scored(text: Column, kind: str, spans: Column) -> Column:
    """Scores after a look at the words on both sides."""

    def score(span: Column) -> Column:
        first = F.greatest(span["start"] - NEAR, F.lit(0))
        near = F.lower(
            F.concat_ws(
                " ",
                F.substring(text, (first + 1).cast("int"), (span["start"] - first).cast("int")),
                F.substring(text, (span["end"] + 1).cast("int"), NEAR),
            )
        )
        moved = (
            span["score"]
            + F.when(near.rlike(rf"(?<!\p{{L}})(?:{FOR_WORDS[kind]})"), STEP).otherwise(0.0)
            - F.when(near.rlike(rf"(?<!\p{{L}})(?:{AGAINST_WORDS})"), STEP).otherwise(0.0)
        )
        return span.withField("score", F.round(F.least(F.greatest(moved, F.lit(0.0)), F.lit(1.0)), 3))

    return F.transform(spans, score)


def find_personal_data(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, the text (null: empty) and ``spans``: kind, start, end (exclusive), value, score.

    Positions count code points. Spans are ordered by kind as in :data:`BASE`, then
    :data:`ADDED`, then by start. Spans of different kinds may overlap; an added span that
    overlaps a base span is left out.
    """
    kinds = (*BASE, *ADDED)
    none = F.expr("cast(array() as array<string>)")
    out = docs.select(*keep, whole(F.col(text)).alias("_text"))
    body = F.col("_text")
    out = out.withColumns(
        {
            f"_{kind}": F.when(HINT[kind](body), F.regexp_extract_all(body, F.lit(PATTERNS[kind]), F.lit(0))).otherwise(none)
            for kind in kinds
        }
    )
    no_span = F.expr(f"cast(array() as array<{SPAN}>)")
    out = out.withColumns(
        {
            f"_{kind}": F.when(
                F.size(f"_{kind}") > 0,
                _scored(
                    body,
                    kind,
                    _confirmed(body, kind, _located(body, kind, F.col(f"_{kind}"))),
                ),
            ).otherwise(no_span)
            for kind in kinds
        }
    )
    out = out.withColumn("_base", F.concat(*[F.col(f"_{kind}") for kind in BASE]))

    def clear(span: Column) -> Column:
        hit = F.exists("_base", lambda b: (b["start"] < span["end"]) & (span["start"] < b["end"]))
        return (span["score"] >= LEAST_SCORE) & ~hit

    added = F.concat(*[F.col(f"_{kind}") for kind in ADDED])
    spans = F.concat(F.col("_base"), F.when(F.size(added) > 0, F.filter(added, clear)).otherwise(no_span))
    return out.select(*keep, body.alias(text), spans.alias("spans"))


def _listed(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def personal_data_report(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, a digest of their spans, and all spans as text, per row."""
    found = find_personal_data(docs)
    spans = F.col("spans")

    def counted(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    base = F.filter(spans, lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *[counted(kind) for kind in BASE], F.sha2(_listed(base), 256).alias("base_sha256"), _listed(spans).alias("spans"))


def mask_personal_data(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; overlapping spans become one.

    The other columns stay as they are, and so do texts without spans (a null stays null).
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    found = find_personal_data(docs.select(row, F.col(f"`{text}`").alias("_whole")), "_whole", ("_row",))
    body = F.col("_whole")
    ordered = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"], s["end"], s["kind"])))
    empty = F.expr("named_struct('at', bigint(0), 'text', cast('' as string))")

    def step(acc: Column, span: Column) -> Column:
        gap = F.substring(body, (acc["at"] + 1).cast("int"), (span["start"] - acc["at"]).cast("int"))
        new = F.struct(
            span["end"].alias("at"),
            F.concat(acc["text"], gap, F.lit("["), F.upper(span["kind"]), F.lit("]")).alias("text"),
        )
        grown = F.struct(F.greatest(acc["at"], span["end"]).alias("at"), acc["text"].alias("text"))
        return F.when(span["start"] >= acc["at"], new).otherwise(grown)

    masked = F.aggregate(
        ordered, empty, step, lambda acc: F.concat(acc["text"], F.substring(body, (acc["at"] + 1).cast("int"), 2147483647))
    )
    clean = F.when(F.size("spans") > 0, masked).otherwise(F.col("_row")[text])
    return found.select(*[(clean if c == text else F.col("_row")[c]).alias(c) for c in docs.columns])
