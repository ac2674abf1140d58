"""Personal data by patterns, checksums and nearby words, as DataFrame functions only.

A pattern proposes spans, leftmost and without overlap; a checksum or a rule on the digits confirms them; words next to a
span raise or lower its score. Spans of the four base kinds stay whatever their score, further kinds need SURE.

Positions are running sums over the pieces between the matches, in code points. The patterns are written so that a run
which cannot match is left in one step (possessive parts, a look behind), so very long runs cost linear time.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import carried

SURE = 0.5
NEAR = 32
CHUNK = 256


@dataclass(frozen=True)
class Kind:
    """trigger: a cheap necessary condition. start: score of a confirmed span, to which words within NEAR characters add or take."""

    name: str
    pattern: str
    trigger: str
    start: float
    words: str
    against: str = "order|invoice|version|serial|article"
    base: bool = True


#: Characters of an account code by country, for the countries that have registered one.
LENGTHS = {15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
           23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV",
           29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}
#: A code ends at its country's length if a word ends there; otherwise it is the longest run, as for other countries.
IBAN = "(?:" + "|".join(rf"(?:{c.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}(?![A-Za-z0-9-])" for n, c in LENGTHS.items()) + r"|[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+)"

#: The patterns and words, base kinds first, in the order of the output.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.9, "mail|contact|write|reply"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", 0.6, "ip|host|server|address|login"),
    Kind("card", r"[0-9]++(?:[\x20-][0-9]++)*+", "", 0.7, "card|visa|credit|debit|pay|iban"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", 0.6, "phone|tel|call|mobile|fax|contact"),
    Kind("iban", IBAN, "", 0.8, "iban|account|bank|konto|compte|cuenta", base=False),
    Kind("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "-", 0.3, "ssn|social|security|taxpayer", base=False),
)
ORDER = {k.name: i for i, k in enumerate(KINDS)}


def luhn(digits: Column) -> Column:
    """Check digit of a string of digits: every second one from the right counts twice, with its digits added."""
    d = F.split(F.reverse(digits), "")
    total = F.aggregate(F.transform(d, lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise((x.cast("int") * 2) % 10 + F.floor(x.cast("int") / 5).cast("int"))),
                        F.lit(0), lambda a, x: a + x)
    return total % 10 == 0


def mod97(code: Column) -> Column:
    """Remainder of an account code: the first four characters go last, letters count 10 to 35."""
    c = F.split(F.concat(F.substring(code, 5, 64), F.substring(code, 1, 4)), "")
    value = lambda x: F.when(x.rlike("[0-9]"), F.ascii(x) - 48).otherwise(F.ascii(x) - 55)
    return F.aggregate(c, F.lit(0), lambda a, x: (a * F.when(value(x) > 9, 100).otherwise(10) + value(x)) % 97)


def _confirmed(kind: str, m: Column, before: Column, after: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    n = F.length(digits)
    alone = ~before.rlike("[A-Za-z0-9-]$") & ~after.rlike("^[A-Za-z0-9-]")
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(m, "[.]"), lambda p: (F.length(part(p)) <= 3) & (F.when(part(p) == "", 0).otherwise(F.left(part(p), F.lit(3)).cast("int")) <= 255))
    if kind == "card":
        return F.when(n.between(12, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return n.between(9, 15)
    if kind == "iban":
        code = F.replace(m, F.lit(" "))
        return F.when(alone & F.length(code).between(15, 34), mod97(code) == 1).otherwise(False)
    if kind == "ssn":
        return alone & ~m.rlike("^(000|666|9)|-00-|-0000$")
    return F.lit(True)


def _running(lengths: Column) -> Column:
    """Sum of all earlier entries for each entry, in chunks, so that a text with very many spans stays near linear."""
    n = F.size(lengths)
    chunks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / CHUNK).cast("int")), lambda k: F.slice(lengths, k * CHUNK + 1, F.lit(CHUNK)))
    fold = lambda c, b: F.aggregate(c, F.struct(b.alias("at"), F.array().cast("array<int>").alias("out")),
                                    lambda a, x: F.struct((a["at"] + x).alias("at"), F.array_append(a["out"], a["at"]).alias("out")), lambda a: a["out"])
    bases = fold(F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + x)), F.lit(0))
    return F.when(n > 0, F.flatten(F.zip_with(chunks, bases, fold))).otherwise(F.array().cast("array<int>"))


SPAN = "array<struct<start:int,rank:int,end:int,kind:string,score:double,base:boolean>>"


def find(df: DataFrame, *, text_col: str = "text", out: str = "pii", keep: list[str] | None = None, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """Adds an array of spans (start, rank of the kind, end, kind, score, base), sorted by start and kind; ends are exclusive.

    A null text counts as empty and has no spans. keep: the columns to carry along (all, if not given); one named like
    `out` is replaced. No shuffle; an empty table stays empty.
    """
    names = carried(df.columns if keep is None else keep, [out])
    text = F.col("__text")
    src = df.select(*names, F.coalesce(df[text_col], F.lit("")).alias("__text"))
    seen = lambda k: text.contains(k.trigger) if k.trigger else text.rlike("[0-9]")
    none = F.array().cast("array<string>")
    src = src.select("*", *[F.when(seen(k), F.regexp_extract_all("__text", F.lit(k.pattern), 0)).otherwise(none).alias(f"__m_{k.name}") for k in kinds])
    src = src.select("*", *[F.when(F.size(f"__m_{k.name}") > 0, F.split("__text", k.pattern, -1)).otherwise(none).alias(f"__g_{k.name}") for k in kinds])
    at = [F.when(F.size(f"__m_{k.name}") > 0, _running(F.zip_with(F.slice(f"__g_{k.name}", 1, F.size(f"__m_{k.name}")), F.col(f"__m_{k.name}"), lambda g, m: F.length(g) + F.length(m))))
          .otherwise(F.array().cast("array<int>")).alias(f"__at_{k.name}") for k in kinds]
    src = src.select("*", *at)

    def spans(k: Kind) -> Column:
        m, g = F.col(f"__m_{k.name}"), F.col(f"__g_{k.name}")

        def one(start: Column, i: Column) -> Column:
            match, before, after = m[i], g[i], g[i + 1]
            near = F.lower(F.concat(F.right(before, F.lit(NEAR)), F.lit(" "), F.left(after, F.lit(NEAR))))
            score = F.lit(k.start) + F.when(near.rlike(rf"\b(?:{k.words})"), 0.3).otherwise(0.0) - F.when(near.rlike(rf"\b(?:{k.against})"), 0.2).otherwise(0.0)
            first = start + F.length(before)
            return F.struct(first.alias("start"), F.lit(ORDER[k.name]).alias("rank"), (first + F.length(match)).alias("end"), F.lit(k.name).alias("kind"),
                            F.least(F.lit(1.0), score).alias("score"), F.lit(k.base).alias("base"), _confirmed(k.name, match, before, after).alias("ok"))

        found = F.filter(F.transform(f"__at_{k.name}", one), lambda s: s["ok"] & (s["base"] | (s["score"] >= SURE)))
        drop = lambda s: F.struct(*[s[c].alias(c) for c in ("start", "rank", "end", "kind", "score", "base")])
        return F.when(F.size(m) > 0, F.transform(found, drop)).otherwise(F.array().cast(SPAN))

    return src.select(*names, F.sort_array(F.concat(*[spans(k) for k in kinds])).alias(out))


def joined(spans: Column) -> Column:
    """kind:start:end of the spans, joined by commas."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def merged(spans: Column) -> Column:
    """Spans without overlap: one that begins inside an earlier one joins it, under the earlier one's kind."""
    empty = F.array().cast("array<struct<start:int,end:int,kind:string>>")

    def step(a: Column, s: Column) -> Column:
        last = a["last"]
        inside = s["start"] < last["end"]
        grown = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), last["kind"].alias("kind"))
        fresh = F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))
        return F.struct(F.when(inside, a["out"]).otherwise(F.when(last["end"] > 0, F.array_append(a["out"], last)).otherwise(a["out"])).alias("out"),
                        F.when(inside, grown).otherwise(fresh).alias("last"))

    nothing = F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit("").alias("kind"))
    return F.aggregate(spans, F.struct(empty.alias("out"), nothing.alias("last")), step,
                       lambda a: F.when(a["last"]["end"] > 0, F.array_append(a["out"], a["last"])).otherwise(a["out"]))


PAGE = 4096


def redacted(df: DataFrame, *, text_col: str = "text", spans_col: str = "pii") -> DataFrame:
    """The text with every found span replaced by its kind in brackets, such as [EMAIL]; overlapping spans are replaced as one.

    The text is cut into pages once, so a piece between spans costs its own length wherever it lies. A null text stays null.
    """
    text, spans = F.col(text_col), merged(F.col(spans_col))
    pages = F.when(F.size(spans_col) > 0, F.regexp_extract_all(text_col, F.lit(f"(?s).{{1,{PAGE}}}"), 0))
    src = df.select("*", pages.alias("__pages"), F.when(F.size(spans_col) > 0, spans).alias("__spans"))

    def piece(a: Column, b: Column) -> Column:
        part = lambda c: F.substring(F.col("__pages")[c], F.greatest(a - c * PAGE, F.lit(0)) + 1, F.least(b, (c + 1) * PAGE) - F.greatest(a, c * PAGE))
        return F.when(b > a, F.array_join(F.transform(F.sequence(F.floor(a / PAGE).cast("int"), F.floor((b - 1) / PAGE).cast("int")), part), "")).otherwise("")

    s, n = F.col("__spans"), F.size("__spans")
    body = F.transform(s, lambda x, i: F.concat(piece(F.when(i > 0, F.get(s, i - 1)["end"]).otherwise(0), x["start"]), F.lit("["), F.upper(x["kind"]), F.lit("]")))
    tail = piece(F.element_at(s, -1)["end"], F.length(text))
    out = F.when(F.col("__spans").isNull(), text).otherwise(F.concat(F.array_join(body, ""), tail))
    return src.withColumn(text_col, out).drop("__pages", "__spans")
