"""Personal data: patterns propose spans, checksums confirm them, words nearby move the score.

All of it is built-in SQL functions. Positions come from the gaps: the text is split at the same pattern that extracts
the matches, so the start of a match is the sum of what stands before it. Positions are code points, the end exclusive.

Patterns are written so that each run of characters is entered once (a look-behind for the start of a run, possessive
repeats), which gives the leftmost non-overlapping matches in time linear in the text, also for very long runs.

A null text counts as empty: no spans. Repeated rows are judged each; other columns pass through, and an input column
that has an output's name is replaced. Spans of different kinds may overlap; those of one kind do not."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.llm.common import packed, unpacked

LOCAL = r"A-Za-z0-9._%+-"


@dataclass(frozen=True)
class Kind:
    """`needs`: pattern without which no match can be there. `confirm`: SQL condition on a match `m`. `weight`: score
    of a confirmed match; `words`: context that raises it by `CONTEXT_GAIN`. Kept when the score reaches `KEEP`.
    `length`: SQL expression for the length of the span in `m`, which then is the pattern's first group: all that may belong
    to a span that begins here, looked at ahead. The match itself is the first `HEAD` characters, so each start is tried."""

    name: str
    pattern: str
    needs: str
    confirm: str
    weight: float
    words: str
    mask: str
    length: str = ""


CONTEXT_GAIN, KEEP, NEAR = 0.35, 0.6, 40
DIGITS = "regexp_replace(m, '[^0-9]', '')"
HEAD = 4
# Letters count 10..35; the number is reduced digit by digit so that no long integer is needed.
MOD97 = ("aggregate(split(concat(substring(b, 5), substring(b, 1, 4)), ''), 0L, (a, c) -> "
         "case when c = '' then a when c between '0' and '9' then (a * 10 + cast(c as bigint)) % 97 "
         "else (a * 100 + ascii(c) - 55) % 97 end) = 1")
#: Lengths of the IBAN register.
IBAN_LENGTHS = {15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
                23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV",
                29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}
_COUNTRY = "case {} end".format(" ".join("when substring(m, 1, 2) in ({}) then {}".format(", ".join(f"'{c}'" for c in v.split()), n) for n, v in IBAN_LENGTHS.items()))
# Ends before a blank (or at the end of the run) whose check digits are right; the country's length goes before the longest.
_ENDS = (f"filter(sequence(15, length(m)), e -> substring(m, e, 1) <> ' ' and substring(m, e + 1, 1) in ('', ' ') and exists(array(replace(substring(m, 1, e), ' ', '')), b -> length(b) between 15 and 34 and {MOD97}))")
IBAN_LENGTH = (f"transform(array({_ENDS}), x -> coalesce(get(filter(x, e -> length(replace(substring(m, 1, e), ' ', '')) = {_COUNTRY}), 0), array_max(x)))[0]")

#: The first four are confirmed by form or checksum alone and always stay; the rest may need context.
KINDS = (
    Kind("email", rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", "true", 0.9, r"mail|contact|write|reach", "<EMAIL>"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]",
         r"forall(split(m, '[.]'), p -> length(trim(leading '0' from p)) <= 3 and coalesce(try_cast(trim(leading '0' from p) as int), 0) <= 255)",
         0.7, r"\bip\b|address|host|server", "<IP>"),
    Kind("card", r"[0-9]++(?:[\x20-][0-9]++)*+", "[0-9]", "length(translate(m, ' -', '')) between 13 and 19 and luhn_check(translate(m, ' -', ''))",
         0.8, r"card|visa|credit|payment", "<CARD>"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", f"length({DIGITS}) between 9 and 15", 0.7, r"phone|tel|call|mobile|fax", "<PHONE>"),
    Kind("iban", r"(?<![A-Za-z0-9])(?=([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])))[A-Z]{2}[0-9]{2}", r"[A-Z]{2}[0-9]{2}",
         "true", 0.9, r"iban|account|bank|konto|cuenta|compte", "<IBAN>", IBAN_LENGTH),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "[0-9]-[0-9]",
         "substring(m, 1, 3) not in ('000', '666') and m not like '9%' and substring(m, 5, 2) <> '00' and substring(m, 8) <> '0000'",
         0.3, r"ssn|social security|sozialversicherung|seguro social", "<SSN>"),
    Kind("local_phone", r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9-])", "[0-9]{3}", "true", 0.3, r"phone|tel|call|mobile|fax", "<PHONE>"),
)
BASE = tuple(k.name for k in KINDS[:4])
SPAN = "struct<kind:string,start:bigint,end:bigint,score:double>"


def _kind_spans(df: DataFrame, text: str, kind: Kind) -> DataFrame:
    """Append `_kind`: confirmed spans with their scores, in order."""
    t, n = f"`{text}`", f"_{kind.name}"
    pattern = F.lit(kind.pattern)
    there = F.col(t).contains("@") if kind.needs == "@" else F.col(t).rlike(kind.needs)
    df = df.withColumn(f"{n}_found", F.when(there, F.regexp_extract_all(F.col(t), pattern, F.lit(1 if kind.length else 0))).otherwise(F.array().cast("array<string>")))
    df = df.withColumn(f"{n}_gap", F.when(F.size(f"{n}_found") > 0, F.split(F.col(t), kind.pattern, -1)).otherwise(F.array().cast("array<string>")))
    df = df.withColumn(f"{n}_ok", F.expr(f"transform({n}_found, m -> {kind.length or f'if({kind.confirm}, length(m), null)'})"))
    # `end`: of the last span; a start inside it is none.
    step = f"if(x.{n}_found is null, 0, {HEAD})" if kind.length else f"coalesce(length(x.{n}_found), 0)"
    start = f"a.at + length(x.{n}_gap)"
    good = f"x.{n}_ok is not null and {start} >= a.end"
    walk = (f"aggregate(arrays_zip({n}_found, {n}_gap, {n}_ok), cast(struct(0L, 0L, array()) as struct<at:bigint,end:bigint,out:array<struct<s:bigint,e:bigint>>>), "
            f"(a, x) -> struct({start} + {step} as at, if({good}, {start} + x.{n}_ok, a.end) as end, "
            f"if({good}, array_append(a.out, struct({start} as s, {start} + x.{n}_ok as e)), a.out) as out), a -> a.out)")
    df = df.withColumn(f"{n}_at", F.expr(walk))
    near = (f"concat_ws(' ', substring({t}, cast(greatest(p.s - {NEAR - 1}, 1) as int), cast(least(p.s, {NEAR}) as int)), substring({t}, cast(p.e + 1 as int), {NEAR}))")
    scored = F.expr(f"transform({n}_at, p -> cast(struct('{kind.name}', p.s, p.e, round(least(1.0d, {kind.weight}d + "
                    f"if(lower({near}) rlike r'{kind.words}', {CONTEXT_GAIN}d, 0d)), 2)) as {SPAN}))")
    df = df.withColumn(n, F.filter(scored, lambda s: s["score"] >= KEEP))
    return df.drop(f"{n}_found", f"{n}_gap", f"{n}_ok", f"{n}_at")


def find(df: DataFrame, text: str = "text", out: str = "spans", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """Append `out`: all spans by kind as listed, then start, each with its score."""
    kept = [c for c in df.columns if c != out]
    df = packed(df, kept, _text=F.coalesce(F.col(f"`{text}`"), F.lit("")))
    for k in kinds:
        df = _kind_spans(df, "_text", k)
    return unpacked(df, kept, **{out: F.concat(*(F.col(f"_{k.name}") for k in kinds))})


def is_kind(kind: str):
    return lambda s: s["kind"] == kind


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def mask(df: DataFrame, text: str = "text", spans: str = "spans", out: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """Replace every span by the mark of its kind. Where spans overlap, the one that starts first (then the longest,
    then the first kind listed) gives the mark and what reaches beyond it goes too. A null text stays null."""
    marks = F.create_map(*(x for k in kinds for x in (F.lit(k.name), F.lit(k.mask))))
    kept = [c for c in df.columns if c != out]
    df = packed(df, kept, _text=F.col(f"`{text}`"), _spans=F.col(f"`{spans}`"))
    order = F.array_sort(F.transform("_spans", lambda s: F.struct(s["start"].alias("s"), (-s["end"]).alias("ne"), marks[s["kind"]].alias("mark"))))
    df = df.withColumn("_order", F.when(F.size("_spans") > 0, order))
    t = "_text"
    made = F.expr(
        "aggregate(_order, cast(struct(array(), 0L) as struct<parts:array<string>,at:bigint>), (a, x) -> if(x.s < a.at, struct(a.parts as parts, greatest(a.at, -x.ne) as at), "
        f"struct(array_append(a.parts, concat(substring({t}, cast(a.at + 1 as int), cast(x.s - a.at as int)), x.mark)) as parts, -x.ne as at)), "
        f"a -> concat(array_join(a.parts, ''), substring({t}, cast(a.at + 1 as int))))")
    return unpacked(df, kept, **{out: F.when(F.col("_order").isNull(), F.col(t)).otherwise(made)})
